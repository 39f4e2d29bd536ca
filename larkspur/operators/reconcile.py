"""Reconciling an external list or export with the catalogue, and judging what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

#: Fixed value: the export's own folders.
PRIMARY = r"^(Photos from \d{4}|Archive)$"


def is_primary(folder: Column, part: str = "first") -> Column:
    """Whether the first (or the `last`) part of a folder is one of the export's own folders, not an album."""
    return F.substring_index(folder, "/", 1 if part == "first" else -1).rlike(PRIMARY)


def media_entries(entries: DataFrame, root: str, bins: list[str]) -> DataFrame:
    """Entries (zip, name, size, crc) below `root` and outside its bins, with folder (below the root) and file."""
    inside = entries.filter(F.startswith("name", F.lit(root + "/"))).withColumn("_r", F.substring(F.col("name"), len(root) + 2, 1 << 30))
    out = inside.withColumns({"folder": X.dirname(F.col("_r")), "file": X.basename(F.col("_r"))}).drop("_r")
    return out.filter(~F.substring_index("folder", "/", 1).isin(bins)) if bins else out


def distinct_entries(entries: DataFrame) -> DataFrame:
    """One entry for each (size, crc): from a year folder, else Archive, else an album; then by name."""
    rank = F.when(F.col("folder").rlike(r"^Photos from \d{4}$"), 0).when(F.col("folder") == "Archive", 1).otherwise(2)
    rest = [c for c in entries.columns if c not in ("size", "crc")]
    return entries.groupBy("size", "crc").agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), "name", "folder")).alias("e"), F.count(F.lit(1)).alias("copies")).select("size", "crc", "e.*", "copies")


def match(entries: DataFrame, held: DataFrame) -> DataFrame:
    """Entries with `state` (archive, quarantine or new) and the matching `rel`, by equal size and checksum.

    held: (rel, label archive or quarantine, size, crc).  Size and checksum form one equi-join; the archive comes first.
    """
    best = held.groupBy("size", "crc").agg(F.min_by(F.struct("label", "rel"), F.struct((F.col("label") != "archive").alias("a"), "rel")).alias("h"))
    return entries.join(best, ["size", "crc"], "left").select(*entries.columns, F.coalesce("h.label", F.lit("new")).alias("state"), F.col("h.rel").alias("rel"))


def accounted(paths: DataFrame, files: DataFrame, quarantined: DataFrame) -> DataFrame:
    """`paths` (path, size) with `state`: archive, exact-dup, chosen or null.

    A file of the path counts if sizes agree (a null size agrees with all, as a log entry without size does); a
    quarantined one is `chosen` if its rule begins with `similar`.
    """
    f = files.select("path", F.col("size").alias("f_size"), F.lit(True).alias("f_here"))
    q = quarantined.select("path", F.col("size").alias("q_size"), "rule", F.lit(True).alias("q_here"))
    rows = paths.join(f, "path", "left").join(q, "path", "left")
    in_archive = F.col("f_here") & (F.col("size").isNull() | F.coalesce(F.col("f_size") == F.col("size"), F.lit(False)))
    in_quarantine = F.col("q_here") & (F.col("size").isNull() | F.col("q_size").isNull() | (F.col("q_size") == F.col("size")))
    state = F.when(in_archive, "archive").when(in_quarantine, F.when(F.startswith(F.coalesce("rule", F.lit("")), F.lit("similar")), "chosen").otherwise("exact-dup"))
    return rows.select(*paths.columns, state.alias("state"))


def readiness(entries: DataFrame, files: DataFrame, quarantined: DataFrame) -> DataFrame:
    """`entries` (path, folder, size, crc) with `state`: as `accounted`, else `album copy` of an accounted entry in one of
    the export's own folders (same size and crc), else UNACCOUNTED."""
    rows = accounted(entries, files, quarantined)
    safe = rows.filter(is_primary(F.col("folder")) & F.col("state").isNotNull()).select("size", "crc", F.lit(True).alias("twin")).distinct()
    state = F.coalesce("state", F.when(F.col("twin") & ~is_primary(F.col("folder")), F.lit("album copy")), F.lit("UNACCOUNTED"))
    return rows.join(safe, ["size", "crc"], "left").select(*entries.columns, state.alias("state"))


def tiered(listed: DataFrame, known: DataFrame) -> DataFrame:
    """`listed` (uuid, stem, size, day) with `found`: name (same size and stem), day (same size and day) or missing."""
    by = lambda c: known.filter(F.col(c).isNotNull() & (F.col(c) != "")).select("size", c, F.lit(True).alias(f"_{c}")).distinct()
    rows = listed.join(by("stem"), ["size", "stem"], "left").join(by("day"), ["size", "day"], "left")
    return rows.select(*listed.columns, F.when(F.col("_stem"), "name").when(F.col("_day"), "day").otherwise("missing").alias("found"))


def without_clip(listed: DataFrame, clips: DataFrame) -> DataFrame:
    """Listed live photos (live_photo, stem) whose clip's stem is nowhere."""
    return listed.filter("live_photo").join(clips.select("stem").distinct(), "stem", "left_anti")


def pick(df: DataFrame, *names: str) -> Column:
    """The first of several columns that exists and isn't null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def owner_group(shared_library: Column, owner_hash: Column, owner: Column, syndicated: Column) -> Column:
    given = lambda c: F.coalesce(c.cast("string"), F.lit("")).isin("", "None", "false", "False", "0") == F.lit(False)
    return F.when(given(shared_library), "Shared Library").when(given(owner_hash) | given(owner) | given(syndicated), "from other people").otherwise("personal")


def list_figures(listed: DataFrame) -> DataFrame:
    """Distinct albums, favourites, rows with keywords, persons and a title or description, of those not in the bin.

    Albums are exploded apart from the rest, so no row is counted twice.
    """
    kept = listed.filter(~F.coalesce("intrash", F.lit(False)))
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    titled = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("description") != "", F.col("description"))).isNotNull()
    counts = kept.agg(F.count_if("favorite").alias("favourites"), F.count_if(some("keywords")).alias("keywords"), F.count_if(some("persons")).alias("persons"), F.count_if(titled).alias("titled"))
    albums = kept.select(F.explode("albums").alias("a")).agg(F.countDistinct("a").alias("albums"))
    return albums.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")


def membership(items: DataFrame, indexed: DataFrame, parked: DataFrame) -> DataFrame:
    """`items` (path, sha1) with `state`: index, parked or missing."""
    a = indexed.select("sha1", F.lit("index").alias("_a")).distinct()
    b = parked.select("sha1", F.lit("parked").alias("_b")).distinct()
    return items.join(a, "sha1", "left").join(b, "sha1", "left").select(*items.columns, F.coalesce("_a", "_b", F.lit("missing")).alias("state"))


#: What a photo library keeps for itself.
LIBRARY = r"(?i)\.(photoslibrary|aplibrary|photolibrary)/"
LIBRARY_TOP = r"(?i)\.(photoslibrary|aplibrary|photolibrary)/[^/]+$"
INTERNAL_FOLDERS = r"/(private|database|scopes|internal|Backup)/"
INTERNAL_NAMES = (".ipspot_update", "Projects.db", "ProjectDBVersion.plist", "PkgInfo", "Recents.plist")
METADATA_NAME = r"(?i)(\.aae$|AlbumData2?\.xml$)"


def classify_missing(entries: DataFrame, names: DataFrame) -> DataFrame:
    """`entries` (kind MISSING or UNREADABLE, path, broken_link) with `class`: junk, metadata or real; rules in order.

    names: (name) in lower case of the files that the archive or the same folder holds, for proxies beside a real clip.
    """
    p, name = F.col("path"), X.basename(F.col("path"))
    proxy = F.lower(X.extension(p)).isin(".lrv", ".thm")
    twin = names.select(F.col("name").alias("_twin")).distinct()
    rows = entries.withColumn("_clip", F.when(proxy, F.concat(F.lower(X.stem(p)), F.lit(".mp4"))))
    rows = rows.join(twin, F.col("_clip") == F.col("_twin"), "left")
    internal = name.isin(*INTERNAL_NAMES)
    lock = F.contains(F.lower(name), F.lit("lock")) | F.endswith(name, F.lit(".lck")) | F.endswith(name, F.lit(".tmp"))
    out = (
        F.when(F.col("kind") == "UNREADABLE", F.when(F.col("broken_link"), "junk").otherwise("real"))
        .when(name.rlike(METADATA_NAME), "metadata")
        .when(p.rlike(LIBRARY_TOP), F.when(lock, "junk").otherwise("metadata"))
        .when(p.rlike(LIBRARY) & (p.rlike(INTERNAL_FOLDERS) | internal), "junk")
        .when(internal | F.contains(p, F.lit("/Snagit/")) | F.contains(p, F.lit("/Photo Booth Library/")), "junk")
        .when(F.col("_twin").isNotNull(), "junk")
        .otherwise("real")
    )
    return rows.select(*entries.columns, out.alias("class"))


def verdict(classified: DataFrame) -> DataFrame:
    """One row: counts by class, whether it is safe, and an exit code (0 safe, 1 metadata only, 2 not safe)."""
    out = classified.agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("junk", "metadata", "real")])
    return out.withColumn("verdict", F.when(F.col("real") > 0, "NOT SAFE").when(F.col("metadata") > 0, "SAFE FOR PHOTOS AND VIDEOS").otherwise("SAFE")).withColumn("code", F.when(F.col("real") > 0, 2).when(F.col("metadata") > 0, 1).otherwise(0))


def classify_small_names(files: DataFrame, folder: str, pattern: str, most_side: int) -> DataFrame:
    """(path, outcome) of photos below `folder` (case matters): park, or why they stay."""
    rows = files.filter((F.col("kind") == "photo") & F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    out = F.when(~X.basename(F.col("path")).rlike(pattern), "other name").when(none("width") | none("height"), "unknown size").when(F.coalesce("make", F.lit("")) != "", "camera data").when(F.greatest("width", "height") > most_side, "too large").otherwise("park")
    return rows.select("path", out.alias("outcome"))


def previews(files: DataFrame, grouped: DataFrame, pattern: str, ratio: float) -> DataFrame:
    """(path, outcome) of preview files: parked if a full-size file has the stem, or a group member `ratio` times the pixels.

    The best candidate of a group is its largest non-preview, so one aggregate replaces the pairwise comparison.
    """
    photo = files.filter("kind = 'photo'").select("path", X.pixels(F.col("width"), F.col("height")).alias("px"))
    photo = photo.withColumn("key", F.lower(F.regexp_extract(X.basename(F.col("path")), pattern, 1)))
    preview, full = photo.filter("key != ''"), photo.filter("key = ''")
    stems = full.select(F.lower(X.stem(F.col("path"))).alias("key"), F.lit(True).alias("by_stem")).distinct()
    largest = grouped.join(full, "path").groupBy("group_id").agg(F.max("px").alias("most"))
    by_group = grouped.join(largest, "group_id").select("path", "most")
    out = F.when(F.col("by_stem"), "park: same stem").when(F.col("most") >= F.col("px") * ratio, "park: larger look-alike").otherwise("stay")
    return preview.join(stems, "key", "left").join(by_group, "path", "left").select("path", out.alias("outcome"))


def extraction(entries: DataFrame, chosen: DataFrame, existing: DataFrame) -> DataFrame:
    """(zip, name, action) for chosen entries and the .json files of their folders: write, or skip where the size is there.

    Targets that two entries share are refused.
    """
    folders = chosen.select(X.dirname(F.col("name")).alias("_d")).distinct()
    side = entries.filter(F.endswith(F.lower("name"), F.lit(".json"))).withColumn("_d", X.dirname(F.col("name"))).join(folders, "_d", "left_semi").drop("_d")
    todo = entries.join(chosen.select("zip", "name"), ["zip", "name"], "left_semi").unionByName(side).distinct()
    twice = todo.groupBy("name").agg(F.count(F.lit(1)).alias("targets"))
    here = existing.select(F.col("path").alias("name"), F.col("size").alias("there"))
    rows = todo.join(twice, "name").join(here, "name", "left")
    action = F.when(~X.is_safe_path(F.col("name")), "refuse: unsafe path").when(F.col("targets") > 1, "refuse: same target").when(F.col("there") == F.col("size"), "skip").otherwise("write")
    return rows.select("zip", "name", action.alias("action"))


def list_problem(listed: DataFrame) -> str | None:
    """Why a library list can't be used, or None: it needs a file name and a size under one of their usual names."""
    for wanted, what in ((("original_filename", "filename"), "file name"), (("original_filesize", "filesize"), "file size")):
        if not set(wanted) & set(listed.columns):
            return f"the list has no {what}; its columns are {', '.join(sorted(listed.columns))}"
    return None


def freshness(files: DataFrame, log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Last scan, last move, last snapshot, and whether the snapshot is older than either."""
    one = lambda df, c, name: df.agg(F.max(c).alias(name)).withColumn("_k", F.lit(1))
    rows = one(files, "scanned_at", "scanned").join(one(log, "moved_at", "moved"), "_k").join(one(snapshot, "taken", "saved"), "_k").drop("_k")
    return rows.withColumn("stale", F.coalesce(F.col("saved") < F.greatest("scanned", "moved"), F.lit(True)))
