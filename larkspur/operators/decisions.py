"""Decisions and their log: merges into snapshots, marks, batches, and what may be restored or purged.

Tables are immutable: each operator takes the table as it is and returns it as it shall be.  `sources.sinks` swaps snapshots.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

from . import browse


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """`old` with the rows of `new` put in; columns in `keep` stay as they were where the key was known."""
    o = old.select(*keys, F.struct(*[c for c in old.columns]).alias("_o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns]).alias("_n"))
    cols = [F.col(c) if c in keys else (F.when(F.col("_n").isNull() | (F.col("_o").isNotNull() if c in keep else F.lit(False)), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")) if c in new.columns else F.col(f"_o.{c}")).alias(c) for c in old.columns]
    return o.join(n, keys, "full_outer").select(*cols)


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True).select(*old.columns)


def forget(old: DataFrame, seen: DataFrame, keys: list[str], limited: bool = False) -> DataFrame:
    """Without the rows that the scan didn't see; a limited scan forgets nothing."""
    return old if limited else old.join(seen.select(*keys).distinct(), keys, "left_semi")


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with new entries, numbered on from its largest id in their order."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = [F.col(c) for c in ("moved_at", "approved_at", "path", "keep_src", "remove_src", "gid") if c in entries.columns]
    numbered = browse.placed(entries, order, "_n").withColumn("id", (F.col("_n") + last).cast(log.schema["id"].dataType)).drop("_n")
    return log.unionByName(numbered, allowMissingColumns=True)


def stamp(table: DataFrame, hit: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """`column` set to `value` where it was null and the key is in `hit` (state is set once)."""
    h = hit.select(*keys, F.lit(True).alias("_hit")).distinct()
    return table.join(h, keys, "left").withColumn(column, F.when(F.col("_hit") & F.col(column).isNull(), F.lit(value)).otherwise(F.col(column))).select(*table.columns)


def withdraw(table: DataFrame, hit: DataFrame, keys: list[str], used: str = "used_batch") -> DataFrame:
    """Without the rows in `hit` that aren't used yet."""
    h = hit.select(*keys, F.lit(True).alias("_hit")).distinct()
    return table.join(h, keys, "left").filter(F.col("_hit").isNull() | F.col(used).isNotNull()).select(*table.columns)


def discard_others(marks: DataFrame, sources: DataFrame, keeper: str, at: str) -> DataFrame:
    """Marks with every path of `sources` discarded for `keeper`, but for those already used."""
    used = marks.filter("used_batch is not null").select("path")
    new = sources.select("path").distinct().join(used, "path", "left_anti").select("path", F.lit("discard").alias("mark"), F.lit(keeper).alias("keeper"), F.lit(at).alias("set_at"))
    return replace(marks, new, ["path"])


def redate(files: DataFrame, now: datetime) -> DataFrame:
    """Files dated by folder or file time, dated by their name where that has a date."""
    d = F.when(F.col("date_source").isin("mtime", "folder"), X.date_from_filename(F.col("path"), now))
    return files.withColumn("_d", d).withColumns({"taken_at": F.coalesce("_d", "taken_at"), "date_source": F.when(F.col("_d").isNotNull(), "filename").otherwise(F.col("date_source"))}).drop("_d")


def regeo(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files not yet checked get their place from `tags` (path, lat, lon, side_lat, side_lon), and are checked."""
    t = tags.select("path", X.geo_for((F.col("lat"), F.col("lon")), [(F.col("side_lat"), F.col("side_lon"))]).alias("_g"))
    open_ = F.col("geo_done") == 0
    rows = files.join(t, "path", "left")
    new = {c: F.when(open_, F.col(f"_g.{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "geo_source")}
    return rows.withColumns(new | {"geo_done": F.lit(1)}).select(*files.columns)


def decide(marks: DataFrame, submitted: DataFrame, valid: DataFrame, at: str) -> DataFrame:
    """Marks after a submission (submission, path, pick); submissions not in `valid` (submission, ok) are left alone.

    pick: later (forgets unused marks), all, trash, or the path to keep, which discards the others; another path is ignored.
    """
    rows = submitted.join(valid.filter("ok").select("submission"), "submission", "left_semi").distinct()
    named = rows.groupBy("submission").agg(F.count_if(F.col("path") == F.col("pick")).alias("hits"))
    rows = rows.join(named, "submission").filter(F.col("pick").isin("later", "all", "trash") | (F.col("hits") > 0))
    mark = F.when(F.col("pick") == "all", "keep").when(F.col("pick") == "trash", "trash").when(F.col("path") == F.col("pick"), "keep").otherwise("discard")
    keeper = F.when(~F.col("pick").isin("all", "trash") & (F.col("path") != F.col("pick")), F.col("pick"))
    new = rows.filter("pick != 'later'").select("path", mark.alias("mark"), keeper.alias("keeper"), F.lit(at).alias("set_at"))
    return replace(withdraw(marks, rows.filter("pick = 'later'"), ["path"]), new, ["path"])


def discard_plan(marks: DataFrame, files: DataFrame) -> DataFrame:
    """(victim, keeper, partners, keeper_ok, trash): unused discards whose file is still indexed."""
    todo = marks.filter("mark in ('discard', 'trash') and used_batch is null").select(F.col("path").alias("victim"), F.when(F.col("mark") != "trash", F.col("keeper")).alias("keeper"), (F.col("mark") == "trash").alias("trash"))
    v = files.select(F.col("path").alias("victim"), "pair_key")
    kept = marks.filter("mark = 'keep'").select("path").join(files.select("path"), "path", "left_semi").select(F.col("path").alias("keeper"), F.lit(True).alias("keeper_ok"))
    clips = files.filter("kind = 'video' and pair_key is not null").select("pair_key", F.col("path").alias("clip"))
    rows = todo.join(v, "victim")
    beside = rows.join(clips, "pair_key").filter((F.col("clip") != F.col("victim")) & (X.dirname(F.col("clip")) == X.dirname(F.col("victim")))).groupBy("victim").agg(F.sort_array(F.collect_set("clip")).alias("partners"))
    return rows.join(beside, "victim", "left").join(kept, "keeper", "left").select("victim", "keeper", F.coalesce("partners", F.array().cast("array<string>")).alias("partners"), F.coalesce("keeper_ok", F.lit(False)).alias("keeper_ok"), "trash")


def copied_overrides(overrides: DataFrame, moved: DataFrame, at: str) -> DataFrame:
    """Overrides with a moved victim's date given to its keeper, where that has none."""
    new = moved.select(F.col("victim").alias("_v"), F.col("keeper").alias("path")).join(overrides.select(F.col("path").alias("_v"), "taken_at"), "_v")
    new = new.groupBy("path").agg(F.min("taken_at").alias("taken_at")).withColumns({"prev_source": F.lit("copied from quarantined duplicate"), "set_at": F.lit(at)})
    return insert_missing(overrides, new, ["path"])


def batches(log: DataFrame) -> DataFrame:
    """Per batch: files, bytes, moved_at, how many are held, restored and purged, and the bytes still held."""
    held = F.col("restored_at").isNull() & F.col("purged_at").isNull()
    return log.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.max("moved_at").alias("moved_at"),
        F.count_if(held).alias("held"),
        F.count_if(F.col("restored_at").isNotNull()).alias("restored"),
        F.count_if(F.col("purged_at").isNotNull()).alias("purged"),
        F.coalesce(F.sum(F.when(held, F.col("size"))), F.lit(0)).alias("held_bytes"),
    )


def held_now(log: DataFrame) -> DataFrame:
    return log.filter("restored_at is null and purged_at is null")


def restorable(log: DataFrame, batch: str, prefix: str = "") -> DataFrame:
    """What a batch still holds, below a prefix if one is given."""
    rows = held_now(log).filter(F.col("batch") == batch)
    return rows.filter(X.has_prefix(F.col("path"), prefix)) if prefix else rows


def purgeable(log: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """(batch, days_left, may_purge) of the batches that hold files."""
    left = X.retention_left(F.max("moved_at"), now, days)
    return held_now(log).groupBy("batch").agg(left.alias("days_left")).withColumn("may_purge", F.col("days_left") <= 0)


def date_targets(files: DataFrame, overrides: DataFrame, folder: str, only_guessed: bool) -> DataFrame:
    """Files right in a folder, or only those dated by file time and not by hand, and the other halves of their pairs."""
    rows = files.filter(X.direct_child(F.col("path"), folder))
    if only_guessed:
        rows = rows.filter("date_source = 'mtime'").join(overrides.select("path"), "path", "left_anti")
    return browse.with_partners(rows.select(*files.columns), files)


def set_dates(overrides: DataFrame, targets: DataFrame, taken_at: str | None, at: str) -> DataFrame:
    """Overrides with the targets' date set (what they had is kept beside it), or cleared for None."""
    if taken_at is None:
        return overrides.join(targets.select("path"), "path", "left_anti").select(*overrides.columns)
    new = targets.select("path", F.lit(taken_at).alias("taken_at"), F.col("taken_at").alias("prev_taken_at"), F.col("date_source").alias("prev_source"), F.lit(at).alias("set_at"))
    return upsert(overrides, new, ["path"], keep=("prev_taken_at", "prev_source"))


def approve_take(approvals: DataFrame, new: DataFrame) -> DataFrame:
    """Approvals with a new one for its group; an unused earlier one of the group goes."""
    return append(withdraw(approvals, new, ["gid"], "used_at"), new)


def latest_take(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy("gid").agg(F.max_by(F.struct(*approvals.columns), "id").alias("r")).select("r.*")


def apply_takes(approvals: DataFrame, marks: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(approvals, marks) after the open approvals are carried out: stamped, and for mode add_discard the frames are discarded.

    The archive path is best-take/ and the name of the approved picture.
    """
    path = F.concat(F.lit("best-take/"), X.basename(F.col("out_rel")))
    open_ = F.col("used_at").isNull()
    used = approvals.withColumns({"archive_path": F.when(open_, path).otherwise(F.col("archive_path")), "used_at": F.when(open_, F.lit(at)).otherwise(F.col("used_at"))})
    adding = approvals.filter(open_ & (F.col("mode") == "add_discard")).withColumn("rel", path)
    keep = adding.select(F.col("rel").alias("path"), F.lit("keep").alias("mark"), F.lit(None).cast("string").alias("keeper"), F.lit(at).alias("set_at"))
    frames = adding.select("id", "rel", F.explode(F.from_json("made_from", "array<string>")).alias("path")).groupBy("path").agg(F.max_by("rel", "id").alias("keeper"))
    frames = frames.join(marks.filter("used_batch is not null").select("path"), "path", "left_anti").select("path", F.lit("discard").alias("mark"), "keeper", F.lit(at).alias("set_at"))
    return used, replace(marks, keep.unionByName(frames), ["path"])
