"""Browsing the catalogue: overlay of corrections, filters, facets, the map and the timeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.sources.staging import staged

from . import paging

#: An overlay of corrections is made by people, so it is small; beyond this many rows it is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if it is known to have at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def overlay(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """The files with the dates that people set: taken_at and date_source ('manual') replaced where there is one."""
    o = small(overrides.select("path", F.col("taken_at").alias("_set")).filter("_set is not null"))
    own = [c for c in files.columns if c not in ("taken_at", "date_source")]
    return files.join(o, "path", "left").select(*own, F.coalesce("_set", "taken_at").alias("taken_at"), F.when(F.col("_set").isNotNull(), "manual").otherwise(F.col("date_source")).alias("date_source"))


def located(files: DataFrame, overrides: DataFrame) -> DataFrame:
    return overlay(files, overrides).filter(F.col("lat").isNotNull())


@dataclass(frozen=True)
class Browse:
    """Parameters of the grid.  A value that isn't allowed sets no filter."""

    source: str = ""
    year: str = ""
    month: str = ""
    kind: str = ""
    live: bool = False
    text: str = ""
    date_source: str = ""
    bbox: str = ""
    sort: str = "new"

    def condition(self, sources: list[str] | None = None) -> Column:
        """sources: those that exist; a source that isn't among them sets no filter (None: it always does)."""
        out = X.visible(F.col("kind"), F.col("pair_key"))
        if self.source and (sources is None or self.source in sources):
            out &= X.has_prefix(F.col("path"), self.source + "/")
        if self.year.isdigit() and len(self.year) == 4:
            out &= F.substring("taken_at", 1, 4) == self.year
        if self.month.isdigit() and 1 <= int(self.month) <= 12:
            out &= F.substring("taken_at", 6, 2) == f"{int(self.month):02d}"
        if self.kind in ("photo", "video"):
            out &= F.col("kind") == self.kind
        if self.live:
            out &= F.col("pair_key").isNotNull()
        if self.text:
            out &= X.contains(F.col("path"), self.text)
        if self.date_source in ("exif", "google", "filename", "folder", "mtime", "manual"):
            out &= F.col("date_source") == self.date_source
        if box := X.parse_bbox(self.bbox):
            out &= F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
        return out

    def keys(self) -> list[paging.Key]:
        return {"old": paging.keys("taken_at", "id"), "size": paging.keys("-size", "id"), "name": paging.keys("path", "id")}.get(self.sort, paging.keys("-taken_at", "-id"))

    def order(self) -> list[Column]:
        return paging.ordered(self.keys())


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 96) -> DataFrame:
    """One page of an ordered list by its number: all pages before are sorted too.  `paging.next_page` goes on from a row instead."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def count_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{w}_{c}") for c in ("lat", "lon") for w, f in (("min", F.min), ("max", F.max))])


def geo_cells(rows: DataFrame, zoom: float, most: int = 2500) -> DataFrame:
    """Cells of a world map: how many, where on average and between what; the largest `most` cells."""
    cell = X.cell_size(zoom)
    at = [F.floor((F.col(c) + half) / cell).cast("long").alias(f"cell_{c}") for c, half in (("lat", 90), ("lon", 180))]
    grouped = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{w}_{c}") for c in ("lat", "lon") for w, f in (("avg", F.avg), ("min", F.min), ("max", F.max))], F.min("id").alias("first_id"))
    return grouped.orderBy(F.desc("n"), "cell_lat", "cell_lon").limit(most)


def timeline(rows: DataFrame, this_year: int) -> DataFrame:
    """Year by month counts, with every year from the first to the last, row totals and the fullest cell (1 if none)."""
    y = F.substring("taken_at", 1, 4).try_cast("int")
    m = F.substring("taken_at", 6, 2).try_cast("int")
    counted = rows.select(y.alias("year"), m.alias("month")).filter(F.col("year").between(1990, this_year + 1))
    pivot = counted.groupBy("year").agg(*[F.count_if(F.col("month") == k).alias(f"m{k:02d}") for k in range(1, 13)], F.count(F.lit(1)).alias("total"))
    # One row for each year at most.
    span = pivot.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    filled = span.join(pivot, "year", "left").na.fill(0)
    return filled.withColumn("fullest", F.greatest(F.lit(1), F.max(F.greatest(*[f"m{k:02d}" for k in range(1, 13)])).over(Window.partitionBy())))


def partner(files: DataFrame) -> DataFrame:
    """(id, partner_id, partner_kind): of each file with a pair key the preferred other half.

    A clip before a still, one below the same folder before others, then the smallest id.  For each key, kind and folder
    (and for the key as a whole) the two smallest ids are all that can be preferred, as a file is never its own partner;
    so nothing is paired with all that share its key.
    """
    rows = files.filter(F.col("pair_key").isNotNull()).select("id", "kind", "path", "pair_key", (F.col("kind") != "video").alias("_k"))
    parts = F.split(F.lower("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    # Folder null stands for any.
    dealt = rows.select("pair_key", "_k", "id", "kind", F.explode(F.array_distinct(F.concat(above, F.array(F.lit(None).cast("string"))))).alias("_d"))
    place = ["pair_key", "_k", "_d"]
    first = dealt.groupBy(*place).agg(F.min(F.struct("id", "kind")).alias("_a"))
    other = dealt.alias("p").join(first.alias("f"), [F.col("p.pair_key") == F.col("f.pair_key"), F.col("p._k").eqNullSafe(F.col("f._k")), F.col("p._d").eqNullSafe(F.col("f._d"))])
    other = other.filter(F.col("p.id") != F.col("f._a.id")).groupBy(*[F.col(f"p.{c}").alias(c) for c in place]).agg(F.min(F.struct("p.id", "p.kind")).alias("_b"))
    best = first.alias("f").join(other.alias("o"), [F.col("f.pair_key") == F.col("o.pair_key"), F.col("f._k").eqNullSafe(F.col("o._k")), F.col("f._d").eqNullSafe(F.col("o._d"))], "left")
    best = best.select(F.col("f.pair_key").alias("_key"), F.col("f._k").alias("not_video"), F.col("f._d").alias("_d"), "_a", "_b")
    asked = rows.select("id", "pair_key", F.explode(F.array(F.lower(X.dirname(F.col("path"))), F.lit(None).cast("string"))).alias("_own"))
    met = asked.join(best, (F.col("pair_key") == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_d")))
    found = F.when(F.col("_a.id") != F.col("id"), F.col("_a")).otherwise(F.col("_b"))
    ranked = met.select("id", F.struct("not_video", F.col("_d").isNull().alias("far"), found["id"].alias("partner_id"), found["kind"].alias("partner_kind")).alias("r")).filter("r.partner_id is not null")
    return ranked.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.partner_id", "r.partner_kind")


def with_partners(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """`chosen` (columns of files) and all files that share a pair key with one of them, each path once."""
    keys = chosen.select("pair_key").filter("pair_key is not null").distinct()
    return chosen.unionByName(files.join(keys, "pair_key", "left_semi").select(*chosen.columns)).dropDuplicates(["path"])


def twin_classes(files: DataFrame) -> DataFrame:
    """(id, class_id, n_twins): files of equal content (sha1 and size), by the smallest id of these and how many others there are."""
    own = files.filter("sha1 is not null and size is not null").select("id", "sha1", "size")
    classes = own.groupBy("sha1", "size").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_twins")).filter("n_twins > 0")
    return own.join(classes, ["sha1", "size"]).select("id", "class_id", "n_twins")


def twins(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(id, twin_id): of each file asked for those of equal content (sha1 and size)."""
    a = asked.select("id", "sha1", "size")
    return a.join(files.select(F.col("id").alias("twin_id"), "sha1", "size"), ["sha1", "size"]).filter("id != twin_id").select("id", "twin_id")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` and their place in an order, from 1, as a column: ranges are numbered apart, then moved by the rows before them.

    The ranges are staged, as they have to be the same for counting and for numbering.
    """
    parted = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    counts = parted.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parted.withColumn("_own", own).join(F.broadcast(counts), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def profile(files: DataFrame) -> DataFrame:
    """(facet, key, n): the catalogue by extension, date source, year and place source, and its single figures."""
    facets = [("ext", F.col("ext")), ("date_source", F.coalesce("date_source", F.lit("none"))), ("year", F.substring("taken_at", 1, 4)), ("geo_source", F.coalesce("geo_source", F.lit("none")))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("key")) for n, c in facets])).alias("f")
    grouped = files.select(each).groupBy("f.facet", "f.key").agg(F.count(F.lit(1)).alias("n"))
    single = files.agg(F.countDistinct("pair_key").alias("pair_keys"), F.count_if(F.col("has_sidecar") == 1).alias("sidecars"), F.count_if(F.col("geo_done") == 0).alias("unchecked"))
    return grouped.unionByName(single.select(F.explode(F.array(*[F.struct(F.lit("figure").alias("facet"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in single.columns])).alias("f")).select("f.*"))


def pair_keys(files: DataFrame) -> DataFrame:
    """Files with pair_key: `cid:` and an identifier that two or more share, else `stem:` where a stem has both kinds.

    Two shuffles of narrow rows; equal keys meet through aggregates, not windows, so a hot identifier is combined early.
    """
    own = [c for c in files.columns if c != "pair_key"]
    shared = files.filter("content_id is not null and content_id != ''").groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(F.col("content_id").alias("_cid"))
    step = files.select(*own).join(shared, F.col("content_id") == F.col("_cid"), "left").withColumn("_stem", X.pair_stem(F.col("path"), F.col("kind")))
    both = step.filter("_cid is null").groupBy("_stem").agg(F.array_sort(F.collect_set("kind")).alias("k")).filter(F.col("k") == F.array(F.lit("photo"), F.lit("video"))).select(F.col("_stem").alias("_both"))
    out = step.join(both, F.col("_cid").isNull() & (F.col("_stem") == F.col("_both")), "left")
    return out.select(*own, F.when(F.col("_cid").isNotNull(), F.concat(F.lit("cid:"), "_cid")).when(F.col("_both").isNotNull(), F.concat(F.lit("stem:"), "_stem")).alias("pair_key"))
