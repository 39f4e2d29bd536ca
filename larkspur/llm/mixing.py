"""Mixing sources to target weights (native).

Sizes are summed per source, targets follow by water-filling, and every document is emitted floor(rate) times plus one
hash-seeded copy whose probability is the rate's fraction.  The draws of a source are not independent, so that a few long texts don't
carry it away from its target: its documents lie on a circle, each as long as its words, in the order of a hash; from a
hash-seeded start on, an arc of the circle as long as the words wanted is taken, with the documents that begin there.  The start is
uniform, so each document's chance is the arc's share of the circle, which is the fraction, and the words taken miss the
target by less than one document.  Only tables of sources and of hash ranges of sources are ever aggregated; documents are never
shuffled when the table of sources is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, portable_uniform, staged, word_count

#: A table of sources of at most this many rows is broadcast; a larger one is joined by shuffle (AQE splits hot sources).
BROADCAST_SOURCES = 50_000
#: Ranges of the draw in which sizes are summed, 2 ** RANGES at least, so many that one has about MOST rows at most; only the documents of
#: two ranges of each source are ever ordered.
RANGES, MOST = 12, 1 << 16


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target per source from `sizes` (source, size): (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes; none gets more than
    `cap` times its own size, and what is above is shared again by weight until none is above.  That is water-filling:
    with sources in order of cap/weight, those whose cap lies under the level are full and the rest split what is left.
    The windows without a partition run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("full", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy()
    ascending = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    after = ascending.rowsBetween(0, Window.unboundedFollowing)
    pool = F.lit(share) * F.sum("source_size").over(every)
    per = per.withColumns({"pool": pool, "used": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "rest_w": F.sum("w").over(after)})
    per = per.withColumn("is_full", (F.col("pool") - F.col("used")) * F.col("w") >= F.col("full") * F.col("rest_w"))
    spent = F.coalesce(F.sum(F.when(F.col("is_full"), F.col("full"))).over(every), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("is_full"), F.col("w"))).over(every)
    level = (F.col("pool") - spent) / open_w
    return per.select("source", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(level * F.col("w")).alias("target"))


def draws(sized: DataFrame, seed: int) -> DataFrame:
    """`sized` (with doc_id and text) and mix_draw, in [0, 1): by doc_id and text, so only rows that repeat both share it."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sized.withColumn("mix_draw", portable_uniform(seed, key))


def arcs(drawn: DataFrame, per: DataFrame, seed: int, ranges: int) -> DataFrame:
    """`per` (source, source_size, target, times, want) with begin, end and wraps: the draws that the arc of a source has.

    drawn: (source, mix_draw, size) of every document.  A document's place is the words of those with smaller draws; the arc goes from
    the start to `want` words on, and beyond the circle's end from its beginning.  A place is turned into the smallest draw from there on
    by the sums of ranges, and by the documents of the one range in which it lies.
    """
    name = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))
    start = portable_uniform(seed, F.concat(F.lit("start"), name)) * F.col("source_size")
    stop = start + F.col("want")
    wraps = (F.col("want") > 0) & (stop >= F.col("source_size"))
    per = staged(per.withColumns({"c0": start, "wraps": wraps, "c1": F.when(wraps, stop - F.col("source_size")).otherwise(stop)}), "circles")
    sums = drawn.groupBy("source", F.floor(F.col("mix_draw") * ranges).cast("int").alias("range")).agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("range")) - F.col("size")
    sums = sums.select(F.col("source").alias("_source"), "range", before.alias("before"))
    both = per.select("source", F.posexplode(F.array("c0", "c1")).alias("cut", "c"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    within = both.join(sums, same & (F.col("before") < F.col("c"))).groupBy("source", "cut", "c").agg(F.max(F.struct("range", "before")).alias("r"))
    within = staged(within.select(F.col("source").alias("_source"), "cut", "c", "r.range", "r.before"), "cuts")  # two rows for each source at most
    rows = drawn.join(_small(within), same & (F.floor(F.col("mix_draw") * ranges) == F.col("range")))
    steps = rows.groupBy("_source", "cut", "c", "range", "before", "mix_draw").agg(F.sum("size").alias("size"))
    place = F.col("before") + F.sum("size").over(Window.partitionBy("_source", "cut").orderBy("mix_draw")) - F.col("size")
    met = steps.withColumn("place", place).groupBy("_source", "cut").agg(F.min(F.when(F.col("place") >= F.col("c"), F.col("mix_draw"))).alias("draw"), ((F.max("range") + 1) / ranges).alias("beyond"))
    at = met.groupBy(F.col("_source")).agg(*[F.max(F.when(F.col("cut") == k, F.coalesce("draw", "beyond"))).alias(n) for k, n in enumerate(("begin", "end"))])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)  # noqa: E731  a place of 0 is before every range
    return per.join(at, same, "left").select("source", "source_size", "target", "times", "wraps", zero("begin"), zero("end"))


def rates(drawn: DataFrame, weights, share: float, cap: float, seed: int) -> DataFrame:
    """(source, source_size, target, times, wraps, begin, end) of every source: `times` copies of each document, one more of those on the arc."""
    count = drawn.count()
    per = source_targets(drawn.select("source", "size"), weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("times", F.floor(rate).cast("long")).withColumn("want", F.col("target") - F.col("times") * F.col("source_size"))
    return arcs(drawn, per, seed, 1 << max(RANGES, (count // MOST).bit_length()))


def _small(sources: DataFrame) -> DataFrame:
    """A table of one row for each source, to be broadcast if these are few enough."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


ADDED = ("size", "source_size", "target", "copies")
INNER = ("mix_draw", "mix_source", "times", "wraps", "begin", "end")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, and `copies`, the times that the mix emits it.

    Columns added to those of `docs` (all, or `keep`): size, source_size, target, copies (of these names, and of INNER, any that
    `docs` has already is left out).  A null text has size 0; null is a source of its own, after all others.  A document of a source
    without words gets no copies.  Rows equal in doc_id and text share their draw, so reruns and repeated rows agree; other
    rows without doc_id are drawn by their text.  Texts are read once, and again where they are kept.  No rows: no rows.
    """
    own = [c for c in (keep or docs.columns) if c.lower() not in {*ADDED, *INNER}]
    source = fresh_name(own, "mix_of")
    rows = draws(docs.select(*[F.col(f"`{c}`") for c in {*own, "doc_id", "text", "source"}]), seed).withColumns({"size": word_count(F.col("text")), source: F.col("source")})
    narrow = rows.select(source, "mix_draw", "size", *([] if "text" in own else [F.col(f"`{c}`") for c in own]))
    narrow = staged(narrow, "draws")
    if "text" not in own:
        rows = narrow
    per = _small(staged(rates(narrow.withColumnRenamed(source, "source").select("source", "mix_draw", "size"), weights, share, cap, seed).withColumnRenamed("source", "mix_source"), "rates"))
    joined = rows.join(per, F.col(source).eqNullSafe(F.col("mix_source")), "left")
    after, ahead = F.col("mix_draw") >= F.col("begin"), F.col("mix_draw") < F.col("end")
    extra = F.when(F.col("wraps"), after | ahead).otherwise(after & ahead)
    return joined.select(*[F.col(f"`{c}`") for c in own], "size", "source_size", "target", (F.col("times") + extra.cast("int")).cast("long").alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as its `copies` says, with the given columns."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias(fresh_name(columns, "mix_copy"))
    return mixed.filter(F.col("copies") > 0).select(*[F.col(f"`{c}`") for c in columns], times).select(*[F.col(f"`{c}`") for c in columns])
