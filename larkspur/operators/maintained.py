"""Aggregates of the review that are kept beside the tables and follow the marks by signed deltas.

The stored table has a row for each group: members, members without mark, and how many and how many bytes wait to be discarded.
A batch of decisions adds what the changed paths count after it and takes away what they counted before, so its cost is
that of the batch, whatever the marks' size.  Marked paths outside of any group are counted under a null group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

COUNTS = ("n", "open", "kept", "trashed", "pend_n", "pend_bytes")


def _counted(members: DataFrame, files: DataFrame, marks: DataFrame, sign: int) -> DataFrame:
    """(group_id and COUNTS) of members (group_id, path) and of marks without group, times `sign`, not summed up yet."""
    rows = members.select("group_id", "path", F.lit(1).alias("member")).join(marks.select("path", "mark", "used_batch"), "path", "full_outer")
    rows = rows.join(files.select("path", "size"), "path", "left")
    waits = F.col("mark").isin("discard", "trash") & F.col("used_batch").isNull() & F.col("size").isNotNull()
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    inside = F.col("member").isNotNull()
    each = {"n": flag(inside), "open": flag(inside & F.col("mark").isNull()), "kept": flag(inside & (F.col("mark") == "keep")), "trashed": flag(inside & (F.col("mark") == "trash")), "pend_n": flag(waits), "pend_bytes": F.when(waits, F.col("size")).otherwise(0).cast("long")}
    return rows.select("group_id", *[(c * sign).alias(n) for n, c in each.items()])


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("group_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return out.filter(" or ".join(f"{c} != 0" for c in COUNTS))


def counted(grouped: DataFrame, files: DataFrame, marks: DataFrame) -> DataFrame:
    """The stored table, computed from all rows.  A path has one mark at most and is in one group at most."""
    return _summed(_counted(grouped, files, marks, 1))


def delta(grouped: DataFrame, files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch adds to the stored table: `before` and `after` are the marks of the paths that it touches, and only these.

    A path that has a mark in just one of both has got it or lost it.  Members of groups are looked up by these paths.
    """
    touched = before.select("path").union(after.select("path")).distinct()
    members = grouped.select("group_id", "path").join(touched, "path", "left_semi")
    own = files.select("path", "size").join(touched, "path", "left_semi")
    return _summed(_counted(members, own, before, -1).unionByName(_counted(members, own, after, 1)))


def applied(stored: DataFrame, change: DataFrame) -> DataFrame:
    """The stored table after a delta; groups that count nothing any more are gone."""
    return _summed(stored.unionByName(change))


def totals(stored: DataFrame) -> DataFrame:
    """(pend_n, pend_bytes, total, done, left, pct) of the review, as `similar.review_totals` computes them from all marks."""
    group = F.col("group_id").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = stored.agg(zero(F.sum("pend_n")).alias("pend_n"), zero(F.sum("pend_bytes")).alias("pend_bytes"), F.count_if(group).alias("total"), F.count_if(group & (F.col("open") == 0)).alias("done"))
    return out.select("*", (F.col("total") - F.col("done")).alias("left"), X.percent(F.col("done"), F.col("total")).alias("pct"))


def decided(stored: DataFrame) -> DataFrame:
    """(group_id, state): all (every member kept), trash, decided otherwise, or open."""
    state = F.when(F.col("kept") == F.col("n"), "all").when(F.col("trashed") == F.col("n"), "trash").when(F.col("open") == 0, "decided").otherwise("open")
    return stored.filter("group_id is not null").select("group_id", state.alias("state"))
