"""Connected components of links between 64-bit keys, in Spark, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.staging import staged, unstage


#: Links that one task takes.
AT_ONCE = 1_000_000


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component among 0 .. n - 1, for links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars: as many links as keys at most, with the same components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_labels(len(keys), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[label[moved]])], names=["a", "b"])


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) from all links together."""
    rows = list(batches)
    a, b = (np.concatenate([r.column(k).to_numpy() for r in rows]) if rows else np.empty(0, np.int64) for k in (0, 1))
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(keys), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[label])], names=["key", "root"])


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key that has a link, from `links` (a long, b long); root is the smallest key reachable.

    Links that are AT_ONCE at most, at first or after some steps, are a few megabytes and one task's work.  More of them
    take large-star and small-star steps in turns until nothing changes.  Minimums are aggregated before the shuffle and staged, so
    that the join which hands them back has nothing but its two shuffles below it: adaptive execution splits it where a key is hot.  Self-links and
    repeated links are allowed; null keys are dropped with their links.  No links: no rows.
    """
    schema = "a long, b long"
    links = links.select("a", "b").dropna().filter("a != b").mapInArrow(_contract, schema)
    links = staged(links.distinct(), "links")
    last = None
    while True:
        if links.count() <= AT_ONCE:
            return staged(links.coalesce(1).mapInArrow(_at_once, "key long, root long"), "roots")
        # Large star: every neighbour above u hangs on u's smallest neighbour.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and every neighbour below it hang on the smallest of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        down = staged(down, "down")
        lower = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = down.join(lower, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = staged(hung.union(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(links, least, down, lower)
        if seen == last:
            return small.select(F.col("a").alias("key"), F.col("b").alias("root")).union(small.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
        links, last = small, seen
