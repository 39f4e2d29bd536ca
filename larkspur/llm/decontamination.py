"""Benchmark decontamination: prefix-filtered set join of item windows against document texts.

A window's tokens are its word shingles, ordered by how rare they are in all documents.  A document that holds the window holds all
of them, so a prefix of one, the rarest, is necessary: documents' shingles are joined with the windows' prefixes, each meeting
fixes where the window would start, its length and place are bounded, and the window is compared word by word.  Both
sides of the join are tables; what goes to every worker is a bitmap of fixed size that holds back shingles that no window has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, fresh_name, sliced, staged
from .wording import Spelled, bitmap, in_bitmap, spelled_column, words

ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: The bitmap of shingles has 2 ** BITS bits.
BITS = 27


def _windows(window: int):
    """(item_id, w, n): the windows of items, their words joined by spaces, and how many these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(text)
                found += [(item, b" ".join(tokens[at : at + window]), min(window, len(tokens))) for at in range(max(1, len(tokens) - window + 1) if tokens else 0)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["item_id", "w", "n"])

    return run


def _shingled(shingle: int):
    """(w, n, k, size, h): the shingles of windows (w, n), k words in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled, n = spelled_column(batch.column(0)), batch.column(1).to_numpy()
            for size in range(1, shingle + 1):
                h, at = spelled.shingles(size)
                text = spelled.text[at]
                some = np.minimum(n[text], shingle) == size
                h, at, text = h[some], at[some], text[some]
                rows = batch.take(pa.array(text))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at - spelled.head[text]), pa.array(np.full(len(at), size, np.int64)), pa.array(h.view(np.int64))], names=["w", "n", "k", "size", "h"])

    return run


def _held(spelled: Spelled, sizes: list[int], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first word) of the shingles that the bitmap may have."""
    for size in sizes:
        h, at = spelled.shingles(size)
        some = in_bitmap(known, h)
        yield h[some], at[some]


def _counted(sizes: list[int], known):
    """(h, m): how often shingles stand in each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            for h, _ in _held(spelled_column(batch.column(0)), sizes, known.value):
                h, m = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(m.astype(np.int64))], names=["h", "m"])

    return run


def _met(sizes: list[int], known, window: int):
    """(id, t, h, p, n_words, c, near): shingles of texts (id, t, text), at word p; near: the words around from c on, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            spelled = spelled_column(batch.column(2))
            for size, (h, at) in zip(sizes, _held(spelled, sizes, known.value), strict=True):
                text = spelled.text[at]
                p, n = at - spelled.head[text], spelled.count[text]
                c, stop = np.maximum(0, p - window + size), np.minimum(n, p + window)
                near = [spelled.joined(a, b) for a, b in zip((spelled.head[text] + c).tolist(), (spelled.head[text] + stop).tolist(), strict=True)]
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h.view(np.int64)), pa.array(p), pa.array(n), pa.array(c), pa.array(near, pa.binary())], names=["id", "t", "h", "p", "n_words", "c", "near"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the number of words in place of their last column, texts."""
    for batch in batches:
        counts = pa.array([len(words(t.as_py())) for t in batch.columns[-1]], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*batch.schema.names[:-1], "n_words"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, t, start, n, w): occurrences of windows in texts, and (item_id, w): which items have a window.

    A text is known by its doc_id and t, a hash of it; rows that repeat both give the same occurrences.
    """
    send = docs.sparkSession.sparkContext.broadcast
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    of = staged(items.mapInArrow(_windows(window), "item_id string, w binary, n long").distinct(), "windows")
    shingles = staged(of.select("w", "n").distinct().mapInArrow(_shingled(shingle), "w binary, n long, k long, size long, h long"), "shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # `shingle` at most
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text").filter(F.octet_length("text") > 0)
    counts = texts.select("text").mapInArrow(_counted(sizes, send(bitmap(shingles, BITS))), "h long, m long").groupBy("h").agg(F.sum("m").alias("m"))
    # A shingle that no document has leaves its windows without any.
    rarity = shingles.join(counts, "h", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    prefixes = rarity.groupBy("w", "n").agg(F.min(F.struct("m", "k", "h", "size")).alias("r")).filter("r.m > 0")
    prefixes = staged(prefixes.select("w", "n", "r.k", "r.h"), "prefixes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    met = texts.mapInArrow(_met(sizes, send(bitmap(prefixes, BITS)), window), f"id {kind}, t long, h long, p long, n_words long, c long, near binary")
    start = F.col("p") - F.col("k")
    there = F.array_join(F.slice(F.split(F.col("near").cast("string"), " "), (start - F.col("c") + 1).cast("int"), F.col("n").cast("int")), " ")
    fits = met.join(prefixes, "h").filter((start >= F.col("c")) & (start + F.col("n") <= F.col("n_words")))
    found = fits.filter(there == F.col("w").cast("string")).select("id", "t", start.alias("start"), "n", "w")
    return staged(found, "hits"), of.select("item_id", "w")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0).

    A document word is hit if it lies in an occurrence of a window of `window` consecutive item words (of the whole item,
    if that is shorter).  Null and empty texts have no words and no hits; items without words match nothing; items
    without id mark words but are not listed; items that repeat an id count once.  keep: columns of `docs` to return
    (all); those named like an added one are replaced.  An empty benchmark hits nothing.
    """
    if not 0 < shingle <= window:
        raise ValueError("a shingle has 1 to `window` words")
    found, of = hits(docs, benchmark, window, shingle)
    own = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    id_, t, spans, items, own_id, own_t = (fresh_name(docs.columns, c) for c in ("hit_id", "hit_t", "hit_spans", "hit_items", "own_id", "own_t"))
    key = [F.col("id").alias(id_), F.col("t").alias(t)]
    per = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias(spans))
    named = found.select("id", "t", "w").distinct().join(of.filter("item_id is not null"), "w").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias(items))
    same = F.col(f"s.{id_}").eqNullSafe(F.col(f"i.{id_}")) & (F.col(f"s.{t}") == F.col(f"i.{t}"))
    per = per.alias("s").join(named.alias("i"), same, "left").select(f"s.{id_}", f"s.{t}", spans, items)
    # Words in the union of a text's spans, which come in order.
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    union = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
    keyed = docs.withColumns({own_id: F.col("doc_id"), own_t: F.xxhash64("text")})
    rows = carried(keyed, [*own, own_id, own_t], [F.col("text")], _word_counts, [T.StructField("n_words", T.LongType())])
    out = rows.join(per, F.col(own_id).eqNullSafe(F.col(id_)) & (F.col(own_t) == F.col(t)), "left")
    n_hit = F.coalesce(union, F.lit(0)).cast("long")
    names = F.coalesce(items, F.array().cast("array<string>"))
    return out.select(*[F.col(f"`{c}`") for c in own], "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that hold no window of an item, all columns; see `decontaminate`."""
    found, _ = hits(docs, benchmark, **settings)
    id_, t = fresh_name(docs.columns, "_hit_id"), fresh_name(docs.columns, "_hit_t")
    texts = found.select(F.col("id").alias(id_), F.col("t").alias(t)).distinct()
    return docs.join(texts, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(t)), "left_anti")
