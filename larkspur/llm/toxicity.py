"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their beginnings is fitted in numpy on confirmed toxic texts and unlabelled
ones.  The risk is corrected for the class prior: what the positives hidden among the unlabelled add to the negative
risk is subtracted, and where the estimate of the negative risk falls below zero (overfitting) the step goes the other way.
Fitting uses bounded samples; every text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, staged

#: Most confirmed toxic and unlabelled texts that a fit takes, one of each doc_id (chosen by a hash of it; about, not exactly, so
#: many), and the most bytes of text of each kind: texts are taken in the order of that hash as far as they fit.
MOST_POSITIVE, MOST_UNLABELLED, MOST_BYTES = 3000, 9000, 24_000_000
FOLDS = 5
DRAWS = 1_000_000_000
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 8)
CACHED_WORDS = 400_000
#: The prior where no labelled row gives one, and the bounds it is held within.
PRIOR, PRIOR_BOUNDS = 0.1, (0.005, 0.5)
RIDGE = 0.35


def word_features(word: str) -> list[int]:
    """Features of a word, as signed 32-bit hashes: itself, and its beginnings of 4 to 7 letters."""
    parts = ["=" + word, *("^" + word[:k] for k in BEGINNINGS if k <= len(word))]
    return [(zlib.crc32(p.encode("utf-8", "replace")) ^ 0x80000000) - 0x80000000 for p in parts]


def features(text: str | None) -> list[int]:
    out: set[int] = set()
    for w in set(WORDS.findall(text.lower())) if text else ():
        out.update(word_features(w))
    return sorted(out)


@dataclass
class Sparse:
    """Rows of 0/1 features: `ids` of all rows one after the other, row i's from starts[i] on."""

    ids: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Sparse:
        return cls(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.ids], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, g[self.row], size)


def places(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, at, -1)


def select(ids: np.ndarray, toxic: np.ndarray, sizes: tuple[int, int], most: int = 4000, least: int = 3, noise: float = 5.0) -> np.ndarray:
    """Features more frequent among the positives: by the log ratio of document frequencies, in multiples of its noise.

    ids: features of all texts one after the other, toxic: whether they are of a positive one, sizes: how many texts there
    are of both kinds.  Works in pieces, so that it takes little more memory than `ids` itself.
    """
    keys, p = np.unique(ids[toxic], return_counts=True)
    keys, p = keys[p >= least], p[p >= least]
    u = np.zeros(len(keys), np.int64)
    for at in range(0, len(ids), 1 << 20):
        piece = ids[at : at + (1 << 20)][~toxic[at : at + (1 << 20)]]
        found = places(keys, piece)
        u += np.bincount(found[found >= 0], minlength=len(keys))
    a, b = (p + 0.5) / (sizes[0] + 1), (u + 0.5) / (sizes[1] + 1)
    z = (np.log(a) - np.log(b)) / np.sqrt(1 / (p + 0.5) + 1 / (u + 0.5))
    some = np.flatnonzero(z > noise)
    return np.sort(keys[some[np.lexsort((keys[some], -z[some]))][:most]])


def nnpu_fit(p: Sparse, u: Sparse, size: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, float, list[float]]:
    """Weights, intercept and the negative risks: Adam on the non-negative risk estimator with logistic loss."""
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, risks = np.zeros(size + 1), np.zeros(size + 1), []
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        fp, fu = p.times(w) + b, u.times(w) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        risks.append(float(negative))
        gu, gp = sigmoid(fu) / u.n, prior * sigmoid(fp) / p.n  # of the negative risk: its part over the unlabelled less that over the positives
        if negative >= 0:
            ru, rp = gu, -prior * sigmoid(-fp) / p.n - gp
        else:
            ru, rp = -gu, gp
        g = np.append(u.back(ru, size) + p.back(rp, size) + ridge * w, ru.sum() + rp.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b), risks


@dataclass
class Model:
    """Weights of the selected features, and the intercept."""

    weights: dict[int, float]
    intercept: float
    prior: float

    def scorer(self):
        """A function from texts to scores in [0, 1]; it remembers the words it has seen, up to CACHED_WORDS."""
        weights, known = self.weights, {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in set(WORDS.findall(text.lower())) if text else ():
                got = known.get(w)
                if got is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    got = known[w] = tuple(f for f in word_features(w) if f in weights)
                if got:
                    found.update(got)
            z = self.intercept + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

        return score


def held_out(docs: DataFrame):
    """Whether a row is held out of learning: crc32 of doc_id as text leaves 0 modulo FOLDS (a null id counts as empty)."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], names=["y", "ids"])


def drawn(df: DataFrame):
    """The place of a row's doc_id in the order in which rows are sampled, below DRAWS."""
    return F.pmod(F.xxhash64(F.lit(2), df["doc_id"]), F.lit(DRAWS))


def fitting(rows: list, most: int) -> list:
    """Of rows (doc_id, y, draw, size) those that are taken in order of draw, for each y as far as they fit in `most` bytes."""
    left = {0: most, 1: most}
    out = []
    for r in sorted(rows, key=lambda r: (r.draw, str(r.doc_id))):
        if r.size <= left[r.y]:
            left[r.y] -= r.size
            out.append(r)
    return out


def sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int, most_bytes: int) -> tuple[DataFrame, float]:
    """(y, text) of what a fit learns from, and the prior; see `fit`."""
    labels = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.filter(~held_out(labels))
    told = labels.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    prior = float(np.clip(told.k / told.n if told.n else PRIOR, *PRIOR_BOUNDS))

    def share(part: int, whole: int) -> int:
        return DRAWS if whole <= part else part * DRAWS // whole

    ids = labels.filter("toxic = 1")
    ids = ids.filter(drawn(ids) < share(most_positive, told.k or 0)).select("doc_id", F.lit(1).alias("y"))
    # Texts are drawn by id, so rows that repeat one count once.
    some = docs.select("doc_id").dropna()
    some = some.filter(~held_out(some)).distinct()
    few = some.filter(drawn(some) < share(most_unlabelled, some.count()))
    # About most_positive + most_unlabelled different ids, so they can be broadcast.
    chosen = ids.unionByName(few.select("doc_id", F.lit(0).alias("y"))).select(F.col("doc_id").alias("_id"), "y")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    picked = staged(picked, "sample")
    sizes = picked.select("doc_id", "y", drawn(picked).alias("draw"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()  # a row for each of these ids
    taken = fitting(sizes, most_bytes)
    if len(taken) < len(sizes):
        spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
        own = spark.createDataFrame([(r.doc_id, r.y) for r in taken], f"doc_id {kind}, y int")
        picked = picked.join(F.broadcast(own), ["doc_id", "y"], "left_semi")
    return picked.select("y", "text"), prior


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_bytes: int = MOST_BYTES) -> Model:
    """A model from rows that are not held out: toxic ones as positives, a sample of all of them, whatever their label, as unlabelled text.

    The unlabelled text is what the prior speaks of: of all rows, the share of toxic among labelled ones is toxic.  Only that
    share and whether a row is toxic are learned from labels.  Null labels count as none; of several labels for an id the
    largest counts, and of several texts of an id one.  The ridge is RIDGE over the number of positives, as that of a prior
    on weights.  Without any positive or unlabelled text the model has no weights and scores every text with the prior.
    """
    picked, prior = sample(docs, labels, most_positive, most_unlabelled, most_bytes)
    got = picked.mapInArrow(_featured, "y int, ids array<int>").toArrow()
    y = np.asarray(got["y"]).astype(int)
    column = got["ids"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    ids, lengths = np.asarray(column.flatten()), np.asarray(column.value_lengths(), np.int64)
    model = Model({}, float(np.log(prior / (1 - prior))), prior)
    if 0 < y.sum() < len(y):
        kept = select(ids, np.repeat(y == 1, lengths), (int(y.sum()), int((y == 0).sum())))
        rows, ends = [], np.cumsum(lengths)
        for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
            found = places(kept, ids[end - n : end])
            rows.append(found[found >= 0])
        order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))  # the order of rows mustn't matter
        positive, unlabelled = (Sparse.of([rows[i] for i in order if y[i] == k]) for k in (1, 0))
        w, b, _ = nnpu_fit(positive, unlabelled, len(kept), prior, ridge=RIDGE / positive.n)
        model = Model(dict(zip(kept.tolist(), w.tolist(), strict=True)), b, prior)
    del got, column, ids
    pa.default_memory_pool().release_unused()
    return model


def _scored(model, own: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            got = pa.array([score(t) for t in batch.column(own).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], got], names=[*batch.schema.names[:own], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns of `docs` (all, or `keep`) and score, from 0 to 1, of every row's text.

    Null and empty texts get the score of a text without features; repeated rows the same score.  A column of `docs` named
    score is replaced.  No rows: no rows.
    """
    own = [c for c in (keep or docs.columns) if c.lower() != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    return carried(docs, own, [F.col("text")], _scored(sent, len(own)), [T.StructField("score", T.DoubleType())])
