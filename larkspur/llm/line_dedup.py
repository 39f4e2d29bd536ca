"""Line dedup: a sharded minimal perfect hash over the hashes of repeated lines, with arrays that documents probe.

Lines are known by 128 bits of their normalised form.  Spark counts the documents of each; those in enough documents are
dealt by their hash into shards, and each shard gets a minimal perfect hash: rounds of bit arrays in which a hash alone at
its place stays and the others go on to the next round.  Its rank there is the hash's place in three arrays of one entry a
hash: a fingerprint (the half of the 128 bits that does not choose the shard), the count of documents, and the document
that keeps its lines.  No text of a line is ever shuffled.  Arrays of MOST_SENT bytes at most go to every worker, where each
text is probed as it is read; larger ones meet the probes shard by shard.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, carried, sliced, staged
from .wording import mix

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that go on with a code point.
CONTINUED = bytes(range(0x80, 0xC0))
#: Hashes of a shard (about), places for each hash in a round, probes of a group (about) and bytes of arrays that every worker may get.
SHARD, ROOM, PROBES, MOST_SENT = 1 << 15, 1.6, 1 << 18, 64 << 20
#: Bytes of the index for each hash, places and ranks included.
A_HASH = 22
ADDED = ("n_lines", "n_dropped", "kept")
INDEX = "shard long, rounds binary, places binary, prints binary, counts binary, keepers binary"


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; none if that has fewer than `least` code points."""
    key = line.strip(SPACES).lower()
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.translate(None, CONTINUED)) < least:
        return None
    return key


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two columns of 64 bits for each key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)


def _texts(column: pa.Array) -> list[bytes]:
    data, start, end = buffers(column)
    return [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _lines(least: int) -> Callable:
    """(d, h, f): of each text the digests of its lines, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys, counts = [], []
            for text in _texts(batch.column(1)):
                own = {k for k in (key_of(line, least) for line in text.split(b"\n")) if k is not None}
                keys += own
                counts.append(len(own))
            two = _digests(keys).view(np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["d", "h", "f"])

    return run


def coded(df: DataFrame, name: str) -> Column:
    """A whole number for each id: the id itself where it is one, else a hash of it; null stays null."""
    whole = isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return F.col(name).cast("long") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))


def repeated(docs: DataFrame, least_docs: int, least_chars: int) -> DataFrame:
    """(h, f, n, keeper): of each line in `least_docs` documents or more its digest, how many and the code of the largest id."""
    held = docs.select(F.col("doc_id").alias("d"), "text").mapInArrow(_lines(least_chars), T.StructType([T.StructField("d", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("f", T.LongType())]))
    known = held.distinct().groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).filter((F.col("n") >= least_docs) & F.col("d").isNotNull())
    return known.select("h", "f", "n", coded(known, "d").alias("keeper"))


def _place(h: np.ndarray, f: np.ndarray, turn: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """Where hashes go in a round with `size` places (under 2 ** 32)."""
    step = np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return ((mix(h ^ mix(f + step)) >> np.uint64(32)) * size) >> np.uint64(32)


def built(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each round, the rounds' bits, the place of each hash) of a minimal perfect hash of different hashes."""
    left, sizes, bits, placed = np.arange(len(h)), [], [], np.zeros(len(h), np.int64)
    before = 0
    while len(left):
        size = 64 * max(1, -(-int(len(left) * ROOM) // 64))
        at = _place(h[left], f[left], len(sizes), np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        placed[left[stays]] = before + (np.cumsum(alone) - 1)[at[stays]]
        before += int(alone.sum())
        sizes.append(size // 64)
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~stays]
    return np.array(sizes, np.int64), np.concatenate([*bits, np.empty(0, np.uint64)]), placed


def _build(rows: pa.Table) -> pa.Table:
    """One row of INDEX from the repeated lines of a shard."""
    h, f, n, keeper = (np.asarray(rows[c]) for c in ("h", "f", "n", "keeper"))
    sizes, bits, place = built(h.view(np.uint64), f.view(np.uint64))
    order = np.argsort(place)
    parts = [sizes, bits, f[order], n[order].clip(max=(1 << 32) - 1).astype(np.uint32), keeper[order]]
    return pa.Table.from_arrays([rows["shard"][:1], *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["shard", "rounds", "places", "prints", "counts", "keepers"])


class Index:
    """Shards of an index side by side; `shards` are their numbers in order."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[0])
        take = lambda k, kind: [np.frombuffer(r[k], kind) for r in rows]
        flat = lambda k, kind: np.concatenate([*take(k, kind), np.empty(0, kind)])
        rounds = take(1, np.int64)
        self.shards = np.array([r[0] for r in rows], np.int64)
        self.words = np.zeros((len(rows), max((len(x) for x in rounds), default=0)), np.int64)
        for k, x in enumerate(rounds):
            self.words[k, : len(x)] = x
        first = np.concatenate([[0], np.cumsum(self.words.ravel())[:-1]]) if self.words.size else np.empty(0, np.int64)
        self.first = first.reshape(self.words.shape)
        self.bits = flat(2, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])
        self.prints, self.counts, self.keepers = flat(3, np.int64), flat(4, np.uint32), flat(5, np.int64)

    def find(self, shard: np.ndarray, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The place in the arrays of each digest (h, f), -1 if the index has no such one."""
        out = np.full(len(h), -1, np.int64)
        own = np.searchsorted(self.shards, shard)
        open_ = np.flatnonzero(own < len(self.shards))
        open_ = open_[self.shards[own[open_]] == shard[open_]]
        for turn in range(self.words.shape[1]):
            size = self.words[own[open_], turn]
            open_, size = open_[size > 0], size[size > 0]
            at = _place(h[open_], f[open_], turn, size.astype(np.uint64) << np.uint64(6))
            word = self.first[own[open_], turn] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            there = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            place = self.rank[word] + np.bitwise_count(below).astype(np.int64)
            out[open_[there]] = place[there]
            open_ = open_[~there]
        known = np.flatnonzero(out >= 0)
        out[known[self.prints[out[known]] != f[known].view(np.int64)]] = -1
        return out

    def drops(self, shard: np.ndarray, h: np.ndarray, f: np.ndarray, code: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Which of the digests, found in documents of these codes, go there; documents without id (not `named`) keep no line."""
        place = self.find(shard, h, f)
        known = np.flatnonzero(place >= 0)
        gone = np.zeros(len(h), bool)
        gone[known] = ~named[known] | (self.keepers[place[known]] != code[known])
        return gone


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _split(texts: list[bytes], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, row and line number of each line that has a key, the keys' digests)."""
    lines, rows, numbers, keys = [], [], [], []
    for i, text in enumerate(texts):
        own = text.split(b"\n")
        lines.append(own)
        for k, line in enumerate(own):
            key = key_of(line, least)
            if key is not None:
                rows.append(i)
                numbers.append(k)
                keys.append(key)
    return lines, np.array(rows, np.int64), np.array(numbers, np.int64), _digests(keys)


def _answer(batch: pa.RecordBatch, keep: int, texts: list[bytes], lines: list[list[bytes]], rows: np.ndarray, numbers: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """The first `keep` columns of a batch and ADDED."""
    dropped = np.bincount(rows[gone], minlength=len(texts))
    out: dict[int, set[int]] = {}
    for i, k in zip(rows[gone].tolist(), numbers[gone].tolist(), strict=True):
        out.setdefault(i, set()).add(k)
    kept = [b"\n".join([x for k, x in enumerate(lines[i]) if k not in out[i]]) if i in out else t for i, t in enumerate(texts)]
    added = [pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)]
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], *added], names=[*batch.schema.names[:keep], *ADDED])


def _probed(index, bits: int, least: int) -> Callable:
    """Batches with the text and the id's code as their last columns, answered from arrays that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(index.value)
        for whole in batches:
            for batch in sliced([whole], whole.num_columns - 2):
                texts = _texts(batch.column(batch.num_columns - 2))
                lines, rows, numbers, two = _split(texts, least)
                code = batch.column(batch.num_columns - 1)
                named = np.asarray(code.is_valid())
                codes = np.asarray(code.fill_null(0))
                gone = known.drops(_shard(two[:, 0], bits), two[:, 0], two[:, 1], codes[rows], named[rows])
                yield _answer(batch, batch.num_columns - 2, texts, lines, rows, numbers, gone)

    return run


def _probes(least: int) -> Callable:
    """(k, t, code, h, f): each digest of a document once; the document is k and t, hashes of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            _, rows, _, two = _split(_texts(batch.column(3)), least)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(two[:, 0].view(np.int64)), pa.array(two[:, 1].view(np.int64))], names=["k", "t", "code", "h", "f"])

    return run


def _meet(key: tuple, probes: pa.Table, index: pa.Table) -> pa.Table:
    """The probes of a part of a shard that are to go."""
    known = Index([tuple(r.values()) for r in index.select(["shard", "rounds", "places", "prints", "counts", "keepers"]).to_pylist()])
    h, f = (np.asarray(probes[c]).view(np.uint64) for c in ("h", "f"))
    code = probes["code"].combine_chunks()
    gone = known.drops(np.full(len(h), key[0].as_py()), h, f, np.asarray(code.fill_null(0)), np.asarray(code.is_valid()))
    return probes.select(["k", "t", "h", "f"]).filter(pa.array(gone))


def _cut(least: int) -> Callable:
    """Batches with the text and the digests to drop as their last columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], whole.num_columns - 2):
                texts = _texts(batch.column(batch.num_columns - 2))
                lines, rows, numbers, two = _split(texts, least)
                lists = [{(x["h"], x["f"]) for x in g or ()} for g in batch.column(batch.num_columns - 1).to_pylist()]
                pairs = two.view(np.int64).tolist()
                gone = np.array([tuple(p) in lists[i] for i, p in zip(rows.tolist(), pairs, strict=True)], bool)
                yield _answer(batch, batch.num_columns - 2, texts, lines, rows, numbers, gone)

    return run


def indexed(lines: DataFrame) -> tuple[DataFrame, int, int]:
    """(the index of `lines`, a staged table; how many bits of h choose the shard; how many lines it holds)."""
    count = lines.count()
    bits = max(1, (count // SHARD).bit_length())
    rows = lines.withColumn("shard", F.shiftrightunsigned("h", 64 - bits))
    return staged(rows.groupBy("shard").applyInArrow(_build, INDEX), "line-index"), bits, count


def _by_shard(docs: DataFrame, index: DataFrame, bits: int, least: int) -> DataFrame:
    """(k, t, gone): of each document the digests that go, from arrays that meet its probes shard by shard.

    Probes of a shard are split by their documents into parts of about PROBES, and the shard's row goes to every part.
    """
    rows = docs.select("k", "t", "code", "text").mapInArrow(_probes(least), "k long, t long, code long, h long, f long").distinct()
    rows = staged(rows.withColumn("shard", F.shiftrightunsigned("h", 64 - bits)), "probes")
    parts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("parts"))
    parts = staged(parts, "parts")  # one row for each shard
    again = docs.sparkSession.read.schema(parts.schema).parquet(parts.staged_path)
    wide = index.join(again, "shard").select(*index.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = rows.join(parts, "shard").select(*rows.columns, F.pmod(F.xxhash64("k", "h"), F.col("parts")).cast("int").alias("part"))
    gone = dealt.groupBy("shard", "part").cogroup(wide.groupBy("shard", "part")).applyInArrow(_meet, "k long, t long, h long, f long")
    return gone.groupBy("k", "t").agg(F.collect_list(F.struct("h", "f")).alias("gone"))


def drop_repeated(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, keep: list[str] | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """Every row of `docs` with n_lines (before dropping), n_dropped and kept, the lines that stay joined by line feeds.

    A text is split at line feeds; null and empty texts are one empty line, and their `kept` is empty.  A line's key is the
    line without ASCII white space at both ends, A-Z in lower case.  Keys of `least_chars` code points or more that
    `least_docs` documents or more have lose all their lines, but in the largest doc_id that has them.  Rows of one doc_id
    are one document; rows without doc_id are one document together, smaller than all others.  Keys are compared by 128 bits of a
    hash.  keep: columns of `docs` to return (all); those named like an added one are left out.  No rows: no rows.
    """
    index, bits, count = indexed(staged(repeated(docs, least_docs, least_chars), "repeated-lines"))
    own = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    if count * A_HASH <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in index.collect()])
        return carried(docs, own, [F.col("text"), coded(docs, "doc_id")], _probed(sent, bits, least_chars), added)
    row = [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "text", "doc_id").alias("t")]
    gone = _by_shard(docs.select(*row, coded(docs, "doc_id").alias("code"), "text"), index, bits, least_chars)
    names = [f"c{i}" for i in range(len(own))]
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)], F.col("text").alias("own_text"), *row)
    met = wide.join(gone, ["k", "t"], "left").select(*names, F.col("own_text").alias("text"), "gone")
    out = carried(met, names, [F.col("text"), F.col("gone")], _cut(least_chars), added)
    return out.select(*[F.col(n).alias(c) for c, n in zip(own, names, strict=True)], *ADDED)
