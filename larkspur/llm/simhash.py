"""SimHash near-dedup: pigeonhole blocks, join on blocks, verify the Hamming distance, connect.

Equal fingerprints are collapsed first.  Each distinct one is dealt out under every choice of `kept` of the `blocks` blocks:
a pair that differs in at most `distance` bits agrees in the bits of one such choice at least.  In a bucket every pair is
compared, but only one link per fingerprint is emitted, to the smallest it hangs together with there.  Buckets that sampling shows
to be crowded are split into chunks, and every pair of chunks is a bucket of its own; the result is the same.

`alike` finds classes of texts by the similarity of their shingles, exactly: sets that are similar enough share one of their first
shingles, in any order that all texts keep, so pairs are looked for below these and confirmed by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.graph import components, local_labels

from .common import ASCII_LOWER, fresh_name, staged, unstage
from .wording import bitmap, in_bitmap

#: Buckets expected to hold more than CROWDED fingerprints are split into chunks of about CROWDED / 2.
CROWDED, SAMPLE = 4096, 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: the majority of each bit over XXH64 of all word shingles, repeats included.

    A-Z are lower-cased; fewer words than a shingle make one shingle; no words (null, empty, blank): 0.
    """
    tokens = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
    if not tokens:
        return 0
    k, joined = min(words, len(tokens)), b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a long text takes no more memory than this many shingles
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def layout(count: int, distance: int) -> tuple[int, int]:
    """(blocks, kept): the fewest blocks for which a fingerprint meets few others by chance, at this many of them."""
    for blocks in range(distance + 2, 17):
        kept = blocks - distance
        if count * comb(blocks, kept) / 2 ** (64 * kept / blocks) <= 64 or blocks == 16:
            return blocks, kept


def masks(blocks: int, kept: int) -> list[int]:
    """Signed masks of the kept bits, one for every choice of blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    whole = [sum(block[i] for i in pick) for pick in combinations(range(blocks), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def bucket_links(bucket: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal, adjacent buckets: each to the smallest index it hangs together with."""
    n, left, right = len(prints), [], []
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.array([], int)
    sizes = np.diff(np.append(starts, n))
    step, few = 1, sizes[sizes <= 32].max(initial=0)
    small = np.repeat(sizes <= 32, sizes)
    while step < few:
        i = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[:-step])
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= distance]
        left.append(i)
        right.append(i + step)
        step += 1
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        own = prints[start : start + size]
        label = np.arange(size)
        rows = max(1, (1 << 20) // size)
        for at in range(0, size, rows):
            a, b = np.nonzero(np.bitwise_count(own[at : at + rows, None] ^ own[None, :]) <= distance)
            up = (b < a + at) & (label[a + at] != label[b])
            label = local_labels(size, np.concatenate([np.arange(size), a[up] + at]), np.concatenate([label, b[up]]))
        moved = np.flatnonzero(label != np.arange(size))
        left.append(label[moved] + start)
        right.append(moved + start)
    a, b = (np.concatenate(x) if x else np.array([], int) for x in (left, right))
    label = local_labels(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _bucketed(distance: int):
    """Links from batches sorted by bucket; the last bucket of a batch is held until it is whole."""

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(columns[0]), bool)
        for c in columns[:-1]:
            change[1:] |= c[1:] != c[:-1]
        prints = columns[-1].view(np.uint64)
        a, b = bucket_links(np.cumsum(change), prints, distance)
        return pa.RecordBatch.from_arrays([pa.array(columns[-1][a]), pa.array(columns[-1][b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            same = np.ones(batch.num_rows, bool)
            for c in new[:-1]:
                same &= c == c[-1]
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or (held and any(h[-1] != c[0] for h, c in zip(held[-1][:-1], new[:-1], strict=True))):
                head = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in new], strict=True)]
                if len(head[0]):
                    yield links(head)
                held = []
            held.append([c[cut:] for c in new])
        if held:
            yield links([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints `prints` (fp long) within `distance` bits: each bucket's as stars.

    Every pair within the distance is connected through such links, though not every pair is one.
    """
    spread = masks(*layout(prints.count(), distance))
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in spread])).alias("pick", "bits")
    dealt = prints.select("fp", keys)
    sampled = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).select("fp", keys)
    hot = sampled.groupBy("pick", "bits").count().filter(F.col("count") > CROWDED // SAMPLE)
    hot = staged(hot.select("pick", "bits", F.ceil(F.col("count") * SAMPLE * 2 / CROWDED).cast("int").alias("chunks")), "crowded")
    if hot.isEmpty():
        dealt = dealt.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    else:
        # Every fingerprint of a crowded bucket goes to all pairs of chunks that hold its own chunk.
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(3)), F.col("chunks")).cast("int")
        pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        dealt = dealt.join(hot, ["pick", "bits"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(pairs))
        dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    sorted_ = dealt.select("pick", "bits", "lo", "hi", "fp").repartition("pick", "bits", "lo", "hi").sortWithinPartitions("pick", "bits", "lo", "hi")
    return sorted_.mapInArrow(_bucketed(distance), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `distance` bits.  Texts without words have
    fingerprint 0 and are linked like any other.  doc_id may be of any type that has an order.  Repeated rows stay repeated; a null doc_id is never a component_id
    unless its component has no other.  Other columns are ignored.  No rows: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(docs.select("doc_id", "text").mapInArrow(_fingerprints(words, seed), f"doc_id {kind}, fp long"), "prints")
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    unique = staged(unique, "unique")
    roots = components(links(unique.select("fp"), distance)).select(F.col("key").alias("fp"), "root")
    rooted = unique.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Staged, so that the join has nothing but its shuffles below it, which adaptive execution splits where a component is large.
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(known, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Words of a set's parities that go along to the buckets: two sets differ in as many shingles at least as in parities.
NEAR = 2
#: Links are made one by one in buckets of up to WIDE; chunks of crowded ones have up to MOST shingles in a pair.
WIDE, MOST = 64, 1 << 22
#: Shingles in OFTEN of the texts of a sample, one of EVERY, come last in the order; the bitmap of them has 2 ** BITS bits.
EVERY, OFTEN, BITS = 16, 4, 24


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The different shingles' XXH64, sorted; A-Z are lower-cased, fewer words than a shingle make one, no words none."""
    tokens = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    k, joined = min(words, len(tokens)), b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: len(tokens) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """NEAR words: of each bit whether an odd number of the hashes falls to it."""
    counts = np.bincount((hashes & np.uint64(64 * NEAR - 1)).astype(np.int64), minlength=64 * NEAR)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities as `parities` has them, of two to four bits a hash; those of fewer bits are the longer ones folded."""
    bits = max(64 * NEAR, 2 << max(0, len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many parities two sketches differ, the longer one folded to the length of the other."""
    a, b = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], names=["h"])

    return run


def _firsts(words: int, least: float, often):
    """(doc_id, t, s0, s1, n, p0, ..., w, f): a digest of the set, its size, its parities, its sketch and its first shingles.

    The order is by the hash, shingles of the bitmap last.  Sets of a similarity of `least` share so many shingles that their first
    common one is among these of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, prints, sketches, firsts = [], [], [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py(), words)
                late = in_bitmap(often.value, h)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                sizes.append(len(h))
                prints.append(parities(h))
                sketches.append(sketch(h))
                firsts.append(np.concatenate([h[~late], h[late]])[: len(h) - int(np.ceil(least * len(h) - 1e-6)) + 1].view(np.int64))
            columns = [np.array(digests, np.int64).reshape(-1, 2), np.array(prints, np.uint64).view(np.int64).reshape(-1, NEAR)]
            flat = pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), flat)
            numbers = [pa.array(np.ascontiguousarray(c[:, k])) for c in columns for k in range(c.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers[:2], pa.array(sizes, pa.int64()), *numbers[2:], pa.array(sketches, pa.binary()), lists], names=["doc_id", "t", "s0", "s1", "n", *(f"p{k}" for k in range(NEAR)), "w", "f"])

    return run


def _by_bucket(place: int, f):
    """`f` of batches sorted by their first `place` columns; the last bucket of a batch is held until it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            same = np.all([(x := np.asarray(rows.column(c))) == x[-1] for c in range(place)], axis=0)
            cut = rows.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield f(rows.slice(0, cut), _numbered(rows.slice(0, cut), place))
            held = rows.slice(cut)
        if held is not None:
            yield f(held, _numbered(held, place))

    return run


def _numbered(rows: pa.RecordBatch, place: int) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], np.any([np.diff(np.asarray(rows.column(c))) != 0 for c in range(place)], axis=0)]))


def _again(rows: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
    """The rows of buckets that hold more than one."""
    return rows.filter(pa.array(np.bincount(bucket)[bucket] > 1))


def apart(prints: np.ndarray, i, j) -> np.ndarray:
    return sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in np.ascontiguousarray(prints.T))


def forest(bucket: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits apart): of all pairs up to `most` apart in equal, adjacent buckets a spanning forest of the closest."""

    def near(i, j):
        d = apart(prints, i, j)
        return d <= most, d

    return spanning(bucket, near)


def starts_sizes(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[: len(bucket)]
    return starts, np.diff(np.append(starts, len(bucket)))


def small_pairs(bucket: np.ndarray, near, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): all pairs that are near in equal, adjacent buckets of up to `most` rows."""
    sizes = starts_sizes(bucket)[1]
    small, out = np.repeat(sizes <= most, sizes), [(np.empty(0, np.int64),) * 3]
    for step in range(1, int(sizes[sizes <= most].max(initial=0))):
        i = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[:-step])
        ok, d = near(i, i + step)
        out.append((i[ok], i[ok] + step, d[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning(bucket: np.ndarray, near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): a spanning forest of the closest of all pairs in equal, adjacent buckets that are near; near(i, j) is (whether, d).

    In turns, each tree takes the closest link to another one (of equals that with the smallest places).
    """
    n = len(bucket)
    starts, sizes = starts_sizes(bucket)
    left, right, d = small_pairs(bucket, near, 64)
    wide = [(int(s), int(s + z), np.arange(s, s + z)) for s, z in zip(starts[sizes > 64], sizes[sizes > 64], strict=True)]
    label, out = np.arange(n), [(np.empty(0, np.int64),) * 3]
    while True:
        open_ = label[left] != label[right]
        left, right, d = left[open_], right[open_], d[open_]
        links, still = [(left, right, d)], []
        for a, b, rows in wide:  # the closest of another tree for each, as all pairs are too many to be kept
            trees, count = np.unique(label[a:b], return_counts=True)
            largest = label[rows] == trees[count.argmax()]  # the other trees link to it; a row that finds none never will
            left_out, rows, j, found = rows[largest], rows[~largest], np.arange(a, b), []
            for i in np.split(rows, range(step := max(1, (1 << 20) // (b - a)), len(rows), step)):
                ok, far = near(i[:, None], j[None, :])
                far = np.where(ok & (label[i, None] != label[None, a:b]), far, 1 << 40)
                best = far.argmin(axis=1)
                nearest = far[np.arange(len(i)), best]
                some = nearest < 1 << 40
                x, y = i[some], best[some] + a
                links.append((np.minimum(x, y), np.maximum(x, y), nearest[some]))
                found.append(x)
            if sum(map(len, found)):
                still.append((a, b, np.concatenate([left_out, *found])))
        wide = still
        i, j, e = (np.concatenate(x) for x in zip(*links, strict=True))
        if not len(i):
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))
        tree, order = np.concatenate([label[i], label[j]]), np.lexsort((np.tile(j, 2), np.tile(i, 2), np.tile(e, 2), np.concatenate([label[i], label[j]])))
        first = order[np.flatnonzero(np.concatenate([[True], tree[order][1:] != tree[order][:-1]]))] % len(i)
        first = np.unique(first)
        out.append((i[first], j[first], e[first]))
        label = local_labels(n, np.concatenate([np.arange(n), i[first]]), np.concatenate([label, j[first]]))


def fitting(n: np.ndarray, at: np.ndarray, prints: np.ndarray, least: float, label: np.ndarray | None = None):
    """near(i, j) of sets of sizes n with a bucket's shingle at their places `at`: whether they may be of a similarity of `least`.

    Pairs whose first common shingle this is and that are similar enough always may.  With labels, pairs of one label are left out.
    """

    def near(i, j):
        far, both = apart(prints, i, j), n[i] + n[j]
        most = np.minimum((both - far) // 2, np.minimum(n[i] - at[i], n[j] - at[j]))
        ok = most >= least * (both - most) - 1e-6
        return ok if label is None else ok & (label[i] != label[j]), np.maximum(far, np.abs(n[i] - n[j]))

    return near


def _columns(rows: pa.RecordBatch, least: float, labelled: bool):
    k, n, at, c = (np.asarray(rows.column(x)) if x != "c" or labelled else None for x in ("k", "n", "at", "c"))
    prints = np.stack([np.asarray(rows.column(f"p{x}")).view(np.uint64) for x in range(NEAR)], 1)
    return k, fitting(n, at, prints, least, c)


def _candidates(place: int, least: float, labelled: bool):
    """(a, b) of rows (..., k, n, at, p0, ...): a spanning forest of what may be similar, or with labels c all such pairs of small buckets."""

    def pairs(rows: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
        k, near = _columns(rows, least, labelled)
        i, j, _ = small_pairs(bucket, near, WIDE) if labelled else spanning(bucket, near)
        both = np.unique(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, x])) for x in range(2)], names=["a", "b"])

    return _by_bucket(place, pairs)


def _crowds(place: int, least: float):
    """Of larger buckets the rows (..., k, c) that may be similar to one of another label."""

    def crowds(rows: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
        k, near = _columns(rows, least, True)
        c, taken = np.asarray(rows.column("c")), np.zeros(len(k), bool)
        for a, z in zip(*(x.tolist() for x in starts_sizes(bucket)), strict=True):
            if z <= WIDE or (c[a : a + z] == c[a]).all():
                continue
            for b in range(a, a + z, step := max(1, (1 << 20) // z)):
                i = np.arange(b, min(a + z, b + step))
                taken[i] = near(i[:, None], np.arange(a, a + z)[None, :])[0].any(axis=1)
        return rows.select([*rows.schema.names[:place], "k", "c"]).filter(pa.array(taken))

    return _by_bucket(place, crowds)


def dealt(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """`rows` (h, k, n, at, p0, ...) with the columns that name their bucket: those of one shingle h.

    Crowded buckets are split into chunks, and every pair of chunks is a bucket of its own.
    """
    hot = rows.groupBy("h").agg(F.greatest(F.count(F.lit(1)) / CROWDED, F.sum("n") / MOST).alias("over")).filter("over > 1")
    hot = staged(hot.select("h", F.ceil(F.col("over") * 2).cast("int").alias("chunks")), "crowded")
    if hot.isEmpty():
        return rows, ["h"]
    own = F.pmod(F.xxhash64(F.col("k"), F.lit(3)), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.join(hot, "h", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(pairs))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("chunks", "own", "other"), ["h", "lo", "hi"]


def candidates(rows: DataFrame, place: list[str], least: float, labelled: bool = False) -> DataFrame:
    """(a, b), a < b: what `_candidates` gives of the buckets."""
    return rows.repartition(*place).sortWithinPartitions(*place, "k").select(*place, *(c for c in rows.columns if c not in place)).mapInArrow(_candidates(len(place), least, labelled), "a long, b long").distinct()


def _close(least: float):
    """(a, b) of pairs (a, b, na, nb, wa, wb) whose sketches leave a similarity of `least` open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            far = np.array([differing(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            most = (both - far) // 2
            yield batch.select([0, 1]).filter(pa.array(most >= least * (both - most) - 1e-6))

    return run


def _wanted(wanted):
    """The texts (doc_id, t, text) that the bitmap may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column(1).to_numpy().view(np.uint64))))

    return run


def _linked(words: int, least: float):
    """(a, b) of pairs of texts (a, b, ta, tb) with a similarity of `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            similar = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, own = b, shingles(y.as_py(), words)
                other = shingles(x.as_py(), words)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                similar.append(shared >= least * (len(own) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(similar, pa.bool_()))

    return run


def confirmed(sets: list[np.ndarray], label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of a similarity of `least` that join labels as all such links do; no more than there are labels."""
    n, label, out = np.array([len(s) for s in sets], np.int64), label.copy(), []
    names, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, again = np.repeat(np.arange(len(n)), n), count[ids] > 1
    owner, ids = owner[again], ids[again]
    values, times = np.unique(label, return_counts=True)
    begin, known = np.searchsorted(owner, np.arange(len(n) + 1)), np.zeros(len(names), bool)
    for i in np.flatnonzero(label != values[times.argmax()]).tolist():  # one of the two is not of the commonest label
        own = ids[begin[i] : begin[i + 1]]
        known[own] = True
        shared = np.bincount(owner[known[ids]], minlength=len(n))
        known[own] = False
        for j in np.flatnonzero((label != label[i]) & (shared >= least * (n + n[i] - shared))).tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _confirmed(place: int, words: int, least: float):
    """(a, b) of rows (..., k, c, text): links that join the labels of a bucket."""

    def links(rows: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
        k, c, text, out = np.asarray(rows.column("k")), np.asarray(rows.column("c")), rows.column("text"), []
        for a, z in zip(*(x.tolist() for x in starts_sizes(bucket)), strict=True):
            out += [(k[a + i], k[a + j]) for i, j in confirmed([shingles(t.as_py(), words) for t in text.slice(a, z)], c[a : a + z], least)]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["a", "b"])

    return _by_bucket(place, links)


def alike(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, t, component_id, class_id) of every row of `docs` (doc_id, text): classes of texts linked by similarity.

    Similarity is the Jaccard coefficient of the texts' sets of `words`-word shingles, linked from `least` on; component_id
    is the smallest doc_id reachable, class_id a number of the class, t a hash of the text.  No link between classes is left out: first
    the closest below a shingle, as a forest, are compared by their texts, then all that may be similar and are of different classes
    still, in large buckets without naming the pairs.  Texts without words are one class.
    Repeated rows stay repeated; a null doc_id is never a component_id unless its class has no other.  No rows: no rows.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    context, prints = docs.sparkSession.sparkContext, [f"p{k}" for k in range(NEAR)]
    # The order of shingles decides only how many are compared, so a sample tells which are frequent.
    sampled = keyed.filter(F.pmod(F.xxhash64("t"), F.lit(EVERY)) == 0).dropDuplicates(["t"]).select("text")
    often = sampled.mapInArrow(_shingles(words), "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    often = context.broadcast(bitmap(often, BITS))
    numbers = "".join(f"{p} long, " for p in prints)
    read = staged(keyed.mapInArrow(_firsts(words, least, often), f"doc_id {kind}, t long, s0 long, s1 long, n long, {numbers}w binary, f array<long>"), "prints")
    # Texts of one set are one; of them one stands for it.  What is long goes once it has been read for the last time.
    whole = read.groupBy("s0", "s1").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "t")).alias("one"), *[F.any_value(c).alias(c) for c in ("n", *prints, "w", "f")])
    whole = staged(whole.withColumn("k", F.monotonically_increasing_id()), "whole")
    rows = staged(read.select("doc_id", "t", "s0", "s1"), "rows")
    unstage(read)
    unique = staged(whole.drop("f"), "unique")
    below = whole.filter("n > 0").select(F.posexplode("f").alias("at", "h"), "k", "n").select("h", "k", "n", F.col("at").cast("long").alias("at"))
    shared = below.repartition("h").sortWithinPartitions("h").mapInArrow(_by_bucket(1, _again), "h long, k long, n long, at long")
    shared = staged(shared.join(unique.select("k", *prints).hint("merge"), "k").select("h", "k", "n", "at", *prints), "shared")
    unstage(whole)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k")))

    def texts(keys: DataFrame) -> DataFrame:
        wanted = staged(unique.join(keys.distinct().hint("merge"), "k").select("k", F.col("one.doc_id").alias("_id"), F.col("one.t").alias("_t")), "wanted")
        sent = context.broadcast(bitmap(wanted.select(F.col("_t").alias("h")), BITS))
        found = keyed.mapInArrow(_wanted(sent), f"doc_id {kind}, t long, text string").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
        return staged(found.groupBy("k").agg(F.any_value("text").alias("text")), "texts")

    def close(pairs: DataFrame) -> DataFrame:
        side = lambda c: unique.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w{c}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_close(least), "a long, b long")

    def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
        side = lambda c: known.select(F.col("k").alias(c), F.col("text").alias(f"t{c}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_linked(words, least), "a long, b long")

    def classes(links: DataFrame) -> DataFrame:
        return components(links).select(F.col("key").alias("k"), "root")

    buckets, place = dealt(shared)
    closest = staged(close(candidates(buckets, place, least)), "closest")
    known = texts(ends(closest))
    links = staged(linked(closest, known), "links")
    unstage(known)
    roots = staged(classes(links), "roots")
    labelled, place = dealt(shared.join(roots.hint("merge"), "k", "left").withColumn("c", F.coalesce("root", "k")).drop("root"))
    left = staged(close(candidates(labelled, place, least, labelled=True).join(closest.hint("merge"), ["a", "b"], "left_anti")), "left")
    spot = ", ".join(f"{p} {labelled.schema[p].dataType.simpleString()}" for p in place)
    sorted_ = labelled.repartition(*place).sortWithinPartitions(*place, "k").select(*place, *(c for c in labelled.columns if c not in place))
    crowds = staged(sorted_.mapInArrow(_crowds(len(place), least), f"{spot}, k long, c long"), "crowds")
    if not (left.isEmpty() and crowds.isEmpty()):
        known = texts(ends(left).union(crowds.select("k")))
        more = linked(left, known)
        if not crowds.isEmpty():
            there = crowds.join(known.hint("merge"), "k").select(*place, "k", "c", "text").repartition(*place).sortWithinPartitions(*place, "k")
            more = more.union(there.mapInArrow(_confirmed(len(place), words, least), "a long, b long"))
        more = staged(more, "more")
        unstage(known)
        if not more.isEmpty():
            roots = classes(links.union(more))
    rooted = unique.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    # Staged, so that the join has nothing but its shuffles below it, which adaptive execution splits where a class is large.
    least_id = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = rooted.join(least_id, "root").select("s0", "s1", "component_id", F.col("root").alias("class_id"))
    return rows.join(known.hint("merge"), ["s0", "s1"]).select("doc_id", "t", "component_id", "class_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that near-dedup keeps, all columns: of each class of `alike` the row with the smallest doc_id.

    Of a class's rows that repeat this doc_id one stays (of different texts that with the least hash); rows without doc_id stay.
    """
    key, hash_ = fresh_name(docs.columns, "kept_id"), fresh_name(docs.columns, "kept_t")
    first = alike(docs, **settings).filter(F.col("doc_id") == F.col("component_id")).groupBy("class_id", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    kept = first.groupBy("class_id").agg(F.min(F.struct("doc_id", "t", "n")).alias("r"))
    kept = staged(kept.select(F.col("r.doc_id").alias(key), F.col("r.t").alias(hash_), "r.n"), "kept")
    once, again = kept.filter("n = 1").drop("n"), kept.filter("n > 1").drop("n")
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(hash_))
    # The ids grow with the documents, so both sides are shuffled at any size: small tables get the plan that large ones need.
    out = docs.join(once.hint("merge"), same, "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    if not again.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        repeated = docs.join(again.hint("merge"), same, "left_semi")
        out = out.unionByName(repeated.groupBy("doc_id", F.xxhash64("text").alias(hash_)).agg(F.any_value(whole).alias("row")).select("row.*"))
    return out
