"""Suffix-array dedup of long repeats with a run-length index.

Windows of `length` bytes are brought together by anchors: of the k-mers of a window the one with the least hash, a function of
the window's content alone, so equal windows have equal anchors at equal offsets.  Windows in a row that share an anchor form a
context.  Contexts whose anchor occurs again go, with their bytes, to the task of the anchor.  There equal contexts
collapse by their bytes, and where an anchor has different ones these make up a run-length index: a run-compressed
Burrows-Wheeler transform with suffix samples at the ends of its runs.  The suffix array is dropped once that is built.
Matching statistics are found by comparing bytes at run heads alone and streamed along the text; where they reach `length`, the
samples also tell which place matches, so that chains of places lead to the earliest one of every long match.
Anchors with very many contexts are anchored anew by longer k-mers, in the end by whole windows, and take the same path.
Hashes only decide where bytes meet: nothing is removed but for equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, staged

#: Length of the first anchors.
K = 32
#: Bytes hashed at a time, bytes of contexts gathered together, different contexts of an anchor above which it is anchored anew,
#: and rows of one anchor above which equal contexts collapse before the anchor is whole.
CHUNK, GATHERED, CROWDED, FEW = 480_000, 1 << 22, 2048, 8192
#: A chunk has fewer bytes than 2 ** POSITION_BITS, a text fewer than 2 ** PLACE_BITS.
POSITION_BITS, PLACE_BITS = 20, 40
MULTIPLIER = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def levels(length: int) -> list[int]:
    """Lengths of anchors: for all windows, and for those whose anchors are crowded at the length before."""
    return sorted({K, (K + length) // 2, length})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, and a random word for each byte."""
    if len(_tables.get("up", ())) < n:
        base = 0xD1342543DE82EF95
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.full(max(n, CHUNK + (1 << 17)), factor, np.uint64)
            out[0] = 1
            _tables[name] = np.cumprod(out, dtype=np.uint64)
        _tables["word"] = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
    return _tables["up"], _tables["down"], _tables["word"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MULTIPLIER)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a buffer; they decide where bytes are compared, not whether these are equal."""

    def __init__(self, data: np.ndarray):
        up, self.down, word = _powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word[data] * up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def contexts(data: np.ndarray, ends: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, last window) of a buffer of texts that end at `ends`."""
    n, wide = len(data) - length + 1, length - k + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - k + 1)
    kmers = hashes.of(at, at + k)
    least = (kmers >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[wide - width : wide - width + n]) if wide > width else least[:n]
    anchor = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(n)
    text = np.searchsorted(ends, start, "right")
    inside = (text < len(ends)) & (start + length <= ends[np.minimum(text, len(ends) - 1)])
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]]) & inside)
    last = np.flatnonzero(np.concatenate([(anchor[1:] != anchor[:-1]) | ~inside[1:], [True]]) & inside)
    return kmers[anchor[first]], hashes.of(first, last + length), first, last


def chunked(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """`contexts` of a buffer of any size, CHUNK bytes at a time; chunks overlap by length - 1 bytes."""
    found = []
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        h, c, first, last = contexts(data[at : at + CHUNK + length - 1], ends - at, length, k)
        found.append((h, c, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces start to end of a buffer, one after the other, and their ends."""
    ends = np.cumsum(end - start)
    return data[np.repeat(start - (ends - (end - start)), end - start) + np.arange(ends[-1] if len(ends) else 0)], ends


def ranked(ids: pa.Array, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of each row by (id, hash of the text), null ids first, and a row of each rank."""
    by_id = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy() if len(ids) else np.empty(0, np.int64)
    order = np.lexsort((t, by_id))
    new = np.concatenate([[True], (by_id[order][1:] != by_id[order][:-1]) | (t[order][1:] != t[order][:-1])])[: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that follow each other in one text, joined."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != hi[:-1] + 1)]) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return key[at], lo[at], hi[np.append(at[1:], len(key)) - 1] if len(key) else hi


#: Kinds of rows: windows lo to hi that are removed; a context; a context whose anchor is crowded.
GONE, CONTEXT, CROWD = 0, 1, 2
ROWS = ("kind", "h", "id", "t", "lo", "hi")


def _rows(kind: int, h, ids: pa.Array, t, lo, hi, strings: pa.Array | None | bool = False) -> pa.RecordBatch:
    """A batch of ROWS, with their bytes if these are not False (None: there are none)."""
    numbers = [pa.array(np.ascontiguousarray(x, np.int64)) for x in (np.broadcast_to(kind, len(ids)), h, t, lo, hi)]
    columns = [*numbers[:2], ids, *numbers[2:]]
    if strings is False:
        return pa.RecordBatch.from_arrays(columns, names=ROWS)
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids), pa.binary()) if strings is None else strings], names=[*ROWS, "bytes"])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    got, ends = gathered(data, start, end)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(got))])


def _pieces(start: np.ndarray, end: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of pieces that have about `most` bytes together."""
    part = np.cumsum(end - start) // most
    for cut in np.unique(part).tolist():
        yield slice(*np.searchsorted(part, [cut, cut + 1]).tolist())


def _anchored(data: np.ndarray, ends: np.ndarray, length: int, k: int, ids: pa.Array, t: np.ndarray, shift: np.ndarray) -> tuple[tuple, tuple]:
    """Contexts of the pieces of a buffer that end at `ends`; those equal to an earlier one of the buffer are gone already.

    ids, t: of the text that each piece belongs to; shift: what takes places of the buffer to places of that text.
    Returns (row, lo, hi) of what is gone, and (anchor, row, lo, hi, place in the buffer) of the other contexts.
    """
    h, c, first, last = chunked(data, ends, length, k)
    piece = np.searchsorted(ends, first, "right")
    rank, pick = ranked(ids, t)
    key, lo, hi = rank[piece], first + shift[piece], last + shift[piece]
    order = np.lexsort((lo, key, c, h))
    h, c, key, lo, hi, first = (x[order] for x in (h, c, key, lo, hi, first))
    alike = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (hi[1:] - lo[1:] == hi[:-1] - lo[:-1])])[: len(h)]
    head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(h)))) if len(h) else np.empty(0, np.int64)
    some = np.flatnonzero(alike)
    raw, size = data.tobytes() if len(some) else b"", (hi - lo + length)[some]
    same = [raw[a : a + n] == raw[b : b + n] for a, b, n in zip(first[some].tolist(), first[head[some]].tolist(), size.tolist(), strict=True)]
    alike[some] = np.array(same, bool)
    again = alike & ((key != key[head]) | (lo != lo[head]))  # a row that repeats brings the very same place: only once
    gone = merged(key[again], lo[again], hi[again])
    left = ~alike
    return (pick[gone[0]], gone[1], gone[2]), (h[left].view(np.int64), pick[key[left]], lo[left], hi[left], first[left])


def _read(length: int, k: int):
    """Contexts of a batch of texts (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = buffers(batch.column(2))
            if not len(start):
                continue
            ids, t = batch.column(0), batch.column(1).to_numpy()
            (row, lo, hi), (h, r, a, b, _) = _anchored(data[start[0] : end[-1]], end - start[0], length, k, ids, t, start[0] - start)
            yield _rows(GONE, _mix(row.astype(np.uint64)).view(np.int64), ids.take(pa.array(row)), t[row], lo, hi)
            yield _rows(CONTEXT, h, ids.take(pa.array(r)), t[r], a, b)

    return run


def _anew(length: int, k: int, most: int):
    """The windows of crowded contexts (h, id, t, lo, bytes) as contexts of longer anchors, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = buffers(batch.column("bytes"))
            if not len(start):
                continue
            data, ends = data[start[0] : end[-1]], end - start[0]
            ids, t, at = batch.column("id"), batch.column("t").to_numpy(), batch.column("lo").to_numpy()
            (row, lo, hi), (h, r, a, b, first) = _anchored(data, ends, length, k, ids, t, at - np.concatenate([[0], ends[:-1]]))
            yield _rows(GONE, _mix(row.astype(np.uint64)).view(np.int64), ids.take(pa.array(row)), t[row], lo, hi, None)
            stop = first + (b - a) + length
            for cut in _pieces(first, stop, most):
                yield _rows(CONTEXT, h[cut], ids.take(pa.array(r[cut])), t[r[cut]], a[cut], b[cut], _strings(data, first[cut], stop[cut]))

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by anchor those whose anchor has others; what is gone passes."""
    held = None  # the last row, whose anchor may go on, and whether it has gone out
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == GONE).any():
            yield batch.filter(pa.array(kind == GONE))
            batch = batch.filter(pa.array(kind != GONE))
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held[0], batch]) if held else batch
        h = rows.column("h").to_numpy()
        alike = h[1:] == h[:-1]
        out = np.append(False, alike) | np.append(alike, False)
        seen = bool(held) and held[1]
        yield rows.filter(pa.array(out & ~(seen & (np.arange(len(h)) == 0))))
        held = rows.slice(len(h) - 1), bool(out[-1]) or (seen and len(h) == 1)


def _fetch(length: int, most: int):
    """(h, id, t, lo, bytes) of the wanted contexts of (id, t, text, wanted), about `most` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            ids, t, (data, start, _) = batch.column(0), batch.column(1).to_numpy(), buffers(batch.column(2))
            wanted = batch.column(3)
            # Rows of one id and text stand together: one of them is enough.
            rank, _ = ranked(ids, t)
            new = np.concatenate([[True], rank[1:] != rank[:-1]])[: len(rank)]
            if len(rank):
                new[0] = before != (ids[0], t[0])
                before = (ids[-1], t[-1])
            row = np.repeat(np.arange(len(wanted)), np.asarray(wanted.value_lengths()))
            h, lo, hi = (np.asarray(wanted.flatten().field(x)) for x in ("h", "lo", "hi"))
            row, h, lo, hi = (x[new[row]] for x in (row, h, lo, hi))
            a, b = start[row] + lo, start[row] + hi + length
            for cut in _pieces(a, b, most):
                r = row[cut]
                yield _rows(CONTEXT, h[cut], ids.take(pa.array(r)), t[r], lo[cut], hi[cut], _strings(data, a[cut], b[cut]))

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a collection of strings, with samples at the ends of its runs.

    data: the strings, each followed by one byte of any value that stands for a separator below all others; starts: where they
    start.  No match reaches over a separator.  Kept are, beside the text, the runs' symbols and, for each run head, its place in the
    text and the place of the suffix above it, which ends the run before.  The suffix array and all else as long as the text is
    dropped once these are known.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        self.ends = np.append(starts[1:], n) - 1
        size = self.ends + 1 - starts
        known = np.zeros(256, bool)
        known[data] = True
        code = np.cumsum(known)
        symbol = code[data]
        symbol[self.ends] = 0
        rest = np.repeat(self.ends, size) - np.arange(n)  # bytes to the end of the string
        order = self._sorted(symbol, int(code[-1]), rest, np.repeat(np.arange(len(starts)), size), int(size.max(initial=1)) - 1)
        bwt = symbol[order - 1]
        # A row heads a run if its symbol differs from the one above; nothing runs on over a separator.
        heads = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)]))[:n]
        by_place = np.argsort(order[heads])
        self.symbols = bwt[heads]
        self.sample = order[heads][by_place]
        self.above = np.where(heads > 0, order[heads - 1], -1)[by_place]
        self.text = np.concatenate([data, np.zeros(8, np.uint8)])
        self.n = n

    @staticmethod
    def _sorted(symbol: np.ndarray, largest: int, rest: np.ndarray, string: np.ndarray, longest: int) -> np.ndarray:
        """Suffixes in order, each compared to the end of its string only, equal ones in the order of their strings.

        As many symbols as fit a word are compared at first; then ranks of so many, as many as fit, and so on.
        """
        n, depth, value, top = len(symbol), 1, symbol, largest
        while True:
            bits = int(top + 1).bit_length()
            terms = max(2, 63 // bits)
            key = np.zeros(n, np.int64)
            for k in range(terms):
                at = k * depth
                key <<= bits
                if at < n:
                    key[: n - at] += np.where(rest[: n - at] >= at, value[at:] + 1, 0)
            order = np.argsort(key)
            depth *= terms
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            value, top = rank, int(rank[order[-1]])
            if depth > longest or top == n - 1:
                return order if top == n - 1 else np.argsort(rank * (int(string[-1]) + 1) + string)

    def _word(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on."""
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.text[at + k]
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, within their strings, by comparing bytes."""
        end = lambda x: self.ends[np.searchsorted(self.ends, x)]
        most = np.minimum(end(a) - a, end(b) - b)
        got, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            at = got[open_]
            apart = self._word(a[open_] + at) ^ self._word(b[open_] + at)
            got[open_] += sum((apart < np.uint64(1 << bits)).astype(np.int64) for bits in range(0, 64, 8))
            open_ = open_[(apart == 0) & (got[open_] < most[open_])]
        return np.minimum(got, most)

    def matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, class) of the places that share a string of `length` bytes with another; a class is one of its places.

        The statistic of a place is the length of its match with the suffix above it in order: it is found at run heads, and
        along the text every other place has one less than the place before it, matching one further on.  So a head's
        places that match, up to the next head, are a stretch that lies as far from its matches as the head from its own.
        Only such places are ever listed.
        """
        heads = np.flatnonzero(self.above >= 0)
        width = self.common(self.sample[heads], self.above[heads]) - length + 1
        width = np.minimum(width, np.append(self.sample[1:], self.n)[heads] - self.sample[heads])
        heads, width = heads[width > 0], width[width > 0]
        on = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        source, target = (np.repeat(x[heads], width) + on for x in (self.sample, self.above))
        place = np.unique(np.concatenate([source, target]))
        parent = np.arange(len(place))
        parent[np.searchsorted(place, source)] = np.searchsorted(place, target)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        return place, place[parent]


def block_repeats(code: np.ndarray, place: np.ndarray, anchor: np.ndarray, data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window) of the windows that also start at an earlier place, for occurrences of strings.

    code: which string an occurrence is of, place: where it starts, a text and a place in it as one number, anchor: of
    each occurrence; data, ends: the strings.
    """
    size = np.diff(ends, prepend=0)
    first = np.full(len(ends), np.iinfo(np.int64).max)
    np.minimum.at(first, code, place)
    later = place > first[code]
    gone = [(place[later], (size[code] - length)[later])]
    # Strings of one anchor that has others make up the index.
    of = np.zeros(len(ends), np.int64)
    of[code] = anchor
    order = np.argsort(of, kind="stable")
    same = of[order][1:] == of[order][:-1]
    some = np.sort(order[np.append(same, False) | np.append(False, same)]) if len(order) else order
    if len(some):
        text, stops = gathered(np.append(data, np.uint8(0)), ends[some] - size[some], ends[some] + 1)  # one byte more, for the separator
        starts = np.append(0, stops[:-1])
        at, class_ = RunLengthIndex(text, starts).matches(length)
        string = np.searchsorted(starts, at, "right") - 1
        window = first[some[string]] + at - starts[string]
        _, class_ = np.unique(class_, return_inverse=True)
        least = np.full(len(class_), np.iinfo(np.int64).max)
        np.minimum.at(least, class_, window)
        window = window[window != least[class_]]
        gone.append((window, np.zeros(len(window), np.int64)))
    start, width = (np.concatenate(x) for x in zip(*gone, strict=True))
    lo = start & ((1 << PLACE_BITS) - 1)
    return merged(start >> PLACE_BITS, lo, lo + width)


def _settled(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Of contexts with bytes those equal to an earlier one, as gone, and the first of each."""
    ids, t, lo, hi, strings = (rows.column(x) for x in ("id", "t", "lo", "hi", "bytes"))
    t, lo, hi = t.to_numpy(), lo.to_numpy(), hi.to_numpy()
    code, (rank, _) = strings.dictionary_encode().indices.to_numpy(), ranked(ids, t)
    order = np.lexsort((lo, rank, code))
    again = np.concatenate([[False], code[order][1:] == code[order][:-1]])
    head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    other = order[again & ((rank[order] != rank[head]) | (lo[order] != lo[head]))]
    return _rows(GONE, np.zeros(len(other)), ids.take(pa.array(other)), t[other], lo[other], hi[other], None), rows.take(pa.array(np.sort(order[~again])))


def _index(length: int, most: int | None):
    """Windows gone, of contexts sorted by anchor: whole anchors of about a batch of rows are indexed together.

    Anchors with more than `most` different contexts are handed on as they are, as CROWD.
    """

    def give(rows: pa.RecordBatch) -> pa.RecordBatch:
        h, ids, t, lo, strings = (rows.column(x) for x in ("h", "id", "t", "lo", "bytes"))
        coded, t = strings.dictionary_encode(), t.to_numpy()
        rank, pick = ranked(ids, t)
        data, start, end = buffers(coded.dictionary)
        key, lo, hi = block_repeats(coded.indices.to_numpy(), (rank << PLACE_BITS) + lo.to_numpy(), h.to_numpy(), data[start[0] : end[-1]], end - start[0], length)
        return _rows(GONE, np.zeros(len(key)), ids.take(pa.array(pick[key])), t[pick[key]], lo, hi, None)

    def crowd(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.set_column(0, "kind", pa.array(np.full(rows.num_rows, CROWD, np.int64)))

    def settled(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole anchors."""
        h = rows.column("h").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        wide = np.zeros(len(starts), bool)
        for g in np.flatnonzero(sizes > (most or len(h))).tolist():
            later, kept = _settled(rows.slice(int(starts[g]), int(sizes[g])))
            yield later
            wide[g] = True
            yield crowd(kept) if kept.num_rows > most else give(kept)
        some = rows.filter(pa.array(~np.repeat(wide, sizes)))
        if some.num_rows:
            yield give(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flood = None, None  # rows of the last anchor, which may go on; or that anchor, if it is crowded
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == GONE).any():
                yield batch.filter(pa.array(kind == GONE))
                batch = batch.filter(pa.array(kind != GONE))
            if flood is not None:
                more = batch.column("h").to_numpy() == flood
                yield crowd(batch.filter(pa.array(more)))
                batch = batch.filter(pa.array(~more))
            if not batch.num_rows:
                continue
            rows, flood = pa.concat_batches([held, batch]) if held is not None else batch, None
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from settled(rows.slice(0, cut))
            held = rows.slice(cut)
            if held.num_rows > (most or FEW):
                later, held = _settled(held)
                yield later
                if most and held.num_rows > most:
                    yield crowd(held)
                    held, flood = None, h[-1]
        if held is not None:
            yield from settled(held)

    return run


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes of its ranges (lo, end), and how much that is."""
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""  # one text at a time
            kept, at, n, spans = [], 0, 0, 0
            for lo, end in sorted((r["lo"], r["end"]) for r in ranges or ()):
                if lo > at or not spans:
                    kept.append(raw[at:lo])
                    spans += 1
                    at = lo
                n += max(0, end - at)
                at = max(at, end)
            kept.append(raw[at:])
            out.append((len(raw), n, spans, b"".join(kept)))
        n, gone, spans_, kept_ = zip(*out, strict=True) if out else ((), (), (), ())
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept_], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans_)), sha, pa.array(kept_, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, t, lo, hi): windows of `length` bytes, by first and last start, that also start earlier in the corpus.

    A text is known by its doc_id (of any type that has an order) and t, a hash of the text.  Earlier: under a smaller id (null
    before all; of one id under a smaller t), or in the same text.  Ranges may touch or repeat, never miss any.
    """
    if not K <= length < CHUNK:
        raise ValueError(f"length must be {K} to {CHUNK - 1}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind long, h long, id {kind}, t long, lo long, hi long"
    whole = f"{schema}, bytes binary"
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text").filter(F.octet_length("text") >= length)

    def by_anchor(rows: DataFrame) -> DataFrame:
        return rows.repartition("h").sortWithinPartitions("h")

    def gone(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("kind") == GONE).select("id", "t", "lo", "hi")

    first, *longer = levels(length)
    rows = staged(by_anchor(text.mapInArrow(_read(length, first), schema)).mapInArrow(_several, schema), "contexts")
    asked = rows.filter(F.col("kind") == CONTEXT).groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("h", "lo", "hi")).alias("wanted"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    pieces = text.join(asked, same).select("id", "t", "text", "wanted").mapInArrow(_fetch(length, GATHERED), whole)
    out = gone(rows)
    for k in [*longer, None]:
        marked = staged(by_anchor(pieces).mapInArrow(_index(length, CROWDED if k else None), whole), "marked")
        out = out.unionByName(gone(marked))
        crowded = marked.filter(F.col("kind") == CROWD)
        if k is None or crowded.isEmpty():
            return out
        pieces = crowded.select("h", "id", "t", "lo", "bytes").mapInArrow(_anew(length, k, GATHERED), whole)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of `docs` (doc_id, text).

    Every byte is removed that lies in a string of `length` bytes which also starts earlier; strings are judged on the
    input.  Null and empty texts have no bytes; texts shorter than `length` lose none.  Rows with the same doc_id and text are one
    document; those with one doc_id (or none) and different texts are different documents, in the order of a hash of
    the text.  Other columns are ignored.
    """
    ranges = repeats(docs, length).groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("lo", (F.col("hi") + length).alias("end"))).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    joined = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(ranges, same, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
