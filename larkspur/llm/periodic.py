"""Periodic runs of words: Main and Lorentz's divide and conquer over whole texts.

A text's words become numbers, and a dyadic grid cuts it in halves, their halves and so on.  Every run crosses the midpoint of
just one block that holds it whole, with a period's length or more on one side of it.  So for a midpoint m and each
shift p up to half a block the values of two Z-functions, how far the text agrees with itself moved by p onwards and backwards
from m (or from m - p, for runs that lie more to the left), tell the run of period p there: it is as long as both together
and p.  All midpoints of a level, of all texts of a batch, are taken together.  A run of LEAST words has three agreeing words
next to its midpoint, so Z-values are taken only where triples agree.  They come from names of the stretches of 1, 2, 4, ...
words, equal if the stretches are, so agreement is of words, not of hashes.  Values go beyond the block, to the run's
own ends; the same interval found under several periods keeps the smallest.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, carried, sliced

LEAST = 12
ADDED = ("n_words", "runs", "collapsed")
RUN = "struct<start: long, length: long, period: long>"


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word numbers of a text of n words that a tenth of all ids repeat from some word on; none for other ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


class Agreement:
    """How far a sequence of names agrees with itself from two places on, or up to them."""

    def __init__(self, names: np.ndarray, longest: int):
        """Stretches of up to `longest` names at least are told apart by names of their own."""
        self.size = len(names)
        self.levels = [names]
        while 1 << len(self.levels) <= longest:
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            wide = below[: self.size - half].astype(np.int64) * (int(below.max()) + 1) + below[half:]
            _, named = np.unique(wide, return_inverse=True)
            # What would go on beyond the end agrees with nothing.
            self.levels.append(np.concatenate([named, named.size + np.arange(self.size - named.size)]))

    def onwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the agreement from a and from b > a on."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            on = b + out < self.size
            same = on & (self.levels[k][np.where(on, a + out, 0)] == self.levels[k][np.where(on, b + out, 0)])
            out += same.astype(np.int64) << k
        return out

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the agreement before a and before b > a."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            on = x >= 0
            same = on & (self.levels[k][np.where(on, x, 0)] == self.levels[k][np.where(on, y, 0)])
            out += same.astype(np.int64) << k
        return out


def _triples(names: np.ndarray) -> np.ndarray:
    """A name for each three in a row; the last two places have none."""
    top = int(names.max()) + 1
    _, two = np.unique(names[:-1] * top + names[1:], return_inverse=True)
    _, three = np.unique(two[:-1].astype(np.int64) * top + names[2:], return_inverse=True)
    return np.concatenate([three, three.size + np.arange(len(names) - three.size)])


def candidates(names: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p): where agreement with the text moved by p reaches or crosses place i, by a midpoint of the grid, and may be a run.

    `place` is each name's place in its text and `length` the text's number of words; every text ends in a name of its own.
    """
    triple = _triples(names)
    before = np.concatenate([-1 - np.arange(3), triple[:-3]])  # the triple that ends before a place
    where, found, block = np.arange(len(names)), [(np.empty(0, np.int64), np.empty(0, np.int64))], 16
    while len(where):
        within = place & (block - 1)
        # A place meets its block's midpoint, if the text has one; one that begins a block is also the end of the block before.
        own = (within != block // 2) & (place - within + block // 2 < length)
        end = (within == 0) & (place > 0)
        x = np.concatenate([where[own], where[end]])
        mid = np.concatenate([where[own] - within[own], where[end] - block]) + block // 2
        meets = (triple[x] == triple[mid]) | (before[x] == before[mid])
        x, mid = x[meets], mid[meets]
        found.append((np.minimum(x, mid), np.abs(x - mid)))
        on = length > block  # the next level has a midpoint in the text
        where, place, length = where[on], place[on], length[on]
        block *= 2
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs(names: np.ndarray, place: np.ndarray, length: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, in order of start and period, over texts side by side (see `candidates`)."""
    if len(names) < 6:
        return (np.empty(0, np.int64),) * 3
    at, p = candidates(names, place, length)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    # Only texts with candidates are looked at closer.
    text = at - place[at]
    own = np.unique(text)
    sizes = length[own] + 1
    moved = np.cumsum(sizes) - sizes
    whole = np.arange(int(sizes.sum())) + np.repeat(own - moved, sizes)
    agree = Agreement(np.unique(names[whole], return_inverse=True)[1], int(sizes.max()))
    shift = (own - moved)[np.searchsorted(own, text)]
    back, on = agree.backwards(at - shift, at - shift + p), agree.onwards(at - shift, at - shift + p)
    good = (back + on >= p) & (back + on + p >= least)
    start, size, p = (at - back)[good], (back + on + p)[good], p[good]
    order = np.lexsort([p, size, start])
    start, size, p = start[order], size[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(size) != 0)
    start, size, p = start[first], size[first], p[first]
    order = np.lexsort([p, start])
    return start[order], size[order], p[order]


def _collapsed(least: int, rewrite: Callable | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], whole.num_columns - 2):
                yield _answer(batch, batch.num_columns - 2, least, rewrite)

    return run


def _answer(batch: pa.RecordBatch, keep: int, least: int, rewrite: Callable | None) -> pa.RecordBatch:
    """The first `keep` columns of a batch with the text and the id behind them, and ADDED."""
    data, start, end = buffers(batch.column(keep))
    index: defaultdict = defaultdict(count().__next__)
    texts, names = [], []
    ids = batch.column(keep + 1).to_pylist() if rewrite else [None] * len(start)
    for a, b, doc_id in zip(start.tolist(), end.tolist(), ids, strict=True):
        words = data[a:b].tobytes().split()
        own = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        moved = rewrite(doc_id, len(words)) if rewrite else None
        texts.append((words, moved))
        names.append(own if moved is None else own[moved])
    size = np.array([len(x) for x in names], np.int64)
    head = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    flat = np.empty(head[-1], np.int64)
    for k, x in enumerate(names):
        flat[head[k] : head[k + 1] - 1] = x
        flat[head[k + 1] - 1] = len(index) + k  # the end of a text agrees with nothing
    at = np.arange(len(flat)) - np.repeat(head[:-1], size + 1)
    begin, long, period = runs(flat, at, np.repeat(size, size + 1), least)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, begin + long, -1)
    stays = np.cumsum(depth)[:-1] == 0
    of = np.searchsorted(head, begin, "right") - 1
    kept = []
    for k, (words, moved) in enumerate(texts):
        own = stays[head[k] : head[k + 1] - 1]
        if moved is not None:
            kept.append(b" ".join([words[i] for i in moved[own].tolist()]))
        else:
            kept.append(b" ".join(words if own.all() else [words[i] for i in np.flatnonzero(own).tolist()]))
    found = pa.StructArray.from_arrays([pa.array(begin - head[of]), pa.array(long), pa.array(period)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)), found)
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(size), lists, pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=[*batch.schema.names[:keep], *ADDED])


def find_runs(docs: DataFrame, least: int = LEAST, keep: list[str] | None = None, rewrite: Callable | None = None) -> DataFrame:
    """Every row of `docs` with n_words, runs and collapsed.

    Words are what ASCII white space parts; null and empty texts have none, and their `collapsed` is empty.  A run is a
    stretch of `least` words or more, twice its smallest period q at least, in which words q apart are equal, and which no word beside
    it goes on.  runs has (start, length, period) by start, then period; collapsed is the words, joined by one space, without
    those that any run has after its first period.  rewrite(doc_id, n) may give word numbers to read a text of n words by,
    instead of 0 .. n - 1.  Rows are independent, so repeated rows and null ids are as others.  keep: columns of `docs` to
    return (all); those named like an added one are left out.  No rows: no rows.
    """
    if least < LEAST:
        raise ValueError(f"runs have {LEAST} words at least")
    own = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")), T.StructField("collapsed", T.StringType())]
    return carried(docs, own, [F.col("text"), F.col("doc_id")], _collapsed(least, rewrite), added)
