"""Words of batches of texts as numbers: where they stand and a hash of each, and bitmaps of hashes.

Hashes only choose what is looked at; whoever uses them compares the words themselves or joins on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers

#: Letters A-Z become lower case; ASCII characters that are neither letters nor digits become spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: CHUNK bytes are hashed at a time; the powers of letters' places repeat after PLACES.
CHUNK, PLACES = 1 << 20, 1 << 16
_tables: list[np.ndarray] = []


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Spelled:
    """The words of a buffer of texts: where they start and end in `raw`, which text each is of, and a hash of each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        if not _tables:
            powers = np.full(PLACES, 0xD1342543DE82EF95, np.uint64)
            powers[0] = 1
            _tables.extend([np.cumprod(powers, dtype=np.uint64), np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64)])
        up, letter = _tables
        low = int(start[0]) if len(start) else 0
        self.raw = data[low : int(end[-1]) if len(end) else low].tobytes().translate(NORMAL)
        symbols, first = np.frombuffer(self.raw, np.uint8), np.unique(start[end > start]) - low
        begins, lengths, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while at < len(symbols):
            stop = at + CHUNK
            if stop < len(symbols):  # on to a space or the end of a text, so that no word is cut
                space, text = self.raw.find(b" ", stop), int(np.searchsorted(first, stop))
                stop = min(len(symbols) if space < 0 else space, int(first[text]) if text < len(first) else len(symbols))
            part = symbols[at:stop]
            inside = part != 32
            begin = inside & ~np.concatenate([[False], inside[:-1]])
            own = first[np.searchsorted(first, at) : np.searchsorted(first, stop)] - at
            begin[own] |= inside[own]
            places = np.flatnonzero(inside)
            heads = np.flatnonzero(begin[places])
            if len(heads):
                starts, size = places[heads], np.diff(np.append(heads, len(places)))
                value = letter[part[places]] * up[(places - np.repeat(starts, size)) % PLACES]
                begins.append(starts + at)
                lengths.append(size)
                hashes.append(np.add.reduceat(value, heads))
            at = stop
        self.start, size = np.concatenate(begins), np.concatenate(lengths)
        self.end, self.hash = self.start + size, mix(np.concatenate(hashes) + size.astype(np.uint64))
        self.text = np.searchsorted(end - low, self.start, "right")
        self.head = np.searchsorted(self.text, np.arange(len(start)))  # the first word of each text
        self.count = np.bincount(self.text, minlength=len(start))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each shingle of `size` words and its first word; none goes on into another text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : n + k])
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return out[at], at

    def joined(self, first: int, last: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist(), strict=True)])


def spelled_column(column: pa.Array) -> Spelled:
    return Spelled(*buffers(column))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The first `bits` bits of the hashes (h), as a bitmap; 2 ** (bits - 6) rows at most are gathered."""
    word = F.shiftrightunsigned("h", 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS int))")
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[np.asarray(rows["word"])] = np.asarray(rows["bits"])
    return out.view(np.uint8)


def in_bitmap(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap may have: all that were put in, and few others."""
    bit = hashes >> np.uint64(64 - (len(known) * 8).bit_length() + 1)
    return (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
