"""Helpers that the corpus operators share: tables, words, and columns that clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.staging import spread, staged, unstage

__all__ = ["ASCII_LOWER", "WORD", "buffers", "carried", "fresh_name", "portable_uniform", "shielded", "sliced", "staged", "table", "text_bytes", "unstage", "word_count"]

#: Words are maximal runs of anything but ASCII white space (Java and RE2 read this pattern alike).
WORD = r"[^\x20\x09-\x0D]+"

#: Translates A-Z to a-z in UTF-8 bytes and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of few partitions is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh_name(columns: list[str], stem: str) -> str:
    """`stem`, with underscores appended until no column of that name exists (names compare without case)."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def word_count(text: Column) -> Column:
    """Number of white-space-separated words; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def portable_uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5(seed:key); any engine with md5 gets the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def shielded(df: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """`df` with columns named like one of `added` under other names, and what selects all columns as they were."""
    names = {c: c for c in df.columns}
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            names[c] = fresh_name([*names.values(), *df.columns, *added], f"own_{c}")
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def carried(df: DataFrame, own: list[str], read: list[Column], f: Callable, added: list[T.StructField]) -> DataFrame:
    """The columns `own` of `df`, of any names, and `added`, which `f` makes of batches of `own` and then `read`.

    `f` gives batches of `own` and `added`.  Columns go through Python under plain names, as those with dots would be taken for fields.
    """
    names = [f"c{i}" for i in range(len(own))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, own, strict=True)]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, own, strict=True)], *[c.alias(f"r{i}") for i, c in enumerate(read)])
    got = rows.mapInArrow(f, T.StructType([*fields, *added]))
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True)], *[a.name for a in added])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each starts and ends in them; null is empty."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.empty(0, np.uint8)
    start, end = offsets[:-1], offsets[1:]
    return data, start, np.where(np.asarray(wide.is_null()), start, end) if wide.null_count else end


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices with about `most` bytes of texts in `column`, one row at least."""
    for batch in batches:
        _, start, end = buffers(batch.column(column))
        part = np.cumsum(end - start) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)
