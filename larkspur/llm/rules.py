"""Quality rules as a bitmask ledger.

One pass measures each text and evaluates every rule once; the ledger keeps the measurements and a mask of failed rules.
Policies are versioned masks over that ledger, and ablations are bitwise aggregates of it: no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measurements, is true.  Its bit never changes meaning."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars > 15 * n_words"),
    Rule("repeated_lines", 5, "100 * n_dup_lines > 50 * n_lines"),
)

#: Versions are never edited: a change of policy is a new version.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "quality-1": ("few_words", "repeated_windows", "many_symbols", "short_words", "long_words", "repeated_lines"),
}


def repeat_words(tokens: list[bytes]) -> int:
    """Words that lie in a window of three words which the list holds twice or more."""
    n = len(tokens)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int64, n)
    _, pairs = np.unique(ids[:-2] * len(index) + ids[1:-1], return_inverse=True)
    _, at, times = np.unique(pairs * len(index) + ids[2:], return_inverse=True, return_counts=True)
    again, hit = times[at] > 1, np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES; null and empty give zeros."""
    if not text:
        return (0,) * len(MEASURES)
    tokens = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(tokens), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(tokens)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([measure(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in got.T)], names=[*batch.schema.names[:-1], *MEASURES])


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, the measurements and fail_bits (long) of every row; each rule is evaluated once.

    A null, empty or blank text measures zero everywhere and fails only the rule on few words.  Repeated rows stay
    repeated; columns other than keys and text are ignored.  No rows: no rows.
    """
    got = carried(docs, list(keys), [F.col("text")], _measured, [T.StructField(m, T.LongType()) for m in MEASURES])
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return got.withColumn("fail_bits", out)


def passes(fail_bits: Column, policy: str) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(kept: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: n_failed, n_only (rows that it alone rejects) and n_kept_without (kept if it were dropped).

    `kept` is a ledger.  Rows are first counted per mask of failed rules (2 ** rules groups at most), so the shuffle is
    a few rows from each task.
    """
    whole = mask(POLICIES[policy])
    by_mask = kept.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules])).alias("r")
    alone, m = F.col("m").bitwiseAND(F.bitwise_not(F.col("r.b"))) == 0, F.col("m").bitwiseAND(F.col("r.b")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return by_mask.select("m", "n", rule).groupBy(F.col("r.rule").alias("rule")).agg(total(m)("n_failed"), total(m & alone)("n_only"), total(alone)("n_kept_without"))
