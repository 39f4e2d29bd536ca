"""Source divergence audit: how far the terms of each source are from those of the others of its language.

Texts become counts (lang, source, term) in the tasks that read them, and Spark sums those.  The sums are dealt into shards by
a hash of lang and term, so all sources of a term meet in one shard.  There DuckDB counts twice with SQL: first which terms
enough documents have, then, when Spark has merged the shards' totals, the shard's part of every sum over a pair of sources and
its best terms of every source.  Spark merges those parts and ranks them.

A pair's sum over all kept terms, f(p, q) each, needs only the terms that both sources have: with p0 and q0 for terms that a
source lacks, it is  sum over both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0),  plus the sum over the group's terms of
f(p, q0), plus that over the other's of f(p0, q), plus f(p0, q0) for each kept term less those two numbers.  The second and
third sums follow from how many terms a source has of each count.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Terms are runs of A-Z, a-z and anything beyond ASCII; every other byte parts them, and A-Z become lower case.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Rows of a shard (about), entries that a task counts before it hands them on, and DuckDB's memory for a shard.
SHARD, ENTRIES, MEMORY = 1 << 15, 1 << 17, "300MB"
SCALE = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read, in parts; a row with an empty term for every group."""
    times: dict[tuple, Counter] = {}
    held: dict[tuple, Counter] = {}

    def rows() -> pa.RecordBatch:
        sizes = [len(c) for c in times.values()]
        group = [pa.array([g[k] for g in times], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for k in (0, 1)]
        terms = pa.array([t for c in times.values() for t in c], pa.binary()).cast(pa.string(), safe=False)
        n = pa.array([n for c in times.values() for n in c.values()], pa.int64())
        docs = pa.array([x for g, c in times.items() for x in map(held[g].__getitem__, c)], pa.int64())
        times.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([*group, terms, n, docs], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(k) for k in range(3)), strict=True):
            group = (lang.as_py() or "", source.as_py() or "")
            n, docs = times.setdefault(group, Counter()), held.setdefault(group, Counter())
            n[b""] += 0
            if text.is_valid:
                words = text.as_buffer().to_pybytes().translate(TERMS).split()
                n.update(words)
                docs.update(set(words))
        if sum(map(len, times.values())) > ENTRIES:
            yield rows()
    yield rows()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and how many of its rows have it.

    Sums are made in the tasks first, so the shuffle has one row for each group and term of a task, however often it occurs there.
    """
    got = docs.select("text", "lang", "source").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _in_shard(sql: str) -> Callable:
    """A shard's rows, `r` in the SQL, put through DuckDB."""

    def run(r: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as con:
            con.register("r", r)
            return con.sql(sql).to_arrow_table()

    return run


KEPT = """
SELECT shard, lang, source, term, n, lang_n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first FROM (
    SELECT shard, lang, source, term, n, sum(n) OVER (PARTITION BY lang, term)::BIGINT AS lang_n, sum(docs) OVER (PARTITION BY lang, term) AS in_docs FROM r)
WHERE in_docs >= {least}
"""
SHARES = f"""
WITH s AS (SELECT lang, source, term, (1 + {SCALE}::HUGEINT * (n + 1) // (total + v))::BIGINT AS p, (1 + {SCALE}::HUGEINT // (total + v))::BIGINT AS p0,
    (1 + {SCALE}::HUGEINT * (lang_n + 1) // (lang_total + v))::BIGINT AS q FROM r)
"""
#: Parts of the result: sums over terms that both of a pair have, and the first terms of each group.
PAIRS = SHARES + """
SELECT a.lang, a.source, b.source AS other, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::BIGINT AS value
FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
FIRST = SHARES + """
SELECT lang, source, term, f(p, q)::BIGINT AS value FROM s WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {most}
"""


def _parts(most: int) -> Callable:
    """(lang, source, part, item, value) of a shard: sums of pairs (part `pair`) and first terms (part `term`)."""

    def run(r: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as con:
            con.register("r", r)
            con.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // q")
            found = f"SELECT lang, source, 'pair' AS part, other AS item, value FROM ({PAIRS}) UNION ALL SELECT lang, source, 'term', term, value FROM ({FIRST.format(most=most)})"
            return con.sql(found).to_arrow_table()

    return run


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in whole numbers of any size."""
    up = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, total.cast("decimal(20,0)")) + 1


def _whole(total: str) -> Column:
    """A group's occurrences and its language's terms; 1 where there are none."""
    return F.greatest(F.col(total) + F.col("v"), F.lit(1))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language, and terms that set one apart.

    A null text, lang or source is empty.  Terms are runs of letters A-Z, a-z and of anything beyond ASCII, A-Z in lower case;
    a language keeps the V terms that `least_docs` of its rows or more have.  In a group (lang, source) with N occurrences of
    kept terms one with n of them has the share p = 1 + floor(SCALE * (n + 1) / (N + V)), in the language likewise.  Part
    `pair` has for every other source of the language the sum over kept terms of f = floor((p - q)^2 / q), q the other's
    share; part `term` has the first `most` terms that occur in the group and whose share is above the language's, q, by f.  Ranks
    go by value downwards, then by item.  Repeated rows count each; groups without terms are there; a language of one source
    has no pairs; columns other than text, lang and source are ignored.  No rows: no rows.  V under 10 ** 9.
    """
    total = staged(counts(docs), "term-counts")
    groups_ = total.filter("term = ''").select("lang", "source")
    terms = total.filter("term != ''")
    shards = max(1, terms.count() // SHARD)
    schema = "shard int, lang string, source string, term string, n long, lang_n long, first boolean"
    dealt = terms.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = staged(dealt.groupBy("shard").applyInArrow(_in_shard(KEPT.format(least=least_docs)), schema), "kept-terms")
    # One row for each group: occurrences and number of its kept terms, and the language's.
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    own = groups_.join(own, ["lang", "source"], "left").select("lang", "source", zero("total"), zero("terms"))
    of_lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    groups = staged(own.join(of_lang, "lang", "left").select("lang", "source", "total", "terms", zero("v"), zero("lang_total")), "groups")
    rows = kept.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"]).select("shard", "lang", "source", "term", "n", "lang_n", "total", "v", "lang_total")
    parts = staged(rows.groupBy("shard").applyInArrow(_parts(most), "lang string, source string, part string, item string, value long"), "parts")
    both = parts.filter("part = 'pair'").select("lang", "source", "item", "value")
    # What one source of a pair has and the other lacks, by how many terms have a count.
    times = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
    times = staged(times.select("lang", "source", "times", _share(F.col("n"), _whole("total")).alias("p")), "times")
    beside = times.join(groups.select("lang", F.col("source").alias("item"), _share(F.lit(0), _whole("total")).alias("q0")), "lang").filter("source != item")
    mine = beside.select("lang", "source", "item", (F.col("times") * _distance(F.col("p"), F.col("q0"))).alias("value"))
    others = beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * _distance(F.col("q0"), F.col("p"))).alias("value"))
    # Two rows of groups of one language make a pair, as the result has one for each.
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"), F.col("terms").alias("other_terms"))
    p0, q0 = _share(F.lit(0), _whole("total")), _share(F.lit(0), _whole("other_total"))
    rest = (F.col("v") - F.col("terms") - F.col("other_terms")) * _distance(p0, q0)
    rest = groups.select("lang", "source", "total", "terms", "v").join(other, "lang").filter("source != item").select("lang", "source", "item", rest.alias("value"))
    pairs = rest.unionByName(mine).unionByName(others).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    # Of terms, every task hands on the first ones of a group only.
    return pairs.unionByName(parts.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= most))
