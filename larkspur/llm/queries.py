"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shipping import ship

from . import decontamination, divergence, licenses, line_dedup, mixing, periodic, pii, rules, secrets, sharding, simhash, suffix_dedup, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def run(f, spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    def add(f):
        QUERIES[name] = partial(run, f)
        if sql:
            SQL[name] = sql
        return f

    return add


#: DuckDB: one row per source with its target, by the closed form of water-filling.
TARGETS_SQL = r"""
sized AS (SELECT doc_id, source, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS pool,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM weighed),
marked AS (SELECT *, (pool - used) * w >= cap * rest_w AS is_full FROM levels),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (pool - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () * w END AS target FROM marked),
"""

OP3_SQL = (
    "WITH "
    + TARGETS_SQL
    + r"""
circles AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
    ('0x' || substr(md5('42:start' || coalesce(':' || source, '')), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE * source_size AS c0 FROM targets),
placed AS (SELECT doc_id, size, c.*, c0 + (target - times * source_size) AS stop,
    sum(size) OVER (PARTITION BY sized.source ORDER BY u RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY sized.source, u) AS place
    FROM sized JOIN circles c ON sized.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN stop >= source_size AND target > times * source_size THEN place >= c0 OR place < stop - source_size ELSE place >= c0 AND place < stop END::INT))::BIGINT AS taken FROM placed
"""
)


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measured AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_kinds,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeats USING (doc_id)),
bits AS (SELECT *, n_lines - n_kinds AS n_dup_lines, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 15 * n_words)::INT + 32 * (100 * (n_lines - n_kinds) > 50 * n_lines)::INT AS b FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (b & 3) <> 0 AS base_failed, b = 0 AS kept, b::BIGINT AS fail_bits FROM bits
"""


@query("op5_rules", OP5_SQL)
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.ledger(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes(F.col("fail_bits"), "base-1")).alias("base_failed"), rules.passes(F.col("fail_bits"), "quality-1").alias("kept"), "fail_bits")


RULES_SQL = (
    OP5_SQL[: OP5_SQL.rindex("SELECT doc_id")]
    + "SELECT rule, count(*) FILTER ((b >> k) & 1 = 1) AS n_failed, count(*) FILTER (b = 1 << k) AS n_only, count(*) FILTER (b = 0 OR b = 1 << k) AS n_kept_without FROM bits, (VALUES "
    + ", ".join(f"({r.bit}, '{r.name}')" for r in rules.RULES)
    + ") v(k, rule) GROUP BY rule"
)


@query("rules_ablation", RULES_SQL)
def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy decides, from op5's ledger."""
    return rules.ablation(rules.ledger(table(spark, sf_dir, "documents")), "quality-1")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (SELECT DISTINCT item_id, len(g) AS size, array_to_string(g, ' ') AS g FROM
    (SELECT item_id, ws[i : least(i + 9, len(ws))] AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0))),
spans AS (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM
    (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM items) WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM spans JOIN items USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    tests = lambda which: F.size(F.filter("judged", which)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("found").alias("spans"), tests(lambda t: F.lit(True)).alias("n_tested"), tests(lambda t: t["fixed"] & t["random"]).alias("n_base_random"), tests(lambda t: ~t["fixed"] & t["random"]).alias("n_random"))


OP7_SQL = (
    "WITH templates AS (SELECT id, license, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM (VALUES "
    + ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))
    + r""") v(id, license, t)),
tgrams AS (SELECT id, license, len(ws) - 1 AS size, g, count(*) AS n FROM (SELECT id, license, ws, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM templates) GROUP BY ALL),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS ws
    FROM (SELECT doc_id, unnest([t] || string_split_regex(t, '\n[\x20\t\r]*\n') || string_split(t, chr(10))) AS u FROM texts)),
fitting AS (SELECT row_number() OVER () AS k, doc_id, ws FROM units WHERE len(ws) BETWEEN 2 AND (SELECT max(len(ws)) * 3 // 2 + 2 FROM templates)),
ugrams AS (SELECT k, doc_id, len(ws) - 1 AS size, g, count(*) AS n FROM (SELECT k, doc_id, ws, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM fitting) GROUP BY ALL),
dices AS (SELECT u.k, u.doc_id, t.license, 2.0::DOUBLE * sum(least(u.n, t.n)) / (any_value(t.size) + any_value(u.size)) AS dice FROM ugrams u JOIN tgrams t USING (g) GROUP BY u.k, u.doc_id, t.id, t.license),
best AS (SELECT doc_id, count(*)::BIGINT AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice FROM dices WHERE dice >= 0.8 GROUP BY doc_id),
first AS (SELECT doc_id, min(license) AS best_license FROM dices JOIN best USING (doc_id) WHERE dice = best_dice GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN first USING (doc_id)
"""
)


@query("op7_licenses", OP7_SQL)
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.get("matches", F.lit(0))["license"].alias("best_license"),
        F.get("matches", F.lit(0))["dice"].alias("best_dice"),
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(scored).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP11_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
known AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN known USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""


@query("op11_lines", OP11_SQL)
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB, with a row for every kept term and group.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
occurring AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM occurring GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::BIGINT AS p,
    1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 1)::BIGINT // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang, source))::BIGINT AS q FROM counted),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 200
"""


@query("op12_divergence", OP12_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_periodic")
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], rewrite=periodic.planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("longest", longest).withColumns({"start": -F.col("longest.start"), "length": F.col("longest.length"), "period": -F.col("longest.period")})
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.call_function("div", 1000 * F.col("length"), F.col("period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
