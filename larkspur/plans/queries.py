"""Registry of the catalogue queries: each operator over the driver's tables, with equivalent SQL where there is any.

The tables hold no photos, so `documents` plays the catalogue: a path from source, language and id, the text's md5 as content
hash, and further columns derived from the id by the formulas below, which Spark and DuckDB read alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import datetime
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.operators import browse, decisions, duplicates, layout, maintained, paging, reconcile, sidecars, similar, vision
from larkspur.sources import files as sources
from larkspur.sources import sinks
from larkspur.sources.shipping import ship
from larkspur.sources.staging import fresh_path, spread, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKEN = re.compile(r"[^ \t\n\r]+")
NOW = datetime(2024, 6, 1, 12, 0, 0)

PATH = "concat(source, '/', lang, '/', cast(doc_id AS string), CASE WHEN doc_id % 5 = 0 THEN '.mp4' ELSE '.jpg' END)"
TWO = "lpad(cast({} AS string), 2, '0')"
FILES = {
    "id": "doc_id",
    "path": PATH,
    "kind": "CASE WHEN doc_id % 5 = 0 THEN 'video' ELSE 'photo' END",
    "ext": "CASE WHEN doc_id % 5 = 0 THEN '.mp4' ELSE '.jpg' END",
    "size": "n_chars",
    "sha1": "md5(text)",
    "taken_at": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat(cast(1995 + doc_id % 9 AS string), '-', " + TWO.format("1 + doc_id % 12") + ", '-', " + TWO.format("1 + doc_id % 28") + ", 'T', " + TWO.format("doc_id % 24") + ", ':00:00') END",
    "date_source": "CASE doc_id % 6 WHEN 0 THEN 'exif' WHEN 1 THEN 'google' WHEN 2 THEN 'filename' WHEN 3 THEN 'folder' WHEN 4 THEN 'mtime' END",
    "width": "cast(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 100 + doc_id % 7 * 50 END AS int)",
    "height": "cast(100 + doc_id % 5 * 40 AS int)",
    "make": "CASE WHEN doc_id % 9 = 0 THEN 'maker' END",
    "content_id": "CASE WHEN doc_id % 8 = 0 THEN concat('c', cast(doc_id % 100 AS string)) END",
    "pair_key": "CASE WHEN doc_id % 3 <> 1 THEN concat('p', cast(doc_id - doc_id % 4 AS string)) END",
    "has_sidecar": "cast(doc_id % 2 AS int)",
    "scanned_at": "concat('2024-05-', " + TWO.format("1 + doc_id % 30") + ")",
    "lat": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE cast(doc_id * 37 % 18000 AS double) / 100 - 90 END",
    "lon": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE cast(doc_id * 91 % 36000 AS double) / 100 - 180 END",
    "geo_source": "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'exif' ELSE 'google' END",
    "geo_done": "cast(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS int)",
}
OVERRIDES = {"path": PATH, "taken_at": "concat('2010-05-', " + TWO.format("1 + doc_id % 28") + ", 'T12:00:00')"}
MARKS = {"path": PATH, "mark": "CASE WHEN toxic = 1 THEN 'trash' WHEN quality = 1 THEN 'keep' ELSE 'discard' END", "keeper": "cast(NULL AS string)", "used_batch": "CASE WHEN doc_id % 7 = 0 THEN 'b1' END"}
#: Which documents play members of a group: the others, shorter ones, are files outside of any.
MEMBER = "n_chars >= 300"
GROUPED = {"group_id": "doc_id - doc_id % 7", "path": PATH}
HASHES = {"path": PATH, "sharp": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(doc_id * 7 % 50 AS double) / 10 END"}
VISION = {"path": PATH, "status": "CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'ok' END", "faces": "cast(doc_id % 4 AS int)", "eyes_closed": "cast(toxic AS int)", "looking_away": "cast(0 AS int)", "note": "''"}


def select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


CTE = {
    "files": f"SELECT {select(FILES)} FROM documents",
    "overrides": f"SELECT {select(OVERRIDES)} FROM documents WHERE doc_id % 17 IN (3, 4)",
    "excluded": f"SELECT {PATH} AS path FROM documents WHERE doc_id % 19 = 5",
    "marks": f"SELECT {select(MARKS)} FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 35 < 25 OR toxic IS NOT NULL",
    "grouped": f"SELECT {select(GROUPED)} FROM documents WHERE {MEMBER}",
    "hashes": f"SELECT {select(HASHES)} FROM documents",
    "vision": f"SELECT {select(VISION)} FROM labels JOIN documents USING (doc_id)",
    "grid": "SELECT p_partkey AS id, cast(p_size AS double) / 5 AS lat, (p_retailprice - 900) / 20 AS lon FROM part",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " "


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame of CTE, from Spark's own reader."""
    docs = load(spark, sf_dir, "documents")
    labelled = lambda: load(spark, sf_dir, "labels").join(docs, "doc_id")
    pick = lambda df, cols: df.selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])
    return {
        "files": lambda: pick(docs, FILES),
        "overrides": lambda: pick(docs.filter("doc_id % 17 in (3, 4)"), OVERRIDES),
        "excluded": lambda: pick(docs.filter("doc_id % 19 = 5"), {"path": PATH}),
        "marks": lambda: pick(docs.join(load(spark, sf_dir, "labels"), "doc_id", "left").filter("doc_id % 35 < 25 or toxic is not null"), MARKS),
        "grouped": lambda: pick(docs.filter(MEMBER), GROUPED),
        "hashes": lambda: pick(docs, HASHES),
        "vision": lambda: pick(labelled(), VISION),
        "grid": lambda: load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "cast(p_size AS double) / 5 AS lat", "(p_retailprice - 900) / 20 AS lon"),
    }[name]()


def query(name: str, sql: str | None, *frames: str):
    """Register a query over named frames; a function without frames takes (spark, sf_dir)."""

    def run(f, spark, sf_dir):
        ship(spark)
        return f(*[base(spark, sf_dir, n) for n in frames]) if frames else f(spark, sf_dir)

    def add(f):
        QUERIES[name] = partial(run, f)
        if sql:
            SQL[name] = sql
        return f

    return add


SOURCE = "CASE WHEN instr({0}, '/') > 0 THEN split_part({0}, '/', 1) ELSE '' END"
VISIBLE = "NOT (kind = 'video' AND pair_key IS NOT NULL)"
V1 = "v1 AS (SELECT f.* EXCLUDE (taken_at, date_source), coalesce(o.taken_at, f.taken_at) AS taken_at, CASE WHEN o.taken_at IS NOT NULL THEN 'manual' ELSE f.date_source END AS date_source FROM files f LEFT JOIN overrides o USING (path))"

# Projections, browsing and facets


@query("j1_overlay", with_("files", "overrides") + f", {V1} SELECT path, taken_at, date_source FROM v1", "files", "overrides")
def _(files, overrides):
    return browse.overlay(files, overrides).select("path", "taken_at", "date_source")


@query("pr2_located", with_("files", "overrides") + f", {V1} SELECT path, lat, lon, taken_at FROM v1 WHERE lat IS NOT NULL", "files", "overrides")
def _(files, overrides):
    return browse.located(files, overrides).select("path", "lat", "lon", "taken_at")


ROOTS = ["src1", "src2"]


@query(
    "pr3_sources",
    with_("files") + f"SELECT id, {SOURCE.format('path')} AS one, CASE WHEN split_part(path, '/', 1) IN ('src1', 'src2') AND len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS two, CASE split_part(path, '/', 1) WHEN 'src0' THEN 'First' ELSE split_part(path, '/', 1) END AS label, CASE split_part(path, '/', 1) WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS rank FROM files",
    "files",
)
def _(files):
    one = X.one_level_source(F.col("path"))
    two = X.two_level_source(F.col("path"), ROOTS)
    return files.select("id", one.alias("one"), two.alias("two"), X.label(one, {"src0": "First"}).alias("label"), X.source_rank(two, ["src3", "src1"]).alias("rank"))


@query("a2_source_counts", with_("files") + f"SELECT {SOURCE.format('path')} AS source, count(*) AS n FROM files GROUP BY 1", "files")
def _(files):
    return browse.count_by(files, X.one_level_source(F.col("path")), "source")


@query("a3_year_counts", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return browse.count_by(load(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy"), "year")


@query("a4_grand_totals", with_("files") + "SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM files", "files")
def _(files):
    return browse.totals(files)


@query("a5_bounds", with_("grid") + "SELECT count(*) AS n, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM grid", "grid")
def _(grid):
    return browse.bounds(grid)


@query(
    "a6_grid_cells",
    with_("grid") + "SELECT floor((lat + 90) / (84.375::DOUBLE / 32))::BIGINT AS cell_lat, floor((lon + 180) / (84.375::DOUBLE / 32))::BIGINT AS cell_lon, count(*) AS n, round(avg(lat), 6) AS avg_lat, min(lat) AS min_lat, max(lat) AS max_lat, round(avg(lon), 6) AS avg_lon, min(lon) AS min_lon, max(lon) AS max_lon, min(id) AS first_id FROM grid GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 2500",
    "grid",
)
def _(grid):
    return browse.geo_cells(grid, 5).withColumns({c: F.round(c, 6) for c in ("avg_lat", "avg_lon")})


@query("fl5_laid_out_box", with_("files") + "SELECT id, lat, lon FROM files WHERE lat BETWEEN -10.5 AND 20 AND lon BETWEEN 5 AND 60.25", "files")
def _(files):
    """A box of a table that lies along a curve over the map."""
    spark, at = files.sparkSession, fresh_path(files.sparkSession, "located")
    layout.write_located(files.select("id", "lat", "lon"), at, 4 * spark.sparkContext.defaultParallelism)
    return layout.within(spark.read.parquet(at), (-10.5, 5.0, 20.0, 60.25))


MONTHS = ", ".join(f"coalesce(sum((m = {k})::INT), 0)::BIGINT AS m{k:02d}" for k in range(1, 13))


@query(
    "a7_timeline",
    f"WITH o AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE o_orderdate < '1998-01-01' OR o_orderdate >= '1999-01-01'), g AS (SELECT unnest(range(min(y), max(y) + 1)) AS year FROM o), c AS (SELECT year::INT AS year, {MONTHS}, count(m)::BIGINT AS total FROM g LEFT JOIN o ON y = year GROUP BY 1) SELECT *, greatest(1, (SELECT max(greatest({', '.join(f'm{k:02d}' for k in range(1, 13))})) FROM c))::BIGINT AS fullest FROM c",
)
def _(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderdate < '1998-01-01' or o_orderdate >= '1999-01-01'")
    return browse.timeline(o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("taken_at")), 2023)


@query("fl1_visible", with_("files") + f"SELECT id FROM files WHERE {VISIBLE}", "files")
def _(files):
    return files.filter(X.visible(F.col("kind"), F.col("pair_key"))).select("id")


@query("fl2_prefix", with_("files") + r"SELECT id FROM files WHERE path ILIKE 'SRC1/%'", "files")
def _(files):
    return files.filter(X.has_prefix(F.col("path"), "SRC1/")).select("id")


@query("fl3_contains", "SELECT page_id FROM pages WHERE contains(lower(url), 'http_') UNION ALL SELECT page_id FROM pages WHERE contains(lower(url), 'a')")
def _(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.filter(X.contains(F.col("url"), "HTTP_")).select("page_id").unionByName(p.filter(X.contains(F.col("url"), "A")).select("page_id"))


@query("fl10_children", with_("files") + r"SELECT id FROM files WHERE path ILIKE 'src1/en/%' AND instr(substr(path, 9), '/') = 0", "files")
def _(files):
    return files.filter(X.direct_child(F.col("path"), "src1/en")).select("id")


@query("so1_by_cursor", with_("files", "overrides") + f", {V1} SELECT id, path, taken_at FROM v1 WHERE {VISIBLE} AND kind = 'photo' ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40", "files", "overrides")
def _(files, overrides):
    """The third page, from the last rows of the two before."""
    b, at = browse.Browse(kind="photo"), ""
    rows = browse.overlay(files, overrides).filter(b.condition())
    for _ in range(2):
        at = paging.cursor(paging.next_page(rows, b.keys(), 20, at).collect()[-1], b.keys())  # a page
    return paging.next_page(rows, b.keys(), 20, at).select("id", "path", "taken_at")


@query(
    "so1_page",
    with_("files", "overrides") + f", {V1} SELECT id, path, taken_at FROM v1 WHERE {VISIBLE} AND kind = 'photo' AND substr(taken_at, 6, 2) = '03' AND path ILIKE 'src%' ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20",
    "files",
    "overrides",
)
def _(files, overrides):
    b = browse.Browse(kind="photo", month="3", text="SRC", source="nowhere", year="20x4")
    return browse.page(browse.overlay(files, overrides).filter(b.condition(["src0"])), b.order(), 2, 20).select("id", "path", "taken_at")


@query(
    "fl5_browse",
    with_("files", "overrides") + f", {V1} SELECT id FROM v1 WHERE {VISIBLE} AND path ILIKE 'src2/%' AND substr(taken_at, 1, 4) = '1997' AND pair_key IS NOT NULL AND lat BETWEEN -80 AND 80 AND lon BETWEEN -170 AND 170",
    "files",
    "overrides",
)
def _(files, overrides):
    b = browse.Browse(source="src2", year="1997", live=True, bbox="-80,-170,80,170", date_source="nothing such")
    return browse.overlay(files, overrides).filter(b.condition()).select("id")


@query("a26_profile", with_("files") + "SELECT 'ext' AS facet, ext AS key, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'date_source', coalesce(date_source, 'none'), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'year', substr(taken_at, 1, 4), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'geo_source', coalesce(geo_source, 'none'), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'figure', 'pair_keys', count(DISTINCT pair_key) FROM files UNION ALL SELECT 'figure', 'sidecars', sum(has_sidecar)::BIGINT FROM files UNION ALL SELECT 'figure', 'unchecked', sum((geo_done = 0)::INT)::BIGINT FROM files", "files")
def _(files):
    return browse.profile(files)


@query(
    "a28_pair_keys",
    with_("files") + ", cid AS (SELECT content_id FROM files WHERE content_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT id, content_id, kind, lower(regexp_replace(path, '[.][^./]*$', '')) AS stem, content_id IN (SELECT content_id FROM cid) AS shared FROM files), s2 AS (SELECT id, kind, CASE WHEN shared THEN content_id END AS cid, stem FROM s), both_ AS (SELECT stem FROM s2 WHERE cid IS NULL GROUP BY 1 HAVING count(DISTINCT kind) = 2) SELECT id, CASE WHEN cid IS NOT NULL THEN 'cid:' || cid WHEN stem IN (SELECT stem FROM both_) THEN 'stem:' || stem END AS pair_key FROM s2",
    "files",
)
def _(files):
    return browse.pair_keys(files).select("id", "pair_key")


@query("a28_kind_set", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds FROM conversations GROUP BY 1 HAVING string_agg(DISTINCT role, ',' ORDER BY role) = 'assistant,user'")
def _(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("kinds"))
    return c.filter("kinds = 'assistant,user'")


@query("j9_twins", with_("files") + "SELECT id, min(id) OVER (PARTITION BY sha1, size) AS class_id, count(*) OVER (PARTITION BY sha1, size) - 1 AS n_twins FROM files WHERE sha1 IS NOT NULL AND size IS NOT NULL QUALIFY n_twins > 0", "files")
def _(files):
    return browse.twin_classes(files)


@query("j9_twins_of", with_("files") + "SELECT a.id, b.id AS twin_id FROM files a JOIN files b ON a.sha1 = b.sha1 AND a.size = b.size AND a.id <> b.id WHERE a.id % 20 = 0", "files")
def _(files):
    return browse.twins(files.filter("id % 20 = 0"), files)


@query(
    "j10_partner",
    with_("files") + "SELECT id, partner_id, partner_kind FROM (SELECT a.id, b.id AS partner_id, b.kind AS partner_kind, row_number() OVER (PARTITION BY a.id ORDER BY (b.kind = 'video') DESC, (b.path ILIKE regexp_replace(a.path, '/[^/]*$', '') || '/%') DESC, b.id) AS r FROM files a JOIN files b ON a.pair_key = b.pair_key AND a.id <> b.id) WHERE r = 1",
    "files",
)
def _(files):
    return browse.partner(files)


@query("j11_with_partners", with_("files") + ", c AS (SELECT * FROM files WHERE id % 50 = 2) SELECT path FROM c UNION SELECT path FROM files WHERE pair_key IN (SELECT pair_key FROM c)", "files")
def _(files):
    return browse.with_partners(files.filter("id % 50 = 2"), files).select("path")


# Exact duplicates and the clean-up plan

DUP = "dup AS (SELECT sha1, size, count(*) AS n FROM files WHERE sha1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"


@query("a8_exact_dup_groups", with_("files") + f", {DUP} SELECT * FROM dup ORDER BY size DESC, sha1 LIMIT 200", "files")
def _(files):
    return duplicates.largest_groups(files)


@query("a8_members", with_("files") + f", {DUP} SELECT id, sha1, size FROM files SEMI JOIN dup USING (sha1, size)", "files")
def _(files):
    return duplicates.members(files, duplicates.exact_groups(files)).select("id", "sha1", "size")


@query("a9_dup_surplus", with_("files") + f", {DUP} SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS spare, coalesce(sum((n - 1) * size), 0)::BIGINT AS bytes FROM dup", "files")
def _(files):
    return duplicates.surplus(files)


ORDER = ["src3", "src1", "src2"]
RANK = "CASE split_part({0}, '/', 1) WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END"
#: The rules' sources are of two levels below src1; elsewhere of one.
SRC = "CASE WHEN split_part({0}, '/', 1) = 'src1' THEN 'src1/' || split_part({0}, '/', 2) ELSE split_part({0}, '/', 1) END"
PLAN = (
    f"{DUP}, ranked AS (SELECT f.*, o.taken_at AS override, row_number() OVER (PARTITION BY sha1, size ORDER BY (pair_key IS NULL), {RANK.format('path')}, (has_sidecar = 0), len(regexp_extract(path, '[^/]*$')), path) AS r FROM files f SEMI JOIN dup USING (sha1, size) LEFT JOIN overrides o USING (path)), "
    f"lone AS (SELECT DISTINCT pair_key FROM files WHERE pair_key IS NOT NULL AND sha1 NOT IN (SELECT sha1 FROM dup)), "
    f"plan AS (SELECT {SRC.format('k.path')} AS keep_src, {SRC.format('v.path')} AS remove_src, CASE WHEN v.path IN (SELECT path FROM excluded) THEN 'excluded by hand' WHEN v.override <> k.override THEN 'both copies have a date set by hand, and they differ' WHEN v.pair_key IN (SELECT pair_key FROM lone) THEN 'half of a pair whose other half has no copy' END AS reason, k.path AS keeper, v.path AS victim, v.sha1, v.size FROM ranked v JOIN ranked k ON v.sha1 = k.sha1 AND v.size = k.size AND k.r = 1 AND v.r > 1)"
)
APPROVALS = "approvals AS (SELECT id, keep_src, remove_src, cap FROM (SELECT keep_src, remove_src, count(*) AS n FROM plan WHERE reason IS NULL GROUP BY 1, 2), (VALUES (1, 1), (2, 2), (3, 1)) v(id, cap))"


def planned(files, overrides, excluded):
    return duplicates.plan(files, overrides, excluded, ORDER, ["src1"])


def approved(plan):
    rules = duplicates.rollup(plan).select("keep_src", "remove_src")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("cap")) for i, c in ((1, 1), (2, 2), (3, 1))])).alias("a")
    return rules.select("keep_src", "remove_src", each).select("a.id", "keep_src", "remove_src", "a.cap", F.lit(None).cast("string").alias("used_batch"))


PLANNED = ("files", "overrides", "excluded")


@query("a16_keeper_victims", with_(*PLANNED) + f", {PLAN} SELECT keeper, victim FROM plan", *PLANNED)
def _(*frames):
    return planned(*frames).select("keeper", "victim")


@query("w1_plan", with_(*PLANNED) + f", {PLAN} SELECT * FROM plan", *PLANNED)
def _(*frames):
    return planned(*frames)


@query("w1_plan_rollup", with_(*PLANNED) + f", {PLAN} SELECT keep_src, remove_src, count(*) AS n, sum(size)::BIGINT AS bytes FROM plan WHERE reason IS NULL GROUP BY 1, 2", *PLANNED)
def _(*frames):
    return duplicates.rollup(planned(*frames))


@query("w1_held_reasons", with_(*PLANNED) + f", {PLAN} SELECT reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM plan WHERE reason IS NOT NULL GROUP BY 1", *PLANNED)
def _(*frames):
    return duplicates.held(planned(*frames))


@query("j12_orphan_guard", with_(*PLANNED) + f", {PLAN} SELECT victim FROM plan WHERE reason LIKE 'half%'", *PLANNED)
def _(*frames):
    return planned(*frames).filter(F.col("reason") == duplicates.ORPHAN).select("victim")


@query(
    "j26_capped_allocation",
    with_(*PLANNED) + f", {PLAN}, {APPROVALS}, spans AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY keep_src, remove_src ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM approvals), ranks AS (SELECT *, row_number() OVER (PARTITION BY keep_src, remove_src ORDER BY victim) - 1 AS r FROM plan WHERE reason IS NULL) SELECT id AS approval_id, victim, keeper FROM ranks JOIN spans USING (keep_src, remove_src) WHERE r >= lo AND r < lo + cap",
    *PLANNED,
)
def _(*frames):
    plan = staged(planned(*frames), "plan")  # rules, approvals and allocation all read it
    return duplicates.allocate(plan, staged(approved(plan), "approvals"))


@query("a35_pending_rules", with_(*PLANNED) + f", {PLAN}, {APPROVALS} SELECT keep_src, remove_src, n, bytes, '1,2,3' AS approvals, 4::BIGINT AS caps FROM (SELECT keep_src, remove_src, count(*) AS n, sum(size)::BIGINT AS bytes FROM plan WHERE reason IS NULL GROUP BY 1, 2)", *PLANNED)
def _(*frames):
    plan = staged(planned(*frames), "plan")
    return duplicates.pending_by_rule(plan, approved(plan)).withColumn("approvals", F.array_join(F.col("approvals").cast("array<string>"), ","))


@query(
    "w4_verified",
    with_(*PLANNED) + f", {PLAN}, seen AS (SELECT path, CASE WHEN id % 5 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN id % 7 = 1 THEN 'x' ELSE sha1 END AS sha1 FROM files WHERE id % 11 <> 2) SELECT victim, CASE WHEN v.path IS NULL OR k.path IS NULL THEN 'file missing on disk' WHEN v.size <> plan.size OR k.size <> plan.size THEN 'size changed since scan' WHEN v.sha1 <> plan.sha1 OR k.sha1 <> plan.sha1 THEN 'SHA-1 differs from the index' END AS why FROM plan LEFT JOIN seen v ON v.path = victim LEFT JOIN seen k ON k.path = keeper",
    *PLANNED,
)
def _(files, overrides, excluded):
    seen = files.filter("id % 11 <> 2").selectExpr("path", "CASE WHEN id % 5 = 1 THEN size + 1 ELSE size END AS size", "CASE WHEN id % 7 = 1 THEN 'x' ELSE sha1 END AS sha1")
    return duplicates.verified(planned(files, overrides, excluded), seen).select("victim", "why")


@query("so5_seeded_order", with_(*PLANNED) + f", {PLAN} SELECT victim FROM plan ORDER BY md5('7:' || victim), victim LIMIT 50", *PLANNED)
def _(*frames):
    return vision.sample(planned(*frames), 50, 7, "victim").select("victim")


@query(
    "j31_sidecars",
    "WITH m AS (SELECT 'd' || doc_id % 3 || '/' || doc_id || '.jpg' AS path, doc_id FROM documents), l AS (SELECT regexp_replace(path, 'jpg$', CASE doc_id % 4 WHEN 0 THEN 'jpg.json' WHEN 1 THEN 'AAE' WHEN 2 THEN 'xmp' ELSE 'txt' END) AS sidecar, path, doc_id FROM m) SELECT path, sidecar FROM l WHERE doc_id % 4 <> 3",
)
def _(spark, sf_dir):
    m = load(spark, sf_dir, "documents").selectExpr("concat('d', doc_id % 3, '/', doc_id, '.jpg') AS path", "doc_id")
    listing = m.selectExpr("regexp_replace(path, 'jpg$', CASE doc_id % 4 WHEN 0 THEN 'jpg.json' WHEN 1 THEN 'AAE' WHEN 2 THEN 'xmp' ELSE 'txt' END) AS path")
    return duplicates.sidecars(listing, m)


@query("j5_tuple_semi", with_("files") + "SELECT id FROM files WHERE (sha1, size) IN (SELECT sha1, size FROM files WHERE id % 2 = 1) AND id % 2 = 0", "files")
def _(files):
    return files.filter("id % 2 = 0").join(files.filter("id % 2 = 1").select("sha1", "size"), ["sha1", "size"], "left_semi").select("id")


@query("j7_not_exists", with_("files", "marks") + "SELECT id FROM files f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND used_batch IS NOT NULL)", "files", "marks")
def _(files, marks):
    return files.join(marks.filter("used_batch is not null").select("path"), "path", "left_anti").select("id")


@query("j30_has_override", with_("files", "overrides") + "SELECT id, path IN (SELECT path FROM overrides) AS has_override FROM files", "files", "overrides")
def _(files, overrides):
    return files.join(browse.small(overrides.select("path", F.lit(True).alias("o"))), "path", "left").select("id", F.coalesce("o", F.lit(False)).alias("has_override"))


# Near-duplicates

TOKEN_BITS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
PRINTS = (
    "tokens AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents)), "
    f"sums AS (SELECT doc_id, {TOKEN_BITS} FROM tokens GROUP BY 1), "
    "prints AS (SELECT doc_id, " + " | ".join(f"CASE WHEN b{b} > 0 THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64)) + " AS h FROM sums)"
)


def _prints(batches):
    """(key, hash) of (key, text): the majority of each bit over the distinct tokens' hashes; texts without tokens have none."""
    known: dict[str, int] = {}
    for batch in batches:
        keys, out = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = set(TOKEN.findall(text or ""))
            if not tokens:
                continue
            if len(known) > 400_000:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
            bits = np.unpackbits(np.array([known[t] for t in tokens], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            keys.append(key)
            out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(tokens), bitorder="little").view(np.int64)[0])
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(out, pa.int64())], names=["key", "hash"])


def text_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, hash): a 64-bit fingerprint of each text, the sign of summed token bits; the stand-in for image hashes.

    One pass within rows: no token is shuffled.
    """
    docs = spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
    kind = docs.schema["key"].dataType.simpleString()
    return staged(docs.mapInArrow(_prints, f"key {kind}, hash long"), "prints")  # the joins below read it several times


@query("nd6_simhash_edges", f"WITH {PRINTS} SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.h, b.h))::INT AS d FROM prints a JOIN prints b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 5")
def _(spark, sf_dir):
    return similar.edges(text_prints(spark, sf_dir), 5)


CLASSES = "classes AS (SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY h) AS rep, h FROM prints), reps AS (SELECT rep, h FROM classes WHERE key = rep)"


@query("nd6_classes", f"WITH {PRINTS}, {CLASSES} SELECT key, rep FROM classes")
def _(spark, sf_dir):
    return similar.classes(text_prints(spark, sf_dir)).select("key", "rep")


@query("nd6_links", f"WITH {PRINTS}, {CLASSES} SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.h, b.h))::INT AS d FROM reps a JOIN reps b ON a.rep < b.rep AND bit_count(xor(a.h, b.h)) <= 5")
def _(spark, sf_dir):
    return similar.links(text_prints(spark, sf_dir), 5)


@query("nd5_crowded_buckets", f"WITH {PRINTS}, e AS (SELECT i AS band, (h >> round(i * 64 / 6)::INT) & ((1::UBIGINT << (round((i + 1) * 64 / 6)::INT - round(i * 64 / 6)::INT)) - 1) AS value FROM prints, (SELECT unnest(range(6)) AS i)) SELECT band::INT AS band, value::BIGINT AS value, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 5")
def _(spark, sf_dir):
    return similar.crowded(text_prints(spark, sf_dir), 5, 5)


@query("nd7_groups", None)
def _(spark, sf_dir):
    return similar.groups(text_prints(spark, sf_dir), 5, 3)


@query("nd8_groups_of_copies", with_("grouped", "files") + "SELECT group_id, path FROM grouped WHERE group_id IN (SELECT group_id FROM grouped JOIN files USING (path) GROUP BY 1 HAVING count(DISTINCT sha1) > 1 OR count(sha1) < count(*))", "grouped", "files")
def _(grouped, files):
    return similar.without_copies(grouped, files)


FLAGS = (
    "m AS (SELECT g.*, coalesce(width, 0) * coalesce(height, 0) AS px, size, CASE WHEN coalesce(sharp, 0) = 0 THEN -1 ELSE sharp END AS s FROM grouped g JOIN files USING (path) LEFT JOIN hashes USING (path)), "
    "flags AS (SELECT group_id, path, (row_number() OVER (PARTITION BY group_id ORDER BY px DESC, size DESC, path) = 1)::INT AS is_best, (row_number() OVER (PARTITION BY group_id ORDER BY s DESC, px DESC, path) = 1)::INT AS is_sharpest FROM m)"
)
FLAGGED = ("grouped", "files", "hashes")


@query("a17_best_sharpest", with_(*FLAGGED) + f", {FLAGS} SELECT * FROM flags", *FLAGGED)
def _(*frames):
    return similar.flagged(*frames)


SPANS = "spans AS (SELECT group_id, CASE WHEN count(t) >= 2 THEN max(t) - min(t) END AS span_s FROM (SELECT group_id, CASE WHEN date_source = 'exif' THEN epoch(taken_at::TIMESTAMP)::BIGINT END AS t FROM grouped JOIN files USING (path)) GROUP BY 1)"


@query("a20_span", with_("grouped", "files") + f", {SPANS} SELECT * FROM spans", "grouped", "files")
def _(grouped, files):
    return similar.spans(grouped, files)


@query("a20_span_events", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(*) >= 2 THEN epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT END AS span_s FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), X.seconds_of(X.iso(F.col("ts"))).alias("t"))
    return e.groupBy("user_id", "day").agg(F.when(F.count("t") >= 2, F.max("t") - F.min("t")).alias("span_s"))


@query("j4_neighbours", with_("grouped", "files") + "SELECT a.path, b.path AS other FROM grouped a JOIN grouped b USING (group_id) JOIN files f ON f.path = a.path WHERE a.path <> b.path AND f.id % 20 = 0", "grouped", "files")
def _(grouped, files):
    return similar.neighbours(files.filter("id % 20 = 0"), grouped)


@query("a10_group_totals", with_(*FLAGGED) + f", {FLAGS} SELECT count(DISTINCT group_id) AS groups, count(*) AS photos, coalesce(sum(CASE WHEN is_best = 0 THEN size END), 0)::BIGINT AS spare FROM flags JOIN files USING (path)", *FLAGGED)
def _(grouped, files, hashes):
    return similar.group_totals(similar.flagged(grouped, files, hashes), files)


LISTED = (*FLAGGED, "marks")
LIST = f"{FLAGS}, {SPANS}, listed AS (SELECT group_id, count(*) AS n, (sum(size) - coalesce(sum(CASE WHEN is_best = 1 THEN size END), 0))::BIGINT AS spare, count(DISTINCT {SOURCE.format('path')}) AS n_sources, CASE WHEN count(DISTINCT {SOURCE.format('path')}) > 1 THEN string_agg(DISTINCT {SOURCE.format('path')}, ',' ORDER BY {SOURCE.format('path')}) END AS sources, max(span_s) AS span_s, min(taken_at) AS oldest, max(taken_at) AS newest, sum((mark IS NULL)::INT) AS open, sum((scanned_at = '2024-05-07')::INT) AS new, sum((path ILIKE 'src3/%')::INT) AS hers FROM flags JOIN files USING (path) LEFT JOIN spans USING (group_id) LEFT JOIN marks USING (path) GROUP BY 1)"
OUT = "group_id, n, spare, n_sources, sources, span_s, oldest, newest"


def listed(grouped, files, hashes, marks, **filters):
    flagged = similar.flagged(grouped, files, hashes)
    out = similar.group_list(flagged, files, similar.spans(grouped, files), marks, today="2024-05-07", theirs="src3", **filters)
    return out.withColumn("sources", F.array_join("sources", ","))


@query("a11_group_list", with_(*LISTED) + f", {LIST} SELECT {OUT} FROM listed", *LISTED)
def _(*frames):
    return listed(*frames)


@query("so2_groups_by_cursor", with_(*LISTED) + f", {LIST} SELECT {OUT} FROM listed ORDER BY n DESC, spare DESC, group_id LIMIT 20 OFFSET 40", *LISTED)
def _(*frames):
    """The third page, from the last rows of the two before."""
    rows, by, at = listed(*frames), similar.list_keys("count"), ""
    for _ in range(2):
        at = paging.cursor(similar.next_groups(rows, "count", 20, at).collect()[-1], by)  # a page
    return similar.next_groups(rows, "count", 20, at).drop("undated")


@query("so2_group_page", with_(*LISTED) + f", {LIST} SELECT {OUT} FROM listed ORDER BY spare DESC, group_id LIMIT 20 OFFSET 20", *LISTED)
def _(*frames):
    return browse.page(listed(*frames), similar.list_order("space"), 2, 20)


for _name, _filters, _where in (
    ("fl11_cross", {"kind": "cross"}, "n_sources > 1"),
    ("fl11_spread", {"kind": "spread"}, "span_s > 10"),
    ("fl11_unknown", {"kind": "unknown"}, "span_s IS NULL"),
    ("fl12_new", {"which": "new"}, "new > 0"),
    ("fl12_hers", {"which": "hers"}, "hers > 0"),
    ("fl12_mine", {"which": "mine"}, "hers = 0"),
    ("fl13_pending", {"view": "pending"}, "open > 0"),
    ("a12_decided", {"view": "decided"}, "open = 0"),
):
    query(_name, with_(*LISTED) + f", {LIST} SELECT {OUT} FROM listed WHERE {_where}", *LISTED)(lambda *frames, _f=_filters: listed(*frames, **_f))


REVIEWED = ("grouped", "files", "hashes", "marks", "vision")
REVIEW = (
    "m AS (SELECT g.group_id, path, mark, faces, coalesce(eyes_closed, 0) AS closed, row_number() OVER (PARTITION BY g.group_id ORDER BY coalesce(eyes_closed, 0), coalesce(width, 0) * coalesce(height, 0) DESC, (lat IS NOT NULL) DESC, (pair_key IS NOT NULL) DESC, coalesce(sharp, -1) DESC, size DESC, path) AS r FROM grouped g JOIN files USING (path) LEFT JOIN hashes USING (path) LEFT JOIN marks USING (path) LEFT JOIN (SELECT * FROM vision WHERE status = 'ok') USING (path)), "
    "d AS (SELECT group_id, max(CASE WHEN r = 1 THEN path END) AS suggested, count(*) AS n, sum((mark = 'keep')::INT) AS keeps, sum((mark = 'trash')::INT) AS trashes, count(mark) AS marked, max(CASE WHEN mark = 'keep' THEN path END) AS kept, count(faces) >= 2 AND sum((closed > 0)::INT) > 0 AS can_besttake FROM m GROUP BY 1)"
)


@query("a19_decisions", with_(*REVIEWED) + f", {REVIEW} SELECT group_id, suggested, CASE WHEN keeps = n THEN 'all' WHEN trashes = n THEN 'trash' WHEN keeps = 1 AND marked = n THEN kept ELSE suggested END AS chosen, marked = n AS decided, can_besttake FROM d", *REVIEWED)
def _(*frames):
    return similar.decisions(similar.members(*frames))


@query("a18_suggest", with_(*REVIEWED) + f", {REVIEW} SELECT group_id, suggested FROM d", *REVIEWED)
def _(*frames):
    return similar.decisions(similar.members(*frames)).select("group_id", "suggested")


@query("j3_members", with_(*REVIEWED) + "SELECT g.group_id, path, id, sharp, mark, faces FROM grouped g JOIN files USING (path) LEFT JOIN hashes USING (path) LEFT JOIN marks USING (path) LEFT JOIN (SELECT * FROM vision WHERE status = 'ok') USING (path)", *REVIEWED)
def _(*frames):
    return similar.members(*frames).select("group_id", "path", "id", "sharp", "mark", "faces")


@query("a13_review_totals", with_("grouped", "files", "marks") + ", p AS (SELECT count(*) AS pend_n, coalesce(sum(size), 0)::BIGINT AS pend_bytes FROM marks JOIN files USING (path) WHERE mark IN ('discard', 'trash') AND used_batch IS NULL), g AS (SELECT count(*) AS total, sum((open = 0)::INT)::BIGINT AS done FROM (SELECT group_id, sum((mark IS NULL)::INT) AS open FROM grouped LEFT JOIN marks USING (path) GROUP BY 1)) SELECT *, total - done AS left, round(done * 100.0::DOUBLE / total, 1) AS pct FROM p, g", "grouped", "files", "marks")
def _(*frames):
    return similar.review_totals(*frames)


#: Three batches of decisions: new marks, marks taken back, marks used.
BATCHES = ", m1 AS (SELECT path, CASE WHEN id % 11 = 0 THEN 'trash' ELSE mark END AS mark, CASE WHEN id % 11 = 0 THEN NULL ELSE used_batch END AS used_batch FROM files LEFT JOIN marks USING (path) WHERE id % 11 = 0 OR mark IS NOT NULL), m2 AS (SELECT * FROM m1 WHERE NOT (mark = 'discard' AND used_batch IS NULL)), m3 AS (SELECT path, mark, CASE WHEN mark = 'trash' AND used_batch IS NULL AND path LIKE 'src1%' THEN 'b9' ELSE used_batch END AS used_batch FROM m2)"


@query("a13_maintained_totals", with_("grouped", "files", "marks") + BATCHES + ", p AS (SELECT count(*) AS pend_n, coalesce(sum(size), 0)::BIGINT AS pend_bytes FROM m3 JOIN files USING (path) WHERE mark IN ('discard', 'trash') AND used_batch IS NULL), g AS (SELECT count(*) AS total, sum((open = 0)::INT)::BIGINT AS done FROM (SELECT group_id, sum((mark IS NULL)::INT) AS open FROM grouped LEFT JOIN m3 USING (path) GROUP BY 1)) SELECT *, total - done AS left, round(done * 100.0::DOUBLE / total, 1) AS pct FROM p, g", "grouped", "files", "marks")
def _(grouped, files, marks):
    """The totals after three batches of decisions, from stored aggregates that only follow what each batch changes."""
    now, stored = marks.select("path", "mark", "used_batch"), staged(maintained.counted(grouped, files, marks), "review")
    trash = files.filter("id % 11 = 0").select("path", F.lit("trash").alias("mark"), F.lit(None).cast("string").alias("used_batch"))
    batches = (lambda m: trash, lambda m: m.filter("mark = 'discard' and used_batch is null").limit(0), lambda m: m.filter("mark = 'trash' and used_batch is null and path like 'src1%'").withColumn("used_batch", F.lit("b9")))
    lost = (lambda m: m.join(trash, "path", "left_semi"), lambda m: m.filter("mark = 'discard' and used_batch is null"), lambda m: m.filter("mark = 'trash' and used_batch is null and path like 'src1%'"))
    for made, gone in zip(batches, lost, strict=True):
        before, after = gone(now), made(now)
        stored = staged(maintained.applied(stored, maintained.delta(grouped, files, before, after)), "review")
        now = staged(now.join(before, "path", "left_anti").unionByName(after), "marks")
    return maintained.totals(stored)


@query("a31_vision_order", with_("grouped", "files") + ", s AS (SELECT group_id, (sum(size) - max(size))::BIGINT AS spare FROM grouped JOIN files USING (path) WHERE kind = 'photo' GROUP BY 1 HAVING count(*) >= 2) SELECT *, row_number() OVER (ORDER BY spare DESC, group_id)::INT AS place FROM s", "grouped", "files")
def _(grouped, files):
    return similar.vision_order(grouped, files)


SUBMITTED = f"submitted AS (SELECT doc_id - doc_id % 7 AS submission, {PATH} AS path FROM documents WHERE {MEMBER} AND doc_id % 23 <> 3)"


@query("j29_valid_submissions", with_("grouped", "files", "marks") + f", {SUBMITTED}, w AS (SELECT group_id, count(*) AS whole FROM grouped GROUP BY 1) SELECT submission, count(*) BETWEEN 2 AND 80 AND max(whole) = count(*) AND count(CASE WHEN used_batch IS NOT NULL THEN 1 END) = 0 AS ok FROM submitted JOIN w ON submission = group_id LEFT JOIN marks USING (path) GROUP BY 1", "grouped", "files", "marks")
def _(grouped, files, marks):
    return similar.valid_submissions(submission(files), grouped, files, marks).select("submission", "ok")


def submission(files: DataFrame) -> DataFrame:
    return files.filter(f"{MEMBER.replace('n_chars', 'size')} and id % 23 <> 3").selectExpr("id - id % 7 AS submission", "path", "'all' AS pick")


@query("w3_decide", with_("grouped", "files", "marks") + f", {SUBMITTED}, w AS (SELECT group_id, count(*) AS whole FROM grouped GROUP BY 1), ok AS (SELECT submission FROM submitted JOIN w ON submission = group_id LEFT JOIN marks USING (path) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 80 AND max(whole) = count(*) AND count(CASE WHEN used_batch IS NOT NULL THEN 1 END) = 0), new AS (SELECT path FROM submitted SEMI JOIN ok USING (submission)) SELECT path, mark, used_batch FROM marks WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'keep', NULL FROM new", "grouped", "files", "marks")
def _(grouped, files, marks):
    s = submission(files)
    return decisions.decide(marks.withColumn("set_at", F.lit("t0")), s, similar.valid_submissions(s, grouped, files, marks), "t1").select("path", "mark", "used_batch")


# Decisions and logs

LOG = "log AS (SELECT strftime(ts, '%Y-%m-%d') AS batch, event_id, value::BIGINT AS size, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS moved_at, CASE WHEN event_type = 'purchase' THEN 'r' END AS restored_at, CASE WHEN event_type IN ('error', 'signup') THEN 'p' END AS purged_at FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') AS batch", "event_id", "cast(round(value) AS bigint) AS size", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS moved_at", "CASE WHEN event_type = 'purchase' THEN 'r' END AS restored_at", "CASE WHEN event_type IN ('error', 'signup') THEN 'p' END AS purged_at")


LOG = LOG.replace("value::BIGINT", "round(value)::BIGINT")


@query("a14_batch_state", f"WITH {LOG} SELECT batch, count(*) AS n, sum(size)::BIGINT AS bytes, max(moved_at) AS moved_at, sum((restored_at IS NULL AND purged_at IS NULL)::INT)::BIGINT AS held, count(restored_at) AS restored, count(purged_at) AS purged, coalesce(sum(CASE WHEN restored_at IS NULL AND purged_at IS NULL THEN size END), 0)::BIGINT AS held_bytes FROM log GROUP BY 1")
def _(spark, sf_dir):
    return decisions.batches(log(spark, sf_dir))


@query("w5_purgeable", f"WITH {LOG} SELECT batch, (epoch(max(moved_at)::TIMESTAMP) + 30 * 86400 - epoch(TIMESTAMP '2024-02-15 00:00:00')) / 86400.0 AS days_left, (epoch(max(moved_at)::TIMESTAMP) + 30 * 86400 - epoch(TIMESTAMP '2024-02-15 00:00:00')) <= 0 AS may_purge FROM log WHERE restored_at IS NULL AND purged_at IS NULL GROUP BY 1")
def _(spark, sf_dir):
    return decisions.purgeable(log(spark, sf_dir), datetime(2024, 2, 15))


@query("w5_restorable", f"WITH {LOG} SELECT event_id FROM log WHERE batch = '2024-01-05' AND restored_at IS NULL AND purged_at IS NULL")
def _(spark, sf_dir):
    return decisions.restorable(log(spark, sf_dir), "2024-01-05").select("event_id")


NEW_FILES = "new AS (SELECT path, size + 1 AS size, 'changed' AS sha1, pair_key FROM files WHERE id % 7 = 0 UNION ALL SELECT 'new/' || id, size, sha1, NULL FROM files WHERE id % 50 = 0), old AS (SELECT path, size, sha1, pair_key FROM files)"


def old_and_new(files):
    new = files.filter("id % 7 = 0").selectExpr("path", "size + 1 AS size", "'changed' AS sha1", "pair_key").unionByName(files.filter("id % 50 = 0").selectExpr("concat('new/', id) AS path", "size", "sha1", "cast(NULL AS string) AS pair_key"))
    return files.select("path", "size", "sha1", "pair_key"), new


@query("sk1_upsert", with_("files") + f", {NEW_FILES} SELECT coalesce(new.path, old.path) AS path, coalesce(new.size, old.size) AS size, coalesce(new.sha1, old.sha1) AS sha1, old.pair_key FROM old FULL JOIN new ON old.path = new.path", "files")
def _(files):
    return decisions.upsert(*old_and_new(files), ["path"], keep=("pair_key",))


@query("sk2_replace", with_("files") + f", {NEW_FILES} SELECT * FROM old ANTI JOIN new USING (path) UNION ALL SELECT * FROM new", "files")
def _(files):
    return decisions.replace(*old_and_new(files), ["path"])


@query("sk3_insert_missing", with_("files") + f", {NEW_FILES} SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (path)", "files")
def _(files):
    return decisions.insert_missing(*old_and_new(files), ["path"])


@query("sk5_forget", with_("files") + f", {NEW_FILES} SELECT * FROM old SEMI JOIN new USING (path)", "files")
def _(files):
    return decisions.forget(*old_and_new(files), ["path"])


@query("sk6_append", "SELECT supp.id, supp.path FROM (SELECT s_suppkey AS id, s_name AS path FROM supplier) supp UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def _(spark, sf_dir):
    old = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS path")
    return decisions.append(old, load(spark, sf_dir, "nation").selectExpr("n_name AS path"))


@query("sk7_stamp", with_("marks") + "SELECT path, mark, CASE WHEN used_batch IS NULL AND mark = 'trash' THEN 'b2' ELSE used_batch END AS used_batch FROM marks", "marks")
def _(marks):
    return decisions.stamp(marks, marks.filter("mark = 'trash'"), ["path"], "used_batch", "b2").select("path", "mark", "used_batch")


@query("sk8_discard_others", with_("marks", "grouped") + ", new AS (SELECT path FROM grouped WHERE group_id % 8 = 0 AND path NOT IN (SELECT path FROM marks WHERE used_batch IS NOT NULL)) SELECT path, mark, keeper, used_batch FROM marks WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'discard', 'k', NULL FROM new", "marks", "grouped")
def _(marks, grouped):
    return decisions.discard_others(marks.withColumn("set_at", F.lit("t0")), grouped.filter("group_id % 8 = 0"), "k", "t1").select("path", "mark", "keeper", "used_batch")


@query("sk9_withdraw", with_("marks") + "SELECT path, mark FROM marks WHERE NOT (mark = 'trash' AND used_batch IS NULL)", "marks")
def _(marks):
    return decisions.withdraw(marks, marks.filter("mark = 'trash'"), ["path"]).select("path", "mark")


@query("sk10_redate", with_("files") + "SELECT path, CASE WHEN date_source IN ('mtime', 'folder') THEN '2015-03-0' || (1 + id % 9) || 'T12:00:00' ELSE taken_at END AS taken_at, CASE WHEN date_source IN ('mtime', 'folder') THEN 'filename' ELSE date_source END AS date_source FROM (SELECT * REPLACE ('d/IMG-2015030' || (1 + id % 9) || '-WA' || id || '.jpg' AS path) FROM files)", "files")
def _(files):
    return decisions.redate(files.withColumn("path", F.expr("concat('d/IMG-2015030', 1 + id % 9, '-WA', id, '.jpg')")), NOW).select("path", "taken_at", "date_source")


@query("sk10_regeo", with_("files") + "SELECT path, CASE WHEN geo_done = 0 THEN CASE WHEN id % 20 = 0 THEN 10.5 ELSE -20.25 END ELSE lat END AS lat, CASE WHEN geo_done = 0 THEN CASE WHEN id % 20 = 0 THEN 'exif' ELSE 'google' END ELSE geo_source END AS geo_source FROM files", "files")
def _(files):
    tags = files.selectExpr("path", "CASE WHEN id % 20 = 0 THEN '10.5' ELSE '0.0' END AS lat", "CASE WHEN id % 20 = 0 THEN '3' ELSE '0' END AS lon", "-20.25D AS side_lat", "7D AS side_lon")
    return decisions.regeo(files, tags).select("path", "lat", "geo_source")


@query("sk13_differences", with_("files") + f", {NEW_FILES} SELECT 'only first' AS side, path, size, sha1 FROM (SELECT path, size, sha1 FROM old EXCEPT ALL SELECT path, size, sha1 FROM new) UNION ALL SELECT 'only second', path, size, sha1 FROM (SELECT path, size, sha1 FROM new EXCEPT ALL SELECT path, size, sha1 FROM old)", "files")
def _(files):
    return sinks.differences(*old_and_new(files))


@query("sk13_by_digests", SQL["sk13_differences"], "files")
def _(files):
    return sinks.differences_by_digest(*old_and_new(files))


@query("j27_discard_plan", with_("files", "marks") + ", m AS (SELECT *, CASE WHEN mark = 'discard' THEN (SELECT min(path) FROM marks WHERE mark = 'keep') END AS k FROM marks) SELECT m.path AS victim, k AS keeper, coalesce(k IS NOT NULL, false) AS keeper_ok, mark = 'trash' AS trash, (SELECT count(*) FROM files f, files v WHERE v.path = m.path AND f.pair_key = v.pair_key AND f.kind = 'video' AND f.path <> v.path AND regexp_replace(f.path, '/[^/]*$', '') = regexp_replace(v.path, '/[^/]*$', '')) AS n_partners FROM m WHERE mark IN ('discard', 'trash') AND used_batch IS NULL", "files", "marks")
def _(files, marks):
    first = marks.filter("mark = 'keep'").agg(F.min("path").alias("k")).withColumn("mark", F.lit("discard"))
    named = marks.drop("keeper").join(F.broadcast(first), "mark", "left").withColumnRenamed("k", "keeper")
    return decisions.discard_plan(named, files).select("victim", "keeper", "keeper_ok", "trash", F.size("partners").cast("long").alias("n_partners"))


@query("w7_date_targets", with_("files", "overrides") + ", t AS (SELECT * FROM files WHERE path ILIKE 'src4/en/%' AND instr(substr(path, 9), '/') = 0 AND date_source = 'mtime' AND path NOT IN (SELECT path FROM overrides)) SELECT path FROM t UNION SELECT path FROM files WHERE pair_key IN (SELECT pair_key FROM t)", "files", "overrides")
def _(files, overrides):
    return decisions.date_targets(files, overrides, "src4/en", True).select("path")


@query("w7_set_dates", with_("files", "overrides") + ", t AS (SELECT * FROM files WHERE id % 6 = 1) SELECT coalesce(t.path, o.path) AS path, CASE WHEN t.path IS NULL THEN o.taken_at ELSE '2020-01-01T12:00:00' END AS taken_at, CASE WHEN o.path IS NULL THEN t.date_source END AS prev_source FROM overrides o FULL JOIN t ON o.path = t.path", "files", "overrides")
def _(files, overrides):
    old = overrides.selectExpr("path", "taken_at", "cast(NULL AS string) AS prev_taken_at", "cast(NULL AS string) AS prev_source", "'t0' AS set_at")
    return decisions.set_dates(old, files.filter("id % 6 = 1"), "2020-01-01T12:00:00", "t1").select("path", "taken_at", "prev_source")


@query("sk3_copied_overrides", with_(*PLANNED) + f", {PLAN} SELECT path, taken_at FROM overrides UNION ALL SELECT keeper, min(taken_at) FROM plan JOIN overrides ON victim = path WHERE keeper NOT IN (SELECT path FROM overrides) GROUP BY 1", *PLANNED)
def _(files, overrides, excluded):
    old = overrides.selectExpr("path", "taken_at", "cast(NULL AS string) AS prev_source", "'t0' AS set_at")
    return decisions.copied_overrides(old, planned(files, overrides, excluded), "t1").select("path", "taken_at")


TAKES = "takes AS (SELECT o_orderkey AS id, o_custkey % 40 AS gid, 'x/take' || o_orderkey || '.jpg' AS out_rel, CASE WHEN o_orderkey % 2 = 0 THEN 'add_discard' ELSE 'add' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 'u' END AS used_at FROM orders)"


def takes(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 40 AS gid", "concat('x/take', o_orderkey, '.jpg') AS out_rel", "CASE WHEN o_orderkey % 2 = 0 THEN 'add_discard' ELSE 'add' END AS mode", "CASE WHEN o_orderkey % 3 = 0 THEN 'u' END AS used_at", "cast(NULL AS string) AS archive_path", "concat('[\"f', o_orderkey, '\",\"g', o_orderkey % 5, '\"]') AS made_from")


@query("so7_latest_take", f"WITH {TAKES} SELECT id, gid FROM takes QUALIFY row_number() OVER (PARTITION BY gid ORDER BY id DESC) = 1")
def _(spark, sf_dir):
    return decisions.latest_take(takes(spark, sf_dir)).select("id", "gid")


@query("w8_apply_takes", f"WITH {TAKES}, o AS (SELECT * FROM takes WHERE used_at IS NULL AND mode = 'add_discard') SELECT 'best-take/take' || id || '.jpg' AS path, 'keep' AS mark, NULL AS keeper FROM o UNION ALL SELECT 'f' || id, 'discard', 'best-take/take' || id || '.jpg' FROM o UNION ALL SELECT 'g' || id % 5, 'discard', arg_max('best-take/take' || id || '.jpg', id) FROM o GROUP BY 1")
def _(spark, sf_dir):
    none = spark.createDataFrame([], "path string, mark string, keeper string, set_at string, used_batch string")
    return decisions.apply_takes(takes(spark, sf_dir), none, "t1")[1].select("path", "mark", "keeper")


# Reconciliation


@query("a24_distinct_entries", with_("files") + ", e AS (SELECT CASE id % 3 WHEN 0 THEN 'Photos from 2001' WHEN 1 THEN 'Archive' ELSE 'Album' END AS folder, path AS name, sha1 AS crc, size FROM files) SELECT size, crc, arg_min(name, (CASE folder WHEN 'Photos from 2001' THEN 0 WHEN 'Archive' THEN 1 ELSE 2 END, name)) AS name, count(*) AS copies FROM e GROUP BY 1, 2", "files")
def _(files):
    e = files.selectExpr("'z' AS zip", "CASE id % 3 WHEN 0 THEN 'Photos from 2001' WHEN 1 THEN 'Archive' ELSE 'Album' END AS folder", "path AS name", "sha1 AS crc", "size")
    return reconcile.distinct_entries(e).select("size", "crc", "name", "copies")


@query("j13_reconcile", with_("files") + ", h AS (SELECT size, sha1 AS crc, CASE WHEN id % 5 = 0 THEN 'quarantine' ELSE 'archive' END AS label, path AS rel FROM files WHERE id % 2 = 0) SELECT id, coalesce(label, 'new') AS state, rel FROM files f LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY size, crc ORDER BY label <> 'archive', rel) = 1) h ON f.size = h.size AND f.sha1 = h.crc WHERE id % 2 = 1", "files")
def _(files):
    held = files.filter("id % 2 = 0").selectExpr("path AS rel", "CASE WHEN id % 5 = 0 THEN 'quarantine' ELSE 'archive' END AS label", "size", "sha1 AS crc")
    return reconcile.match(files.filter("id % 2 = 1").selectExpr("id", "size", "sha1 AS crc"), held).select("id", "state", "rel")


@query("j14_outcomes", with_("files") + ", h AS (SELECT DISTINCT size, sha1 FROM files WHERE id % 2 = 0) SELECT CASE WHEN h.size IS NULL THEN 'new' ELSE 'archive' END AS state, count(*) AS n, sum(f.size)::BIGINT AS bytes FROM files f LEFT JOIN h ON f.size = h.size AND f.sha1 = h.sha1 WHERE id % 2 = 1 GROUP BY 1", "files")
def _(files):
    held = files.filter("id % 2 = 0").selectExpr("path AS rel", "'archive' AS label", "size", "sha1 AS crc")
    return reconcile.match(files.filter("id % 2 = 1").selectExpr("id", "size", "sha1 AS crc"), held).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


READY = "q AS (SELECT path, CASE WHEN id % 4 = 0 THEN NULL ELSE size END AS size, CASE WHEN id % 3 = 0 THEN 'similar: x' ELSE 'dup' END AS rule FROM files WHERE id % 4 IN (0, 1)), a AS (SELECT path, size FROM files WHERE id % 4 = 2), e AS (SELECT path, CASE WHEN id % 2 = 0 THEN 'Photos from 2001' ELSE 'Album' END AS folder, CASE WHEN id % 6 = 5 THEN size + 1 ELSE size END AS size, sha1 AS crc FROM files), s AS (SELECT e.*, CASE WHEN a.size = e.size THEN 'archive' WHEN q.path IS NOT NULL AND (q.size IS NULL OR q.size = e.size) THEN CASE WHEN rule LIKE 'similar%' THEN 'chosen' ELSE 'exact-dup' END END AS state FROM e LEFT JOIN a USING (path) LEFT JOIN q USING (path))"


def ready(files):
    q = files.filter("id % 4 in (0, 1)").selectExpr("path", "CASE WHEN id % 4 = 0 THEN NULL ELSE size END AS size", "CASE WHEN id % 3 = 0 THEN 'similar: x' ELSE 'dup' END AS rule")
    e = files.selectExpr("path", "CASE WHEN id % 2 = 0 THEN 'Photos from 2001' ELSE 'Album' END AS folder", "CASE WHEN id % 6 = 5 THEN size + 1 ELSE size END AS size", "sha1 AS crc")
    return e, files.filter("id % 4 = 2").select("path", "size"), q


@query("j15_accounted", with_("files") + f", {READY} SELECT path, state FROM s", "files")
def _(files):
    return reconcile.accounted(*ready(files)).select("path", "state")


@query("j16_readiness", with_("files") + f", {READY} SELECT path, coalesce(state, CASE WHEN folder = 'Album' AND (size, crc) IN (SELECT size, crc FROM s WHERE folder <> 'Album' AND state IS NOT NULL) THEN 'album copy' END, 'UNACCOUNTED') AS state FROM s", "files")
def _(files):
    return reconcile.readiness(*ready(files)).select("path", "state")


@query("j17_tiered", with_("files") + f", k AS (SELECT size, {SOURCE.format('path')} AS stem, split_part(path, '/', 2) AS day FROM files WHERE id % 2 = 0) SELECT id AS uuid, CASE WHEN (size, {SOURCE.format('path')}) IN (SELECT size, stem FROM k) THEN 'name' WHEN (size, split_part(path, '/', 2)) IN (SELECT size, day FROM k) THEN 'day' ELSE 'missing' END AS found FROM files WHERE id % 2 = 1", "files")
def _(files):
    rows = files.select("id", "size", X.one_level_source(F.col("path")).alias("stem"), F.split("path", "/")[1].alias("day"))
    return reconcile.tiered(rows.filter("id % 2 = 1").withColumnRenamed("id", "uuid"), rows.filter("id % 2 = 0")).select("uuid", "found")


@query("j18_without_clip", with_("files") + "SELECT id FROM files WHERE pair_key IS NOT NULL AND kind = 'photo' AND lower(split_part(path, '/', 2)) || id % 60 NOT IN (SELECT lower(split_part(path, '/', 2)) || id % 60 FROM files WHERE kind = 'video')", "files")
def _(files):
    rows = files.select("id", "kind", F.col("pair_key").isNotNull().alias("live_photo"), F.expr("concat(lower(split_part(path, '/', 2)), id % 60)").alias("stem"))
    return reconcile.without_clip(rows.filter("kind = 'photo'"), rows.filter("kind = 'video'")).select("id")


@query("j19_membership", with_("files") + "SELECT id, CASE WHEN sha1 IN (SELECT sha1 FROM files WHERE id % 3 = 1) THEN 'index' WHEN sha1 IN (SELECT sha1 FROM files WHERE id % 3 = 2) THEN 'parked' ELSE 'missing' END AS state FROM files WHERE id % 3 = 0", "files")
def _(files):
    return reconcile.membership(files.filter("id % 3 = 0"), files.filter("id % 3 = 1"), files.filter("id % 3 = 2")).select("id", "state")


@query("fl14_small_names", with_("files") + "SELECT path, CASE WHEN NOT regexp_matches(path, '(?i)/[0-9]*[02468][.]jpg$') THEN 'other name' WHEN coalesce(width, 0) = 0 THEN 'unknown size' WHEN make IS NOT NULL THEN 'camera data' WHEN greatest(width, height) > 300 THEN 'too large' ELSE 'park' END AS outcome FROM files WHERE kind = 'photo' AND starts_with(path, 'src2/')", "files")
def _(files):
    return reconcile.classify_small_names(files, "src2/", r"(?i)^[0-9]*[02468]\.jpg$", 300)


@query("j25_previews", with_("files", "grouped") + ", p AS (SELECT path, id, coalesce(width, 0) * height AS px, CASE WHEN id % 6 = 1 THEN CAST(id % 40 AS VARCHAR) ELSE '' END AS key FROM files WHERE kind = 'photo'), n AS (SELECT *, CASE WHEN key <> '' THEN 'a/' || key || '_c.jpg?' || path ELSE path END AS x FROM p), big AS (SELECT group_id, max(px) AS most FROM grouped JOIN p USING (path) WHERE key = '' GROUP BY 1) SELECT path, CASE WHEN most >= px * 1.5 THEN 'park: larger look-alike' ELSE 'stay' END AS outcome FROM p LEFT JOIN grouped USING (path) LEFT JOIN big USING (group_id) WHERE key <> ''", "files", "grouped")
def _(files, grouped):
    # Every sixth photo is a preview by name: its id leaves 1; no other file has its stem.
    name = F.expr("CASE WHEN id % 6 = 1 THEN concat(path, '_c.jpg') ELSE path END")
    rows = files.withColumn("old", F.col("path")).withColumn("path", name)
    g = grouped.join(rows.select(F.col("old").alias("path"), F.col("path").alias("new")), "path").select("group_id", F.col("new").alias("path"))
    out = reconcile.previews(rows, g, r"^(.+)_c\.jpg$", 1.5)
    return out.join(rows.select("path", "old"), "path").select(F.col("old").alias("path"), "outcome")


@query("fl16_missing", "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'junk' ELSE 'real' END WHEN page_id % 6 = 1 THEN 'metadata' WHEN page_id % 6 = 2 THEN 'junk' WHEN page_id % 6 = 3 THEN CASE WHEN page_id % 4 = 3 THEN 'junk' ELSE 'real' END WHEN page_id % 6 = 4 THEN 'metadata' WHEN page_id % 6 = 5 THEN 'junk' ELSE 'real' END AS class FROM pages")
def _(spark, sf_dir):
    name = "CASE page_id % 6 WHEN 1 THEN 'x/a.AAE' WHEN 2 THEN 'x/L.photoslibrary/private/b.jpg' WHEN 3 THEN concat('x/GX', page_id, '.LRV') WHEN 4 THEN 'x/L.photoslibrary/c.db' WHEN 5 THEN 'x/Snagit/d.png' ELSE 'x/e.jpg' END"
    e = load(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 9 = 0 THEN 'UNREADABLE' ELSE 'MISSING' END AS kind", f"{name} AS path", "page_id % 2 = 0 AS broken_link")
    names = e.filter("page_id % 4 = 3").selectExpr("concat('gx', page_id, '.mp4') AS name")
    return reconcile.classify_missing(e, names).select("page_id", "class")


@query("w6_verdict", "SELECT 0::BIGINT AS junk, count(*) AS metadata, 0::BIGINT AS real, 'SAFE FOR PHOTOS AND VIDEOS' AS verdict, 1 AS code FROM pages")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "pages").selectExpr("'MISSING' AS kind", "concat('x/', page_id, '.aae') AS path", "false AS broken_link")
    return reconcile.verdict(reconcile.classify_missing(e, spark.createDataFrame([], "name string")))


@query("a32_list_figures", "SELECT count(DISTINCT substr(event_type, 1, 3)) FILTER (event_type <> 'error') AS albums, sum((event_type = 'click')::INT)::BIGINT AS favourites, sum((event_id % 3 = 0 AND event_type <> 'error')::INT)::BIGINT AS keywords, 0::BIGINT AS persons, sum((event_id % 4 <> 0 AND event_type <> 'error')::INT)::BIGINT AS titled FROM events")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("event_type = 'error' AS intrash", "array(substr(event_type, 1, 3), substr(event_type, 1, 3)) AS albums", "event_type = 'click' AS favorite", "CASE WHEN event_id % 3 = 0 THEN array('k') ELSE array() END AS keywords", "cast(NULL AS array<string>) AS persons", "CASE WHEN event_id % 4 = 1 THEN 't' ELSE '' END AS title", "CASE WHEN event_id % 4 > 1 THEN 'd' END AS description")
    return reconcile.list_figures(e)


@query("pr10_owner_groups", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Shared Library' WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 1 THEN 'from other people' ELSE 'personal' END AS owner FROM customer")
def _(spark, sf_dir):
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 5 = 0 AS shared", "CASE WHEN c_custkey % 7 = 0 THEN 'h' END AS hash", "CASE WHEN c_custkey % 11 = 1 THEN 'me' ELSE 'None' END AS owner", "false AS syndicated")
    return c.select("c_custkey", reconcile.owner_group(F.col("shared"), F.col("hash"), F.col("owner"), F.col("syndicated")).alias("owner"))


# Sidecar names


@query("j20_sidecar_names", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'I' || doc_id || '.jpg.supplemental-metadata.json' WHEN 1 THEN 'I' || doc_id || '.jpg.supplemental-metadata(2).json' WHEN 2 THEN 'I' || doc_id || '.jpg.json' END AS sidecar FROM documents WHERE doc_id % 4 <> 3")
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", "source AS folder", "CASE doc_id % 4 WHEN 1 THEN concat('I', doc_id, '(2).jpg') WHEN 2 THEN concat('I', doc_id, '-edited.jpg') ELSE concat('I', doc_id, '.jpg') END AS file")
    j = d.filter("doc_id % 4 <> 3").selectExpr("folder", "CASE doc_id % 4 WHEN 0 THEN concat('I', doc_id, '.jpg.supplemental-metadata.json') WHEN 1 THEN concat('I', doc_id, '.jpg.supplemental-metadata(2).json') ELSE concat('I', doc_id, '.jpg.json') END AS sidecar", "'' AS title")
    return d.join(sidecars.sidecars(d, j), ["folder", "file"]).select("doc_id", "sidecar")


PREFIXES = "prefixes AS (SELECT DISTINCT unnest([regexp_extract(url, '^[a-z]+://[^/]+'), regexp_extract(url, '^[a-z]+://[^/]+/[^/]+')]) AS prefix FROM pages)"


@query("j21_longest_prefix", f"WITH {PREFIXES} SELECT url AS name, arg_max(prefix, len(prefix)) AS prefix FROM (SELECT DISTINCT url FROM pages) JOIN prefixes ON starts_with(url, prefix) AND len(prefix) < len(url) AND prefix <> '' GROUP BY 1")
def _(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.lit("").alias("folder"), F.col("url").alias("name"))
    both = F.explode(F.array(F.regexp_extract("name", r"^[a-z]+://[^/]+", 0), F.regexp_extract("name", r"^[a-z]+://[^/]+/[^/]+", 0))).alias("prefix")
    return sidecars.longest_prefix(p, p.select("folder", both).filter("prefix != ''")).select("name", "prefix")


@query("j22_borrowed", "SELECT doc_id, 'side' || (doc_id - doc_id % 2) AS sidecar FROM documents WHERE doc_id % 2 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents)")
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", "'f' AS folder", "concat('N', doc_id - doc_id % 2, CASE WHEN doc_id % 2 = 1 THEN '.MP4' ELSE '.heic' END) AS file")
    found = d.filter("doc_id % 2 = 0").selectExpr("folder", "file", "concat('side', doc_id) AS sidecar")
    return d.filter("doc_id % 2 = 1").join(sidecars.borrowed(d, found, [".mp4"]), ["folder", "file"]).select("doc_id", "sidecar")


@query("a33_claims", with_("files") + ", f AS (SELECT id, path AS file, split_part(path, '/', 2) || id % 30 AS sidecar FROM files) SELECT id, CASE WHEN row_number() OVER (PARTITION BY sidecar ORDER BY file DESC) = 1 THEN 'move' ELSE 'copy' END AS action FROM f", "files")
def _(files):
    return sidecars.claims(files.selectExpr("id", "'' AS folder", "path AS file", "concat(split_part(path, '/', 2), id % 30) AS sidecar")).select("id", "action")


@query("j23_album_copies", with_("files") + "SELECT id FROM files WHERE id % 2 = 1 AND ('n', size, sha1) IN (SELECT 'n', size, sha1 FROM files WHERE id % 2 = 0)", "files")
def _(files):
    rows = files.selectExpr("id", "'n' AS file", "size", "sha1")
    return sidecars.album_copies(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).select("id")


# Sources


LISTED = "concat('d', page_id % 7, '/n', page_id - page_id % 6, CASE page_id % 6 WHEN 0 THEN '.CR3' WHEN 1 THEN '.CR3.xmp' WHEN 2 THEN '.Mov' WHEN 3 THEN CASE page_id % 4 WHEN 0 THEN '.xmp' WHEN 1 THEN '.AAE' WHEN 2 THEN '.Aae' ELSE '.json' END WHEN 4 THEN '.heif' ELSE '.bmp' END)"
LISTING = f"listing AS (SELECT DISTINCT {LISTED.replace('page_id % 7', 'page_id // 6 % 7')} AS path FROM pages)"


@query(
    "sc1_media",
    f"WITH {LISTING}, m AS (SELECT path, lower(regexp_extract(path, '\\.[^.]*$')) AS ext, regexp_replace(path, '\\.[^.]*$', '') AS stem FROM listing) SELECT path, ext, CASE ext WHEN '.mov' THEN 'video' ELSE 'photo' END AS kind, (path || '.xmp' IN (SELECT path FROM listing) OR stem || '.xmp' IN (SELECT path FROM listing) OR stem || '.aae' IN (SELECT path FROM listing) OR stem || '.AAE' IN (SELECT path FROM listing))::INT AS has_sidecar FROM m WHERE ext IN ('.cr3', '.mov', '.heif')",
)
def _(spark, sf_dir):
    listing = load(spark, sf_dir, "pages").selectExpr(LISTED.replace("page_id % 7", "cast(floor(page_id / 6) AS long) % 7") + " AS path").distinct()
    return sources.media(listing)


@query("sc13_changed", with_("files") + "SELECT path FROM files WHERE id % 5 = 0 OR id % 7 = 0", "files")
def _(files):
    now = files.selectExpr("path", "size", "id AS mtime_ns", "id")
    known = now.filter("id % 5 <> 0").withColumn("size", F.expr("CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END"))
    return sources.changed(now, known).select("path")


@query("sc13_bucketed", SQL["sc13_changed"], "files")
def _(files):
    """The catalogue in buckets by path: only the listing is shuffled."""
    spark = files.sparkSession
    now = files.selectExpr("path", "size", "id AS mtime_ns", "id")
    known = now.filter("id % 5 <> 0").withColumn("size", F.expr("CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END"))
    at = fresh_path(spark, "catalogue")
    known = sinks.write_bucketed(known, "known_" + at.rpartition("-")[2], at, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return sources.changed(now, known).select("path")


@query("sc14_to_fingerprint", with_("files") + "SELECT path FROM files WHERE kind = 'photo' AND (id % 11 = 0 OR id % 7 = 0 OR id % 13 = 0 OR id % 9 = 0)", "files")
def _(files):
    now = files.withColumn("mtime_ns", F.col("id"))
    h = now.filter("id % 11 <> 0").selectExpr("path", "CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END AS size", "mtime_ns", "CASE WHEN id % 9 = 0 THEN NULL ELSE 1.0D END AS sharp", "CASE WHEN id % 13 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return sources.to_fingerprint(now, h).select("path")


@query("sc15_to_look_at", with_("files") + "SELECT path FROM files WHERE kind = 'photo' AND (id % 4 = 0 OR id % 3 = 0) AND path ILIKE '%SRC1%'", "files")
def _(files):
    now = files.withColumn("mtime_ns", F.col("id"))
    seen = now.selectExpr("path", "size", "mtime_ns", "CASE WHEN id % 4 = 0 THEN 'old' ELSE 'm' END AS model", "CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return sources.to_look_at(now, seen, "m", retry=True, text="SRC1").select("path")


@query("sc4_sidecar_json", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 1700 * 1000000 >= 631152000 THEN strftime(to_timestamp(event_id % 1700 * 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS taken_at, CASE WHEN event_id % 2 = 0 THEN 10.5 ELSE 20.5 END AS lat FROM events")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    text = "concat('{\"title\":\"a\",\"photoTakenTime\":{\"timestamp\":\"', CASE WHEN event_id % 3 = 0 THEN 'x' ELSE cast(event_id % 1700 * 1000000 AS string) END, '\"},\"geoData\":{\"latitude\":', CASE WHEN event_id % 2 = 0 THEN '10.5' ELSE '0.0' END, ',\"longitude\":0.0},\"geoDataExif\":{\"latitude\":20.5,\"longitude\":3.0}}')"
    return sources.parsed_sidecars(e.selectExpr("cast(event_id AS string) AS path", f"{text} AS value")).select(F.col("path").cast("long").alias("event_id"), "taken_at", "lat")


@query("sc11_hashes", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))


@query("fl19_media_entries", "SELECT name FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'Root/Trash/' WHEN 1 THEN 'Other/x/' ELSE 'Root/Photos from 2001/' END || doc_id AS name FROM documents) WHERE starts_with(name, 'Root/Photos')")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "documents").selectExpr("concat(CASE doc_id % 4 WHEN 0 THEN 'Root/Trash/' WHEN 1 THEN 'Other/x/' ELSE 'Root/Photos from 2001/' END, doc_id) AS name")
    return reconcile.media_entries(e, "Root", ["Trash", "Bin"]).select("name")


@query("sk14_extraction", "SELECT name, CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE 'write' END AS action FROM (SELECT doc_id, 'd' || doc_id % 10 || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.json' END AS name FROM documents) WHERE doc_id % 4 = 0 OR (doc_id % 2 = 1 AND 'd' || doc_id % 10 IN (SELECT 'd' || doc_id % 10 FROM documents WHERE doc_id % 4 = 0))")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "documents").selectExpr("'z' AS zip", "concat('d', doc_id % 10, '/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.json' END) AS name", "n_chars AS size", "doc_id")
    return reconcile.extraction(e.drop("doc_id"), e.filter("doc_id % 4 = 0"), e.filter("doc_id % 5 = 0").selectExpr("name AS path", "size")).select("name", "action")


# Vision

DETAIL = "concat('[{\"b\":[0,0,1,1],\"k\":[],\"e\":\"', CASE WHEN toxic = 1 THEN 'closed' ELSE 'open' END, '\",\"l\":\"', CASE WHEN doc_id % 6 = 0 THEN 'away' ELSE 'camera' END, '\"},{\"b\":[0,0,1,1],\"k\":[],\"e\":\"unclear\",\"l\":\"camera\"}]')"


def detailed(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    return rows.selectExpr("doc_id", "toxic", f"{PATH} AS path", "'ok' AS status", "'m/v6' AS model", "2 AS faces", f"{DETAIL} AS detail", "doc_id - doc_id % 20 AS group_id", "cast(doc_id % 9 AS double) AS sharp")


@query("a22_json_agg", f"WITH v AS (SELECT doc_id - doc_id % 20 AS group_id, {PATH} AS path, {DETAIL} AS detail FROM labels JOIN documents USING (doc_id)) SELECT group_id, sum(json_array_length(detail))::BIGINT AS faces, sum(len(list_filter(json_extract_string(detail, '$[*].e'), lambda x: x = 'closed')))::BIGINT AS closed, min(path) AS first FROM v GROUP BY 1 HAVING sum(len(list_filter(json_extract_string(detail, '$[*].e'), lambda x: x = 'closed'))) > 0")
def _(spark, sf_dir):
    v = detailed(spark, sf_dir)
    return vision.take_groups(v.select("group_id", "path"), v)


@query("a23_take_base", f"SELECT group_id, arg_min(path, (toxic, -(doc_id % 9), path)) AS base, NOT (count(*) * 2 >= 3 AND sum(toxic) > 0.7 * count(*) * 2) AS reliable FROM (SELECT doc_id - doc_id % 20 AS group_id, toxic, doc_id, {PATH} AS path FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def _(spark, sf_dir):
    v = detailed(spark, sf_dir)
    return vision.take_base(vision.take_members(v.select("group_id", "path"), v, v))


@query("pr12_face_states", f"SELECT path, i::INT AS i, CASE WHEN i = 1 THEN 'unclear' WHEN doc_id % 6 = 0 THEN 'away' WHEN toxic = 1 THEN 'closed' ELSE 'open' END AS state FROM (SELECT {PATH} AS path, doc_id, toxic, unnest([0, 1]) AS i FROM labels JOIN documents USING (doc_id))")
def _(spark, sf_dir):
    return vision.face_states(detailed(spark, sf_dir), "/v6")


@query("um5_roll_up", f"SELECT doc_id, 2 AS faces, toxic::INT AS eyes_closed, (doc_id % 6 = 0)::INT AS looking_away, '1 too small or unclear' || CASE WHEN doc_id % 6 = 0 THEN ', 1 turned away' ELSE '' END AS note FROM labels JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    return detailed(spark, sf_dir).select("doc_id", vision.rolled_up(vision.faces(F.col("detail"))).alias("r")).select("doc_id", "r.*")


@query("um4_eye_state", "SELECT p_partkey, CASE WHEN p_size < 26 THEN 'unclear' WHEN p_partkey % 3 = 0 THEN 'unclear' WHEN p_partkey % 2 = 0 THEN 'open' ELSE 'unclear' END AS e, CASE WHEN p_size >= 26 AND p_partkey % 3 = 0 THEN 'away' ELSE 'camera' END AS l FROM part")
def _(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    s = X.eye_state(F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 3 == 0, -0.5).otherwise(0.1), F.when(F.col("p_partkey") % 2 == 0, "They are OPEN.").otherwise("opened?"))
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


@query("j28_donors", "WITH a AS (SELECT p_size AS g, p_partkey AS face, p_partkey % 7 * 10.0 AS x FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_size AS g, p_partkey AS donor, p_partkey % 11 * 10.0 AS x, 16 + p_partkey % 5 * 4.0 AS w FROM part WHERE p_partkey % 3 <> 0) SELECT g AS group_id, face, donor, d AS distance FROM (SELECT a.g, face, donor, abs(a.x + 10 - b.x - w / 2)::DOUBLE AS d FROM a JOIN b USING (g) WHERE abs(a.x + 10 - b.x - w / 2) < 12 AND w / 20 > 0.7 AND w / 20 < 1.4) QUALIFY row_number() OVER (PARTITION BY g, face ORDER BY d, donor) = 1")
def _(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    box = lambda x, w: f"array(cast({x} AS double), 0D, cast({x} + {w} AS double), 10D)"
    need = p.filter("p_partkey % 3 = 0").selectExpr("p_size AS group_id", "p_partkey AS face", box("p_partkey % 7 * 10", "20") + " AS box")
    offer = p.filter("p_partkey % 3 <> 0").selectExpr("p_size AS group_id", "p_partkey AS donor", box("p_partkey % 11 * 10", "16 + p_partkey % 5 * 4") + " AS box")
    return vision.donors(need, offer)


# Scalar functions


@query("f3_human", "SELECT o_orderkey, CASE WHEN v < 1024 THEN printf('%.0f B', v) WHEN v < 1048576 THEN printf('%.1f KB', v / 1024) WHEN v < 1073741824 THEN printf('%.1f MB', v / 1048576) ELSE printf('%.1f GB', v / 1073741824) END AS h FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 7 + 1025 WHEN 2 THEN o_orderkey * 9973 + 1048577 ELSE o_orderkey * 9999991 + 1073741825 END::DOUBLE AS v FROM orders) WHERE v < 1099511627776 AND abs(v / 1024 * 20 - round(v / 1024 * 20)) > 1e-6 AND abs(v / 1048576 * 20 - round(v / 1048576 * 20)) > 1e-6 AND abs(v / 1073741824 * 20 - round(v / 1073741824 * 20)) > 1e-6")
def _(spark, sf_dir):
    v = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 7 + 1025 WHEN 2 THEN o_orderkey * 9973 + 1048577 ELSE o_orderkey * 9999991 + 1073741825 END AS double) AS v")
    # Exact halves, which the engines round differently, are left out on both sides.
    v = v.filter("v < 1099511627776D and abs(v / 1024 * 20 - round(v / 1024 * 20)) > 1e-6 and abs(v / 1048576 * 20 - round(v / 1048576 * 20)) > 1e-6 and abs(v / 1073741824 * 20 - round(v / 1073741824 * 20)) > 1e-6")
    return v.select("o_orderkey", X.human(F.col("v")).alias("h"))


@query("f4_span_label", "SELECT o_orderkey, CASE WHEN s IS NULL THEN 'camera times unknown' WHEN s <= 10 THEN 'taken within seconds of each other (burst or copies)' WHEN s < 3600 THEN 'taken over ' || greatest(1, s // 60) || ' min' WHEN s < 86400 THEN 'taken over ' || s // 3600 || ' h' ELSE 'taken over ' || s // 86400 || ' days (copies or repeat shots)' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * o_orderkey % 400000 END AS s FROM orders)")
def _(spark, sf_dir):
    s = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * o_orderkey % 400000 END AS s")
    return s.select("o_orderkey", X.span_label(F.col("s")).alias("label"))


ORDER_DAY = "date_format(o_orderdate, '{}')"


@query("f8_parse_exif", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS d FROM orders")
def _(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "2001:02:30 10:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("v"))
    return o.select("o_orderkey", X.parse_exif_date(F.col("v")).alias("d"))


@query("f9_name_date", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT12:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30') WHEN 2 THEN NULL WHEN 3 THEN '2019-06-10T09:54:47' ELSE strftime(o_orderdate, '%Y-%m-%dT12:00:00') END AS d FROM orders")
def _(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, F.concat(F.lit("a/IMG-"), day, F.lit("-WA0001.jpg"))).when(k == 1, F.concat(F.lit("a/IMG_"), day, F.lit("_102030_821.jpg"))).when(k == 2, F.concat(F.lit("a/1f0e3dad-9990-4b3c-8f0a-abcdefabcdef"), day, F.lit(".jpg"))).when(k == 3, "b/FB_IMG_1560160487953.jpg").otherwise(F.concat(F.lit("b/20991231 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" trip.jpg")))
    return load(spark, sf_dir, "orders").select("o_orderkey", X.date_from_filename(name, NOW).alias("d"))


@query("f10_path_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01T00:00:00') ELSE strftime(o_orderdate, '%Y-01-01T00:00:00') END AS d FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    day = lambda f: F.date_format("o_orderdate", f)
    path = F.when(k == 0, F.concat(F.lit("1990/"), day("yyyy_MM_dd"), F.lit(" x/a.jpg"))).when(k == 1, F.concat(day("yyyy-MM"), F.lit("/none/a.jpg"))).otherwise(F.concat(F.lit("x"), day("yyyy"), F.lit("/b/20200101.jpg")))
    return load(spark, sf_dir, "orders").select("o_orderkey", X.date_from_path(path).alias("d"))


@query("f11_capture_date", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN '2001-09-09T01:46:40' WHEN 2 THEN '2003-04-05T12:00:00' WHEN 3 THEN '1999-01-01T00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS taken_at, ['exif', 'google', 'filename', 'folder', 'mtime'][o_orderkey % 5 + 1] AS date_source FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    exif = F.when(k == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).otherwise("0000:00:00 00:00:00")
    path = F.when(k == 2, "a/2003-04-05 x.jpg").when(k == 3, "1999/a.jpg").otherwise("a/b.jpg")
    got = X.capture_date([F.lit(None).cast("string"), exif], F.when(k == 1, "1000000000"), path, F.col("o_orderdate"), NOW)
    return load(spark, sf_dir, "orders").select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")


@query("f7_parse_taken", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT12:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT09:30:00') END AS d FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return load(spark, sf_dir, "orders").select("o_orderkey", X.parse_taken(F.when(k == 0, F.concat(day, F.lit(" "))).when(k == 1, F.concat(day, F.lit("T09:30"))).when(k == 2, "2001-02-30").otherwise("1850-01-01"), NOW).alias("d"))


@query("f12_geo", with_("grid") + "SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN lat ELSE lon END AS lat, CASE WHEN id % 3 = 1 THEN 'exif' WHEN id % 3 = 2 THEN 'google' END AS geo_source FROM grid WHERE lat > 0.01 AND lon > 0.01 AND lon < 90", "grid")
def _(grid):
    rows = grid.filter("lat > 0.01 and lon > 0.01 and lon < 90")
    k = F.col("id") % 3
    own = (F.when(k == 1, F.col("lat")).when(k == 0, 91.0), F.when(k == 1, F.col("lon")).otherwise(0.0))
    side = (F.when(k == 2, F.col("lon")).otherwise(0.0), F.when(k == 2, F.col("lat")).otherwise(0.0))
    return rows.select("id", X.geo_for(own, [side]).alias("g")).select("id", "g.lat", "g.geo_source")


@query("f13_norm_stem", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'img' || c_custkey WHEN 1 THEN 'img' || c_custkey ELSE 'img' || c_custkey || '.x' END AS s FROM customer")
def _(spark, sf_dir):
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('d/IMG', c_custkey, ' (2).JPG') WHEN 1 THEN concat('IMG', c_custkey, '-Edited.heic') ELSE concat('img', c_custkey, '.x.mov') END AS n")
    return c.select("c_custkey", X.norm_stem(F.col("n")).alias("s"))


@query("f19_bands", "SELECT vec_id, 0 AS band, (h & 2047)::BIGINT AS value FROM (SELECT vec_id, ('0x' || substr(md5(vec_id::VARCHAR), 1, 16))::UBIGINT AS h FROM embeddings) UNION ALL SELECT vec_id, 5, (h >> 53)::BIGINT FROM (SELECT vec_id, ('0x' || substr(md5(vec_id::VARCHAR), 1, 16))::UBIGINT AS h FROM embeddings)")
def _(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 16), 16, -10).cast("long")
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), h.alias("hash"))
    return similar.dealt(rows).filter("band in (0, 5)").select(F.col("key").alias("vec_id"), "band", "value")


@query("f22_geometry", "SELECT p_partkey, round(sqrt(400.0::DOUBLE + (p_size * p_size)), 9) AS d, round(degrees(atan2(p_size, 20.0::DOUBLE)), 9) AS angle FROM part")
def _(spark, sf_dir):
    k = F.array(*[F.lit(v) for v in (0.1, 0.1, 0.3)], 0.1 + F.col("p_size") / 100.0, *[F.lit(v) for v in (0.2, 0.3)])
    g = X.head_geometry(k, F.lit(100.0), F.lit(100.0))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(g["d"], 9).alias("d"), F.round(g["angle"], 9).alias("angle"))


@query("f26_safe_paths", "SELECT page_id, page_id % 4 = 3 AS safe FROM pages")
def _(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.is_safe_path(F.expr("CASE page_id % 4 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../../b' WHEN 2 THEN 'a\\\\..\\\\b' ELSE 'a/b..c/d' END")).alias("safe"))


@query("f28_folder_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT END AS year FROM orders")
def _(spark, sf_dir):
    f = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Photos from "), F.date_format("o_orderdate", "yyyy"))).otherwise("Photos of 2001")
    return load(spark, sf_dir, "orders").select("o_orderkey", X.folder_year(f).alias("year"))


@query("f24_pages", with_("files") + f"SELECT {SOURCE.format('path')} AS source, greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages, round(count(*) * 100.0::DOUBLE / 1000, 1) AS pct FROM files GROUP BY 1", "files")
def _(files):
    n = F.count(F.lit(1))
    return files.groupBy(X.one_level_source(F.col("path")).alias("source")).agg(X.pages(n, 25).alias("pages"), X.percent(n, F.lit(1000)).alias("pct"))


@query("so8_most_common", with_("files") + f"SELECT {SOURCE.format('path')} AS source, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, source LIMIT 5", "files")
def _(files):
    return browse.count_by(files, X.one_level_source(F.col("path")), "source").orderBy(F.desc("n"), "source").limit(5)


@query("fl9_dated_timeline", with_("files") + f", c AS (SELECT substr(taken_at, 1, 4)::INT AS year, count(*) AS total FROM files WHERE {VISIBLE} AND date_source <> 'mtime' AND taken_at IS NOT NULL GROUP BY 1), y AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM c) SELECT year::INT AS year, coalesce(total, 0)::BIGINT AS total FROM y LEFT JOIN c USING (year)", "files")
def _(files):
    rows = files.filter(X.visible(F.col("kind"), F.col("pair_key"))).filter("date_source != 'mtime'")
    return browse.timeline(rows, 2024).select("year", "total")


@query("fl6_kinds", with_("files") + "SELECT kind, ext, count(*) AS n FROM files GROUP BY 1, 2", "files")
def _(files):
    again = X.kind_of(F.upper("ext"), sources.PHOTO, sources.VIDEO)
    return files.groupBy(again.alias("kind"), "ext").agg(F.count(F.lit(1)).alias("n"))


@query("a29_status", with_("vision") + "SELECT status, count(*) AS n FROM vision GROUP BY 1", "vision")
def _(seen):
    return browse.count_by(seen, F.col("status"), "status")


@query("j6_scalar_in", with_("files") + "SELECT id FROM files WHERE content_id IN (SELECT content_id FROM files WHERE content_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)", "files")
def _(files):
    shared = files.filter("content_id is not null").groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return files.join(shared.select("content_id"), "content_id", "left_semi").select("id")


@query("j8_whole_group", with_("grouped") + "SELECT path, (SELECT count(*) FROM grouped b WHERE b.group_id = a.group_id) AS whole FROM grouped a", "grouped")
def _(grouped):
    return grouped.join(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("whole")), "group_id").select("path", "whole")


@query("fl22_skipped", with_("files") + "SELECT id FROM files WHERE NOT (split_part(path, '/', 1) IN ('src1', 'fr') OR split_part(path, '/', 2) IN ('src1', 'fr'))", "files")
def _(files):
    return files.filter(~X.skipped(F.col("path"), ["src1", "fr"])).select("id")


@query("a30_freshness", with_("files") + f", {LOG} SELECT max(scanned_at) AS scanned, (SELECT max(moved_at) FROM log) AS moved, '2024-05-01' AS saved, true AS stale FROM files")
def _(spark, sf_dir):
    saved = spark.createDataFrame([("2024-05-01",)], "taken string")
    return reconcile.freshness(base(spark, sf_dir, "files"), log(spark, sf_dir), saved)


@query("so6_sample", with_("files") + "SELECT path FROM files ORDER BY md5('3:' || path), path LIMIT 20", "files")
def _(files):
    return vision.sample(files, 20, 3).select("path")


@query("so9_largest_faces", "SELECT group_id, list_aggregate(list_slice(list_reverse_sort(list(p_size)), 1, 3), 'string_agg', ',') AS areas FROM (SELECT p_partkey % 50 AS group_id, p_size FROM part) GROUP BY 1")
def _(spark, sf_dir):
    box = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(1.0)).alias("b"))
    g = load(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("group_id")).agg(F.collect_list(box).alias("f"))
    areas = F.transform(vision.largest_faces(F.col("f"), 3), lambda x: X.box_area(x["b"]).cast("int").cast("string"))
    return g.select("group_id", F.array_join(areas, ",").alias("areas"))


@query(
    "ext_bursts",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(spark, sf_dir):
    """Extension: shots in a row, over a bounded table as the stream has them."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "10 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")



