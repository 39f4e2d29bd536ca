"""Further entries of the registry: functions, sources and sinks one by one, each with its SQL.

Where an operator reads files, the entry makes them from the tables, in the folder that driver and executors share.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.functions import images
from larkspur.operators import browse, decisions, similar, vision
from larkspur.sources import files as sources
from larkspur.sources import sinks, trees
from larkspur.sources.staging import fresh_path

from .queries import DETAIL, LISTED, LISTING, LOG, NOW, PATH, QUERIES, SQL, VISIBLE, detailed, load, log, query, with_

__all__ = ["QUERIES", "SQL"]


# Projections and filters


@query("pr5_labels", with_("files") + "SELECT id, CASE split_part(path, '/', 1) WHEN 'src1' THEN 'First' WHEN 'src2' THEN 'Second' ELSE split_part(path, '/', 1) END AS label FROM files", "files")
def _(files):
    return files.select("id", X.label(X.one_level_source(F.col("path")), {"src1": "First", "src2": "Second"}).alias("label"))


@query("pr6_pixels", with_("files") + "SELECT id, coalesce(width, 0)::BIGINT * coalesce(height, 0) AS px FROM files", "files")
def _(files):
    return files.select("id", X.pixels(F.col("width"), F.col("height")).alias("px"))


@query("pr7_has_geo", with_("files", "grouped", "hashes", "marks", "vision") + "SELECT path, lat IS NOT NULL AS has_geo FROM grouped JOIN files USING (path)", "grouped", "files", "hashes", "marks", "vision")
def _(*frames):
    return similar.members(*frames).select("path", "has_geo")


@query("pr8_null_bucket", with_("files") + "SELECT coalesce(date_source, 'none') AS bucket, count(*) AS n FROM files GROUP BY 1", "files")
def _(files):
    return browse.profile(files).filter("facet = 'date_source'").select(F.col("key").alias("bucket"), "n")


@query("pr9_names", with_("files") + "SELECT id, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name, id::VARCHAR AS stem, lower(regexp_extract(path, '[.][^.]*$')) AS ext FROM files", "files")
def _(files):
    p = F.col("path")
    return files.select("id", X.dirname(p).alias("folder"), X.basename(p).alias("name"), X.stem(p).alias("stem"), F.lower(X.extension(p)).alias("ext"))


def grid(name: str, where: str, **asked):
    """An entry for one setting of the grid."""

    @query(name, with_("files") + f"SELECT id FROM files WHERE {VISIBLE} AND {where}", "files")
    def _(files):
        return files.filter(browse.Browse(**asked).condition()).select("id")


grid("fl4_year", "substr(taken_at, 1, 4) = '1999'", year="1999")
grid("fl4_month", "substr(taken_at, 6, 2) = '05'", month="5")
grid("fl6_invalid_kind", "true", kind="drawing")
grid("fl7_paired", "pair_key IS NOT NULL", live=True)
grid("fl8_source", "path ILIKE 'src1/%'", source="src1")


@query("fl8_unknown_source", with_("files") + f"SELECT id FROM files WHERE {VISIBLE}", "files")
def _(files):
    return files.filter(browse.Browse(source="nowhere").condition(["src1"])).select("id")


@query("fl15_exact_prefix", with_("files") + "SELECT id FROM files WHERE substr(path, 1, 5) = 'src1/'", "files")
def _(files):
    return files.filter(F.startswith("path", F.lit("src1/"))).select("id")


@query("fl18_extensions", with_("files") + "SELECT id FROM files WHERE lower(ext) IN ('.mp4', '.mov')", "files")
def _(files):
    return files.filter(X.kind_of(F.upper("ext"), [], [".mp4", ".mov"]).isNotNull()).select("id")


@query("fl20_held", f"WITH {LOG} SELECT event_id FROM log WHERE restored_at IS NULL AND purged_at IS NULL")
def _(spark, sf_dir):
    return decisions.held_now(log(spark, sf_dir)).select("event_id")


@query("fl21_valid_geo", "SELECT p_partkey, CASE WHEN p_size * 2 - 10 <= 90 AND NOT p_size = 5 THEN (p_size * 2 - 10)::DOUBLE END AS lat FROM part")
def _(spark, sf_dir):
    # Beyond the pole from size 51 on; size 5 is the origin.
    p = load(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 2 - 10 AS double) AS lat", "CASE WHEN p_size = 5 THEN 0.0D ELSE 1.0D END AS lon")
    return p.select("p_partkey", X.valid_geo(F.col("lat"), F.col("lon"))["lat"].alias("lat"))


# Aggregates, joins and orders


@query("a1_count", with_("files") + f"SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM files WHERE {VISIBLE} AND kind = 'photo'", "files")
def _(files):
    return browse.totals(files.filter(browse.Browse(kind="photo").condition()))


@query("a21_eligible", with_("files", "grouped", "hashes", "marks", "vision") + "SELECT group_id, count(faces) >= 2 AND count(*) FILTER (coalesce(eyes_closed, 0) > 0) > 0 AS can_besttake FROM grouped JOIN files USING (path) LEFT JOIN (SELECT * FROM vision WHERE status = 'ok') USING (path) GROUP BY 1", "grouped", "files", "hashes", "marks", "vision")
def _(*frames):
    return similar.decisions(similar.members(*frames)).select("group_id", "can_besttake")


@query("a25_tallies", with_("files") + "SELECT substr(taken_at, 1, 4) AS year, count(*) AS n FROM files GROUP BY 1", "files")
def _(files):
    return browse.count_by(files, F.substring("taken_at", 1, 4), "year")


@query("a27_shared_ids", with_("files") + "SELECT content_id, count(*) AS n FROM files WHERE content_id <> '' GROUP BY 1 HAVING count(*) >= 2", "files")
def _(files):
    keyed = browse.pair_keys(files).filter(F.startswith("pair_key", F.lit("cid:")))
    return browse.count_by(keyed, F.col("content_id"), "content_id")


@query("a34_group_sources", with_("files", "grouped") + "SELECT group_id, string_agg(DISTINCT split_part(path, '/', 1), ',' ORDER BY split_part(path, '/', 1)) AS sources FROM grouped GROUP BY 1 HAVING count(DISTINCT split_part(path, '/', 1)) > 1", "grouped", "files", "marks")
def _(grouped, files, marks):
    rows = similar.group_list(grouped.withColumn("is_best", F.lit(0)), files, grouped.selectExpr("group_id", "0 AS span_s").distinct(), marks)
    return rows.filter("sources is not null").select("group_id", F.array_join("sources", ",").alias("sources"))


@query("j2_grouped_files", with_("files", "grouped", "hashes", "marks", "vision") + "SELECT group_id, id, kind, size FROM grouped JOIN files USING (path)", "grouped", "files", "hashes", "marks", "vision")
def _(*frames):
    return similar.members(*frames).select("group_id", "id", "kind", "size")


@query("j32_take_members", f"SELECT doc_id - doc_id % 20 AS group_id, {PATH} AS path, 2 AS seen, toxic::INT AS closed, (doc_id % 9)::DOUBLE AS sharp FROM labels JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    v = detailed(spark, sf_dir)
    return vision.take_members(v.select("group_id", "path"), v, v.select("path", "sharp"))


@query("so3_oldest_first", with_("files") + "SELECT id FROM files ORDER BY taken_at IS NOT NULL, taken_at, id LIMIT 96", "files")
def _(files):
    return browse.page(files, browse.Browse(sort="old").order()).select("id")


@query("so5_by_size", with_("files") + "SELECT id FROM files ORDER BY size DESC NULLS LAST, id LIMIT 96 OFFSET 96", "files")
def _(files):
    return browse.page(files, browse.Browse(sort="size").order(), 2).select("id")


# Functions


@query("f5_day", with_("files") + "SELECT id, substr(coalesce(taken_at, ''), 1, 10) AS day FROM files", "files")
def _(files):
    return files.select("id", X.day(F.col("taken_at")).alias("day"))


@query("f6_bbox", with_("grid") + "SELECT id FROM grid WHERE lat BETWEEN 1.5 AND 6 AND lon BETWEEN 5 AND 40.25", "grid")
def _(rows):
    south, west, north, east = X.parse_bbox("1.5, 5, 6, 40.25")
    return rows.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("id")


@query("f6_no_bbox", with_("files") + f"SELECT id FROM files WHERE {VISIBLE}", "files")
def _(files):
    return files.filter(browse.Browse(bbox="6,5,1.5,40").condition()).select("id")  # south lies above north: no filter


@query(
    "f14_sidecar_names",
    "WITH f AS (SELECT doc_id, 'I' || doc_id AS s FROM documents) SELECT doc_id, unnest(CASE doc_id % 3 "
    "WHEN 0 THEN [s || '.jpg.supplemental-metadata.json', s || '.jpg.json', s || '.supplemental-metadata.json'] "
    "WHEN 1 THEN [s || '(2).jpg.supplemental-metadata.json', s || '.jpg.supplemental-metadata(2).json', s || '.jpg(2).json', s || '(2).jpg.json', s || '(2).supplemental-metadata.json'] "
    "ELSE [s || '-Edited.png.supplemental-metadata.json', s || '-Edited.png.json', s || '-Edited.supplemental-metadata.json', s || '.png.supplemental-metadata.json', s || '.png.json', s || '.supplemental-metadata.json'] END) AS sidecar FROM f",
)
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", "concat('I', doc_id, CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '(2).jpg' ELSE '-Edited.png' END) AS file")
    return d.select("doc_id", F.explode(X.sidecar_names(F.col("file"))).alias("sidecar"))


@query("f15_pair_stem", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'd/pxl_' || doc_id || '.mp' ELSE 'd/img_' || doc_id END AS stem FROM documents")
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('D/IMG_', doc_id, '_HEVC.MOV') WHEN 1 THEN concat('D/PXL_', doc_id, '.MP') WHEN 2 THEN concat('D/IMG_', doc_id, '.mov') ELSE concat('D/IMG_', doc_id, '.HEIC') END AS path", "CASE WHEN doc_id % 4 < 3 THEN 'video' ELSE 'photo' END AS kind")
    return d.select("doc_id", X.pair_stem(F.col("path"), F.col("kind")).alias("stem"))


@query("f16_source_rank", with_("files") + "SELECT id, CASE split_part(path, '/', 1) WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS rank FROM files", "files")
def _(files):
    return files.select("id", X.source_rank(X.one_level_source(F.col("path")), ["src3", "src1"]).alias("rank"))


@query("f17_retention", f"WITH {LOG} SELECT event_id, (epoch(moved_at::TIMESTAMP)::BIGINT + 30 * 86400 - epoch(TIMESTAMP '2024-06-01 12:00:00')::BIGINT) / 86400.0::DOUBLE AS days FROM log")
def _(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", X.retention_left(F.col("moved_at"), NOW).alias("days"))


@query("f21_json", f"SELECT doc_id, json_array_length(d)::INT AS n, json_extract_string(d, '$[1].e') AS second FROM (SELECT doc_id, {DETAIL} AS d FROM labels JOIN documents USING (doc_id))")
def _(spark, sf_dir):
    v = detailed(spark, sf_dir)
    return v.select("doc_id", F.json_array_length("detail").alias("n"), vision.faces(F.col("detail"))[1]["e"].alias("second"))


@query("f23_boxes", "SELECT p_partkey, p_size * 3.0::DOUBLE AS area, (p_size / 2.0)::DOUBLE AS distance FROM part")
def _(spark, sf_dir):
    box = lambda left, right: F.array(left, F.lit(0.0), right, F.lit(3.0))
    size = F.col("p_size").cast("double")
    a, b = box(F.lit(0.0), size), box(F.lit(0.0), F.lit(0.0))
    return load(spark, sf_dir, "part").select("p_partkey", X.box_area(a).alias("area"), X.box_distance(a, b).alias("distance"))


@query("f25_kinds", f"WITH {LISTING}, e AS (SELECT lower(regexp_extract(path, '[.][^.]*$')) AS ext FROM listing) SELECT CASE WHEN ext IN ('.cr3', '.heif') THEN 'photo' WHEN ext = '.mov' THEN 'video' END AS kind, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf_dir):
    listing = load(spark, sf_dir, "pages").selectExpr(LISTED.replace("page_id % 7", "cast(floor(page_id / 6) AS long) % 7") + " AS path").distinct()
    return browse.count_by(listing, X.kind_of(X.extension(F.col("path")), sources.PHOTO, sources.VIDEO), "kind")


@query("f29_seconds", f"WITH {LOG} SELECT event_id, epoch(moved_at::TIMESTAMP)::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT AS s FROM log")
def _(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", (X.seconds_of(F.col("moved_at")) - X.seconds_of(F.lit("2024-01-01T00:00:00"))).alias("s"))


# Pictures: nine by eight grey values made of a digest

GREYS = "pictures AS (SELECT doc_id, list_transform(range(1, 73), lambda i: ascii(substr(md5(doc_id::VARCHAR) || md5('x' || doc_id) || md5('y' || doc_id), i, 1))) AS g FROM documents)"


def pictures(spark, sf_dir):
    content = "cast(concat('P5\n9 8\n255\n', substring(concat(md5(cast(cast(doc_id AS string) AS binary)), md5(cast(concat('x', doc_id) AS binary)), md5(cast(concat('y', doc_id) AS binary))), 1, 72)) AS binary) AS content"
    return images.fingerprints(load(spark, sf_dir, "documents").selectExpr("doc_id", content))


@query(
    "nd1_difference_hash",
    f"WITH {GREYS}, bits AS (SELECT doc_id, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN g[k // 8 * 9 + k % 8 + 1] > g[k // 8 * 9 + k % 8 + 2] THEN 1::HUGEINT << (63 - k) ELSE 0::HUGEINT END))::HUGEINT AS h FROM pictures) SELECT doc_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS dhash FROM bits",
)
def _(spark, sf_dir):
    return pictures(spark, sf_dir).select("doc_id", "dhash")


@query("nd2_flat", f"WITH {GREYS} SELECT doc_id, CASE WHEN list_aggregate(g, 'stddev_pop') < 4 THEN 'flat' ELSE 'ok' END AS status FROM pictures")
def _(spark, sf_dir):
    return pictures(spark, sf_dir).select("doc_id", "status")


@query(
    "nd3_sharpness",
    f"WITH {GREYS}, edges AS (SELECT doc_id, list_transform(range(0, 72), lambda k: greatest(0, least(255, 128 + g[greatest(k // 9 - 1, 0) * 9 + k % 9 + 1] + g[least(k // 9 + 1, 7) * 9 + k % 9 + 1] + g[k // 9 * 9 + greatest(k % 9 - 1, 0) + 1] + g[k // 9 * 9 + least(k % 9 + 1, 8) + 1] - 4 * g[k + 1]))) AS e FROM pictures) SELECT doc_id, round(list_aggregate(e, 'var_pop'), 6) AS sharp FROM edges",
)
def _(spark, sf_dir):
    return pictures(spark, sf_dir).select("doc_id", F.round("sharp", 6).alias("sharp"))


#: Pictures of 18 by 16, every fifth of them flat: each cell of the grid is four pixels about the digest's letter.
LARGER = GREYS.replace("list_transform(range(1, 73), lambda i: ", "list_transform(range(1, 73), lambda i: 1.5 + CASE WHEN doc_id % 5 = 0 THEN 100 ELSE ").replace(", i, 1)))", ", i, 1)) END)")


@query(
    "nd1_larger_pictures",
    f"WITH {LARGER}, bits AS (SELECT doc_id, g, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN g[k // 8 * 9 + k % 8 + 1] > g[k // 8 * 9 + k % 8 + 2] THEN 1::HUGEINT << (63 - k) ELSE 0::HUGEINT END))::HUGEINT AS h FROM pictures) SELECT doc_id, CASE WHEN list_aggregate(g, 'stddev_pop') < 4 THEN 'flat' ELSE 'ok' END AS status, CASE WHEN list_aggregate(g, 'stddev_pop') >= 4 THEN CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END END::BIGINT AS dhash FROM bits",
)
def _(spark, sf_dir):
    """Pictures that are shrunk, some of them without structure: these have no hash."""
    letter = "CASE WHEN doc_id % 5 = 0 THEN 100 ELSE ascii(substring(digest, cast(i div 18 div 2 * 9 + i % 18 div 2 + 1 AS int), 1)) END"
    pixels = f"array_join(transform(sequence(0, 287), i -> char({letter} + i div 18 % 2 + 2 * (i % 18 % 2))), '')"
    digest = "concat(md5(cast(cast(doc_id AS string) AS binary)), md5(cast(concat('x', doc_id) AS binary)), md5(cast(concat('y', doc_id) AS binary))) AS digest"
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", digest).selectExpr("doc_id", f"cast(concat('P5\n18 16\n255\n', {pixels}) AS binary) AS content")
    return images.fingerprints(rows).select("doc_id", "status", "dhash")


# Sources and sinks

#: Files that Spark makes in the shared folder, each of 64 documents in a row: names of cameras with `_`, and what a scan leaves out.
PLANTED = "concat('d', k % 13, '/', CASE k % 7 WHEN 0 THEN concat('_DSC', k, '.NEF') WHEN 1 THEN concat('IMG ', k, '.jpg') WHEN 2 THEN concat('_edits/x', k, '.jpg') WHEN 3 THEN concat('L', k % 3, '.photosLibrary/a/in', k, '.jpg') WHEN 4 THEN concat('.dot', k, '.jpg') WHEN 5 THEN concat('deep/er/_MG_', k, '.CR2') ELSE concat('.own/v', k, '.mov') END)"
SEEN = f"planted AS (SELECT {PLANTED} AS path, string_agg(text, '' ORDER BY doc_id) AS content FROM (SELECT doc_id // 64 AS k, * FROM documents) WHERE k % 7 NOT IN (2, 3, 4) GROUP BY k)"


def _written(at: str):
    """Writes the file of a group of rows (path, doc_id, text) below a folder."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fs, top = trees.file_system(at)
        fs.create_dir(f"{top}/{key[0]}".rpartition("/")[0])
        with fs.open_output_stream(f"{top}/{key[0]}") as out:
            for text in rows.sort_values("doc_id")["text"]:
                out.write((text or "").encode())
        return pd.DataFrame({"n": [len(rows)]})

    return run


def _zipped_up(at: str):
    """Writes an archive of the rows (path, doc_id, text) of a group, stored, with a folder entry."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fs, top = trees.file_system(at)
        fs.create_dir(top)
        with fs.open_output_stream(f"{top}/{key[0]}") as out, zipfile.ZipFile(out, "w") as z:
            z.writestr("Root/", b"")
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                z.writestr(f"Root/{doc_id}.jpg", (text or "").encode())
        return pd.DataFrame({"n": [len(rows)]})

    return run


def planted(spark, sf_dir, path: str, write) -> str:
    """The folder of files that `write` has made of all documents, 64 of them each."""
    at = fresh_path(spark, "tree")
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id div 64 AS k", "doc_id", "text").selectExpr(f"{path} AS path", "doc_id", "text")
    rows.groupBy("path").applyInPandas(write(at), "n long").agg(F.sum("n")).collect()
    return at


@query("sc1_walk", f"WITH {SEEN} SELECT path, strlen(content)::BIGINT AS size FROM planted")
def _(spark, sf_dir):
    return sources.walk(spark, planted(spark, sf_dir, PLANTED, _written)).select("path", "size")


@query("sc11_file_hashes", f"WITH {SEEN} SELECT path, strlen(content)::BIGINT AS size, sha1(content) AS sha1 FROM planted")
def _(spark, sf_dir):
    return sources.hashed(spark, planted(spark, sf_dir, PLANTED, _written)).select("path", "size", "sha1")


@query("sc7_zip_directories", "SELECT 'z' || doc_id // 64 || '.zip' AS zip, 'Root/' || doc_id || '.jpg' AS name, coalesce(strlen(text), 0)::BIGINT AS size FROM documents")
def _(spark, sf_dir):
    return sources.zip_entries(spark, planted(spark, sf_dir, "concat('z', k, '.zip')", _zipped_up)).select("zip", "name", "size")


@query("sc5_sidecar_geo", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 10.5 WHEN event_id % 3 = 1 THEN -20.5 END::DOUBLE AS lat, CASE WHEN event_id % 3 < 2 THEN 3.0 END::DOUBLE AS lon FROM events")
def _(spark, sf_dir):
    text = "concat('{\"geoData\":{\"latitude\":', CASE WHEN event_id % 3 = 0 THEN '10.5' ELSE '0.0' END, ',\"longitude\":', CASE WHEN event_id % 3 = 0 THEN '3.0' ELSE '0.0' END, '},\"geoDataExif\":{\"latitude\":', CASE WHEN event_id % 3 = 1 THEN '-20.5' ELSE '95.0' END, ',\"longitude\":3.0}}')"
    e = load(spark, sf_dir, "events").selectExpr("cast(event_id AS string) AS path", f"{text} AS value")
    return sources.parsed_sidecars(e).select(F.col("path").cast("long").alias("event_id"), "lat", "lon")


def _zipped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive for each row: a folder entry and a file with the row's text."""
    for part in parts:
        rows = []
        for path, name, text in zip(part["path"], part["name"], part["text"], strict=True):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("Root/", b"")
                z.writestr(f"Root/{name}", text.encode())
            rows.append((path, out.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query("sc6_zip_entries", "SELECT n_nationkey || '.zip' AS zip, 'Root/' || n_name AS name, strlen(n_name || n_nationkey)::BIGINT AS size FROM nation")
def _(spark, sf_dir):
    n = load(spark, sf_dir, "nation").selectExpr("concat(n_nationkey, '.zip') AS path", "n_name AS name", "concat(n_name, n_nationkey) AS text")
    return sources.zip_contents(n.mapInPandas(_zipped, "path string, content binary")).select("zip", "name", "size")


@query("sc8_library_list", "SELECT n_nationkey::BIGINT AS uuid, n_name AS filename FROM nation")
def _(spark, sf_dir):
    n, at = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS uuid", "n_name AS filename"), fresh_path(spark, "entry")
    n.agg(F.to_json(F.collect_list(F.struct("uuid", "filename")))).write.text(at)  # 25 rows
    return sources.library_list(spark, at).select("uuid", "filename")


@query("sc9_report", "SELECT CASE WHEN n_regionkey = 0 THEN 'MISSING' ELSE 'UNREADABLE' END AS kind, n_name AS path, CASE WHEN n_regionkey <> 0 THEN 'say \"no\"' END AS error FROM nation")
def _(spark, sf_dir):
    at = fresh_path(spark, "entry")
    n = load(spark, sf_dir, "nation").selectExpr("CASE WHEN n_regionkey = 0 THEN 'MISSING' ELSE 'UNREADABLE' END AS kind", "n_name AS path", "CASE WHEN n_regionkey <> 0 THEN 'say \"no\"' END AS error")
    sinks.write_report(n, at)
    return sources.report(spark, at)


@query("sc10_staging", f"WITH {LISTING}, s AS (SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name FROM listing) SELECT folder, coalesce(string_agg(name, ',' ORDER BY name) FILTER (regexp_matches(name, '(?i)[.](cr3|mov|heif)$')), '') AS media, coalesce(string_agg(name, ',' ORDER BY name) FILTER (regexp_matches(name, '(?i)[.]json$')), '') AS jsons, false AS is_primary FROM s GROUP BY 1")
def _(spark, sf_dir):
    listing = load(spark, sf_dir, "pages").selectExpr(LISTED.replace("page_id % 7", "cast(floor(page_id / 6) AS long) % 7") + " AS path")
    return sources.staging(listing).select("folder", F.array_join("media", ",").alias("media"), F.array_join("jsons", ",").alias("jsons"), "is_primary")


@query("sk4_rebuild", "SELECT s_suppkey AS id, s_name AS path FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf_dir):
    s, at = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS path"), fresh_path(spark, "entry")
    sinks.write_snapshot(s, at)
    sinks.write_snapshot(sinks.read_snapshot(spark, at).filter("id % 2 = 0"), at)  # all anew
    return sinks.read_snapshot(spark, at)


@query("sk7_two_writers", with_("marks") + "SELECT path, mark, CASE WHEN used_batch IS NULL AND mark = 'trash' THEN 'b2' ELSE used_batch END AS used_batch FROM marks", "marks")
def _(marks):
    """A batch stamps its marks while a withdrawal of the same marks is computed: that sees them used, and leaves them."""
    spark, at = marks.sparkSession, fresh_path(marks.sparkSession, "entry")
    started = sinks.write_snapshot(marks.select("path", "mark", "used_batch"), at, after=0)

    def withdrawn(now):
        if sinks.state_number(spark, at) == started:
            old = sinks.read_snapshot(spark, at, started)
            sinks.write_snapshot(decisions.stamp(old, old.filter("mark = 'trash'"), ["path"], "used_batch", "b2"), at, after=started)
        return decisions.withdraw(now, now.filter("mark = 'trash'"), ["path"])

    sinks.update_snapshot(spark, at, withdrawn)
    return sinks.read_snapshot(spark, at).select("path", "mark", "used_batch")


@query("sc3_catalogue", with_("files", "marks") + "SELECT 1 AS state, mark, count(*) AS n, sum(size)::BIGINT AS bytes FROM marks JOIN files USING (path) GROUP BY mark UNION ALL SELECT 2, mark, count(*), sum(size)::BIGINT FROM marks JOIN files USING (path) WHERE id % 3 <> 0 AND mark <> 'trash' GROUP BY mark", "files", "marks")
def _(files, marks):
    """What a reader of the first state and one of the second see, after both tables have gone on together."""
    spark, root = files.sparkSession, fresh_path(files.sparkSession, "catalogue")
    one = sinks.Catalogue(spark, root).publish({"files": files.select("id", "path", "size"), "marks": marks.select("path", "mark")})
    reader = sinks.Catalogue(spark, root)
    two = one.publish({"files": one.table("files").filter("id % 3 != 0"), "marks": one.table("marks").filter("mark != 'trash'")})
    seen = lambda c, k: c.table("marks").join(c.table("files"), "path").groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(F.lit(k).alias("state"), "mark", "n", "bytes")
    return seen(reader, 1).unionByName(seen(two, 2))


@query("sk11_manifest", "SELECT n_name AS \"from\", 'new/' || n_name AS \"to\" FROM nation")
def _(spark, sf_dir):
    at = fresh_path(spark, "entry")
    sinks.write_report(load(spark, sf_dir, "nation").selectExpr("n_name AS `from`", "concat('new/', n_name) AS `to`"), at)
    return sources.manifest(spark, at)


@query("sk12_rows", "SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def _(spark, sf_dir):
    rows = sinks.to_response(load(spark, sf_dir, "nation").selectExpr("n_name AS name", "cast(n_regionkey AS long) AS region"), 100)
    return spark.createDataFrame([(r["name"], r["region"]) for r in rows], "name string, region long")
