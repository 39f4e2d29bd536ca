"""The registered corpus queries: columns of their contracts, whole tables, and their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from larkspur.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_licenses": "doc_id n_matches licenses best_license best_dice",
    "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_lines": "doc_id n_lines n_dropped kept_sha256",
    "op12_divergence": "lang source part item value rank",
    "op13_periodic": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "rules_ablation": "rule n_failed n_only n_kept_without",
}


def plain(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert not name.startswith("op") or name == "op12_divergence" or len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        rel = con.sql(SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns and got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
