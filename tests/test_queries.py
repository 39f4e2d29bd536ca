"""Every registered catalogue query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from larkspur.plans.entries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_queries_without_sql(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0
