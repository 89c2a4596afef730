"""Every registered query with SQL against DuckDB on the smallest tables: names, types and rows."""

import math
import os

import duckdb
import pytest

from tests.conftest import DATA
from textloom import plans

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0
