"""Every query that SQL can express against DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siftline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    want = sorted(str([plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
