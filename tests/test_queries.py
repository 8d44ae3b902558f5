"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidechart.bindings import TABLES
from tidechart.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, small, duck):
    own = QUERIES[name](spark, small)
    names = sorted(own.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in own.collect()), key=repr)
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and y is not None and abs(x - y) <= 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
