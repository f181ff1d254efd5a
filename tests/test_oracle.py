"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from crucible.oracle import SQL
from crucible.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def value(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = sorted(repr([value(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(repr([value(r[i]) for i in order]) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
