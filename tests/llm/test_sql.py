"""Queries against DuckDB on the smallest tables: whole results where there is SQL, parts of the columns of others."""

import os
from collections import Counter

import duckdb
import pytest

from crucible.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

SIZES = """
SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size
FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents)
"""
BYTES = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents"
NEAREST = """
SELECT query_id, rank, vec_id FROM (
  SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20
"""


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in ("documents", "embeddings"):
        c.execute(f"create view {f} as select * from read_parquet('{FOLDER}/{f}.parquet')")
    return c


def rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, Counter(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    names, want = rows(con, ORACLE_SQL[name])
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == want


@pytest.mark.parametrize(("name", "sql"), [("op1_splitting_tree_mix", SIZES), ("op4_virtual_slots", BYTES), ("op9_pruned_graph", NEAREST)])
def test_columns_equal_sql(spark, con, name, sql):
    """op9 finds all neighbours on a table as small as this."""
    names, want = rows(con, sql)
    assert Counter(map(tuple, QUERIES[name](spark, FOLDER).select(*names).collect())) == want


def test_slots_have_no_gaps(spark):
    found = QUERIES["op4_virtual_slots"](spark, FOLDER).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] == r["count(1)"] - 1 for r in found)
