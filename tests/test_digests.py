"""Digest trees: equal for equal rows however they lie, and differences are found where they are."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from crucible.operators import digests as D

KIND = "k long, s string, x double"


def rows(n):
    return [(i, None if i % 7 == 0 else f"v{i}é\"", i / 4) for i in range(n)] + [(1, "often", 0.0)] * 50


def test_tree_equals_plain_digests(spark):
    df = spark.createDataFrame(rows(60), KIND)
    tree = {(r.level, r.prefix): (r.row_count, r.digest) for r in D.digest_tree(df.repartition(5), 2).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    have = {}
    for k, s, x in rows(60):
        d = sha(json.dumps({"k": k, "s": s, "x": x}, separators=(",", ":"), ensure_ascii=False))
        have[d] = have.get(d, 0) + 1
    level = {}
    for d, n in sorted(have.items()):
        level.setdefault(d[:2], []).append(f"{d}:{n}")
    level = {p: sha(",".join(x)) for p, x in level.items()}
    for depth in (2, 1, 0):
        assert {p: tree[depth, p][1] for d, p in tree if d == depth} == level
        up = {}
        for p, d in sorted(level.items()):
            up.setdefault(p[: depth - 1], []).append(f"{p}={d}")
        level = {p: sha(",".join(x)) for p, x in up.items()}
    assert tree[0, ""][0] == 110


def test_differences_are_found(spark):
    a = spark.createDataFrame(rows(500), KIND)
    changed = [r if r[0] != 77 else (77, "other", 0.5) for r in rows(500)][:-2] + [(9999, "new", 1.0)]
    b = spark.createDataFrame(changed, KIND).repartition(7).select("x", "s", "k")
    ta, tb = D.digest_tree(a, 2), D.digest_tree(b, 2)
    assert D.differing_nodes(ta, D.digest_tree(a.orderBy(F.desc("x")), 2)).count() == 0
    nodes = D.differing_nodes(ta, tb).collect()
    assert {n.level for n in nodes} == {0, 1, 2} and sum(n.level == 2 for n in nodes) <= 4
    got = sorted(tuple(r) for r in D.changed_rows(a, b, 2).collect())
    assert got == [("a", 1, 77, rows(500)[77][1], 77 / 4), ("a", 2, 1, "often", 0.0), ("b", 1, 77, "other", 0.5), ("b", 1, 9999, "new", 1.0)]


def test_odd_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert D.digest_tree(none).count() == 0 and D.changed_rows(none, none).count() == 0
    one = spark.createDataFrame([(None, None, None)], KIND)
    assert D.changed_rows(none, one).collect()[0].asDict() == {"side": "b", "times": 1, "k": None, "s": None, "x": None}
    assert D.digest_tree(one).first().level == 0


@pytest.mark.parametrize(("n", "depth"), [(0, 0), (2048, 0), (2049, 1), (10**6, 3), (10**15, D.MOST_DEPTH)])
def test_depth(n, depth):
    assert D.depth_for(n) == depth
