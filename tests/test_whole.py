"""Queries give the whole of their tables, by plain Python over the smallest ones."""

import json
import os
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from crucible import queries
from crucible.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def test_positional_zip_has_every_position(spark):
    want = Counter()
    for r in rows_of("documents"):
        if r["text"] is not None:
            right = (r["source"] or "").split("c")
            want.update((r["doc_id"], i, w, right[i] if i < len(right) and r["source"] is not None else None) for i, w in enumerate(r["text"].split(" ")))
    assert Counter(map(tuple, QUERIES["positional_zip"](spark, FOLDER).collect())) == want


def test_index_xrefs_has_every_event(spark):
    want = defaultdict(lambda: defaultdict(set))
    for r in rows_of("events"):
        want[r["user_id"]][r["event_type"]].add(json.loads(r["props"])["k"])
    got = {r.user_id: json.loads(r.xrefs) for r in QUERIES["index_xrefs"](spark, FOLDER).collect()}
    assert got == {u: {t: sorted(k) for t, k in x.items()} for u, x in want.items()}


def test_collapse_report_draws_all_pairs(spark, monkeypatch):
    seen, draw = [], queries.Q.random_pairs
    monkeypatch.setattr(queries.Q, "random_pairs", lambda df, i, v, n, *a, **b: seen.append(n) or draw(df, i, v, n, *a, **b))
    assert QUERIES["collapse_report"](spark, FOLDER).count() == 1 and seen == [200_000]


def test_vector_queries_use_every_component(spark):
    rows = {r["vec_id"]: r for r in rows_of("embeddings")}
    wide = QUERIES["embedding_wide"](spark, FOLDER).collect()
    assert {r.vec_id: list(r)[1:] for r in wide} == {i: r["embedding"] for i, r in rows.items()}
    sums = defaultdict(float)
    for r in rows.values():
        for d, x in enumerate(r["embedding"]):
            sums[r["label"], d] += x
    got = {(r.label, r.dim): r.x for r in QUERIES["segment_sum"](spark, FOLDER).collect()}
    assert got.keys() == sums.keys() and all(abs(got[k] - x) < 2e-6 for k, x in sums.items())
    assert all(r.a + r.b == rows[r.vec_id]["embedding"] for r in queries.views(spark, FOLDER).collect())
    keys = Counter(tuple((x > 0) - (x < 0) for x in (sum(r["embedding"][i : i + 16]) for i in range(0, 64, 16))) for r in rows.values())
    excess = QUERIES["dup_excess"](spark, FOLDER).first()
    assert (excess.distinct_count, excess.duplicate_excess) == (len(keys), len(rows) - len(keys))
    assert QUERIES["vector_duplicates"](spark, FOLDER).count() == sum(n > 1 for n in keys.values())
    assert all(r.loss is not None for n in ("label_loss", "info_nce", "variance_loss", "covariance_loss") for r in QUERIES[n](spark, FOLDER).collect())
