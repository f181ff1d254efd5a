"""Neighbours through pivots against all pairs, and how many cells they compare."""

import numpy as np
import pytest

from crucible.operators import pivots as P
from crucible.operators.similarity import exact_neighbours


def frame(spark, m, kind="long"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"id {kind}, v array<double>").repartition(3)


def clustered(rng, n, centres=24, dim=16, spread=0.05):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def brute(m, k, asks=lambda i: True):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    out = []
    for i in range(len(m)):
        if asks(i):
            c = np.einsum("ij,j->i", u, u[i])
            order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-round(c[j], 12), j))[:k]
            out += [(i, r + 1, j, round(float(c[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted((r.query, r.rank, r.neighbour, round(r.cosine, 9)) for r in df.collect())


def test_equal_to_all_pairs_and_fewer_of_them(spark, monkeypatch):
    rng, made, settled = np.random.default_rng(1), {}, P.settled
    monkeypatch.setattr(P, "settled", lambda df, name: made.setdefault(name, settled(df, name)))
    m = clustered(rng, 1200)
    df = frame(spark, m)
    got = rows(P.pivot_neighbours(df, 5, "id", "v", cell=40, block=64))
    assert got == brute(m, 5)
    assert got == rows(exact_neighbours(df, 5, "id", "v"))
    cells = made["neighbour-cells"].select("_cell").distinct().count()
    assert cells > 20
    assert made["neighbour-asks"].count() < 0.5 * len(m) * (cells - 1)  # cells asked, of all others


@pytest.mark.parametrize("dim", [2, 8])
def test_evenly_spread_with_ties_zeros_and_chosen_queries(spark, dim):
    rng = np.random.default_rng(dim)
    m = rng.normal(size=(300, dim))
    m[40:80] = m[0]  # a group of equal vectors
    m[100:110] = 0.0
    m[110] = 1e-14
    m[120:140] *= rng.random((20, 1)) * 1e6
    df = frame(spark, m)
    assert rows(P.pivot_neighbours(df, 7, "id", "v", cell=30, block=16)) == brute(m, 7)
    asked = P.pivot_neighbours(df, 3, "id", "v", cell=50, queries=df.id % 10 == 0)
    assert rows(asked) == brute(m, 3, lambda i: i % 10 == 0)


def test_few_rows_and_none(spark):
    assert P.pivot_neighbours(frame(spark, np.zeros((1, 2))).limit(0), 3, "id", "v").count() == 0
    assert rows(P.pivot_neighbours(frame(spark, np.eye(3)), 5, "id", "v", cell=1)) == brute(np.eye(3), 5)
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), (None, [1.0, 1.0]), ("c", [1.0, 1.0])], "id string, v array<double>")
    assert [(r.query, r.neighbour) for r in P.pivot_neighbours(odd, 2, "id", "v").orderBy("query").collect()] == [("a", "c"), ("c", "a")]


def test_blocks_copy_vectors_by_blocks_and_not_by_cells(spark, monkeypatch):
    """What is shuffled beyond a vector's own cell: before, a row for each query and cell that it asks."""
    from crucible.operators import similarity as T

    m = np.random.default_rng(3).normal(size=(400, 8))
    copies = []
    real = T.in_blocks

    def spied(asking, asked, n_ask, n, dim, block, of_queries, meet):
        copies.append((asking.count(), asked.count(), -(-n_ask // block)))
        return real(asking, asked, n_ask, n, dim, block, of_queries, meet)

    monkeypatch.setattr(P, "in_blocks", spied)
    assert rows(P.pivot_neighbours(frame(spark, m), 5, "id", "v", cell=10, block=200)) == brute(m, 5)
    assert copies == [(400, 400, 2)]


def test_copies_and_batches_keep_ties_by_identifier(spark):
    """A block meets its candidates in several batches; of equal vectors the smaller identifiers stay."""
    m = np.repeat(np.random.default_rng(5).normal(size=(6, 4)), 30, axis=0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got, few = rows(exact_neighbours(frame(spark, m), 4, "id", "v", block=50)), rows(P.pivot_neighbours(frame(spark, m), 4, "id", "v", cell=20, block=50))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(m, 4) == few


def test_far_cells_are_out_of_reach():
    m = clustered(np.random.default_rng(1), 1200)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    pivots = u[:30]
    angle = P._angles(u, pivots)
    cell = angle.argmin(axis=1)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    bar = np.sort(np.where(cell[:, None] == cell[None], s, -2), axis=1)[:, -5]
    asked = 0
    for c in range(30):
        r = P.reach(angle[:, c], angle[cell == c, c].min(), angle[cell == c, c].max())
        assert (r >= s[:, cell == c].max(axis=1)).all()  # a bound of what a member gives
        asked += int((r >= bar)[cell != c].sum())
    assert asked < 0.5 * len(u) * 29
