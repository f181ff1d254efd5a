import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.operators import losses as L
from crucible.operators import quality as Q
from crucible.operators import segments as S
from crucible.operators import similarity as T
from crucible.operators import validate as V


def table(spark, m, labels=None):
    return spark.createDataFrame([(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(m)], "id long, v array<double>, labels array<string>")


@pytest.mark.parametrize("block", [7, 64])
def test_neighbours_equal_brute_force_with_ties(spark, block):
    rng = np.random.default_rng(1)
    m = rng.integers(-1, 2, (40, 4)).astype(float) + 0.0
    got = {}
    for r in T.exact_neighbours(table(spark, m), 5, "id", "v", block=block).collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbour))
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 12)
    for i in range(40):
        mine = sorted(got[i])
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5] and i not in [n for _, n in mine]
        want = sorted((j for j in range(40) if j != i), key=lambda j: -s[i, j])[:5]
        assert [s[i, n] for _, n in mine] == [s[i, n] for n in want]


def test_metrics_equal_loops_with_several_tokens(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 6))
    pool = ["1.1.1.1", "1.1.2.3", "1.2.1.1", "2.1.1.1", "2.1", "3"]
    labels = [None if i % 6 == 0 else list(rng.choice(pool, size=rng.integers(0, 4))) for i in range(60)]
    df = table(spark, m, labels)
    near = T.exact_neighbours(df, 10, "id", "v").persist()
    got = {(r.level, r.k): r for r in T.retrieval_metrics(near, df, "id", "labels").collect()}
    order = {}
    for r in near.collect():
        order.setdefault(r.query, {})[r["rank"]] = r.neighbour

    def tokens(x, level):
        if level == "exact":
            return set(x or [])
        n = int(level)
        return {".".join(e.split(".")[:n]) for e in x or [] if len(e.split(".")) >= n}

    for level in T.LEVELS:
        sets = [tokens(x, level) for x in labels]
        valid = [i for i, x in enumerate(sets) if x]
        for k in (1, 5, 10):
            hit = anyhit = rp = rh = 0.0
            for i in valid:
                h = [bool(sets[i] & sets[order[i][j]]) for j in range(1, k + 1)]
                hit, anyhit = hit + sum(h), anyhit + any(h)
                c = sum(bool(sets[i] & sets[j]) for j in range(60) if j != i)
                rp += c / 59
                p = 1.0
                for d in range(k):
                    p *= (59 - c - d) / (59 - d)
                rh += 1 - p
            r, n = got[level, k], len(valid)
            assert r.annotated_query_count == n
            for a, b in ((r.precision, hit / n / k), (r.hit_rate, anyhit / n), (r.random_precision, rp / n), (r.random_hit_rate, rh / n)):
                assert abs(a - b) < 1e-12
    paired = {r.level: r for r in T.paired_top1(near, near, df, "id", "labels").collect()}
    assert all(r.delta == 0 and r.improved == r.worsened == 0 for r in paired.values())


def test_no_hit_formula(spark):
    assert abs(1 - spark.range(1).select(T.no_hit(F.lit(4.0), F.lit(1.0), 2)).first()[0] - 0.5) < 1e-12


def test_spectrum_and_collapse_equal_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 8)) * np.arange(1, 9)
    df = table(spark, m)
    got = np.array([r.eigenvalue for r in Q.spectrum(df, "v").orderBy("component").collect()])
    want = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2 / 299
    assert np.allclose(got, want)
    r = want / want.sum()
    assert abs(Q.rank_measures(got)["effective_rank"] - np.exp(-(r * np.log(r)).sum())) < 1e-9
    report = Q.collapse_report(df, "id", "v", n_pairs=500).first()
    assert not report.passed and not report.effective_rank_ok and report.duplicates_ok  # eight dimensions cannot have rank 20
    flat = Q.collapse_report(table(spark, np.ones((5, 3))), "id", "v", n_pairs=10).first()
    assert flat.zero_variance_count == 3 and flat.duplicate_excess == 4 and not flat.passed


def test_duplicates_by_value_and_by_bits(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0])], "id int, v array<float>")
    assert Q.duplicate_excess(df, "v").first().duplicate_excess == 2
    assert Q.duplicate_excess(df, "v", numeric=False).first().duplicate_excess == 1


def test_quantiles_interpolate(spark):
    x = [0.3, 0.1, 0.9, 0.4]
    r = Q.quantiles(spark.createDataFrame([(v,) for v in x], "x double"), "x", (0.05, 0.95), (0.4,)).first()
    assert np.allclose([r.p05, r.p95], np.quantile(x, [0.05, 0.95])) and r.count_ge_0_4 == 2 and abs(r.std - np.std(x)) < 1e-12


def test_losses_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    df = spark.createDataFrame([(0, i, a[i].tolist(), b[i].tolist()) for i in range(6)], "g int, i int, a array<double>, b array<double>")
    var = np.mean([np.maximum(1 - np.sqrt(x.var(0) + 1e-4), 0).mean() for x in (a, b)])
    cov = np.mean([((c := np.cov(x.T)) - np.diag(np.diag(c))).__pow__(2).sum() / 4 for x in (a, b)])
    s = a @ b.T / 0.1
    lse = lambda z: np.log(np.exp(z).sum(1))
    nce = ((lse(s) - np.diag(s)).mean() + (lse(s.T) - np.diag(s)).mean()) / 2
    assert abs(L.variance_loss(df, "g", ["a", "b"]).first().loss - var) < 1e-12
    assert abs(L.covariance_loss(df, "g", ["a", "b"]).first().loss - cov) < 1e-12
    assert abs(L.info_nce(df, "g", "i", "a", "b").first().loss - nce) < 1e-9
    none = df.withColumn("t", F.array(*[F.lit(0.0)] * 4))
    assert L.label_loss(none, "g", "a", "t").first().loss == 0.0


def test_segments(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 4.0], 2.0), ("b", [5.0, 6.0], 700.0)], "s string, v array<double>, x double")
    assert {r.s: r.v for r in S.segment_sum(df, "s", "v").collect()} == {"a": [4.0, 6.0], "b": [5.0, 6.0]}
    w = {(r.s, r.x): r.weight for r in S.segment_softmax(df, "s", "x").collect()}
    assert abs(w["a", 2.0] - 1 / (1 + np.exp(-1))) < 1e-12 and w["b", 700.0] == 1.0
    n = S.segment_counts(df, spark.createDataFrame([("a",), ("b",), ("c",)], "s string"), "s")
    assert {r.s: r.n for r in n.collect()} == {"a": 2, "b": 1, "c": 1}
    assert [(r.s, r.begin, r.end) for r in S.pointers(df, "s").orderBy("s").collect()] == [("a", 0, 2), ("b", 2, 3)]


def test_split_rules(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    assert {r.split: r["count"] for r in S.split(df, "i", 0.1).groupBy("split").count().collect()} == {"validation": 2, "train": 18}
    assert S.split(df, "i", 0.0).filter("split = 'validation'").count() == 0
    assert S.split(df, "i", 0.1).orderBy("i").collect() == S.split(df, "i", 0.1).orderBy("i").collect()
    for bad in (1.0, -0.1):
        with pytest.raises(ValueError):
            S.split(df, "i", bad)
    with pytest.raises(ValueError):
        S.split(df.limit(0), "i", 0.1)


def test_best_so_far_is_strict(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 2.0), (4, 2.5)], "e int, l double")
    assert [r.is_best for r in S.best_so_far(df, "e", "l").orderBy("e").collect()] == [True, False, True, False]


def test_constraints_and_requirement(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "i int, s string")
    checks = V.union(V.check_rows(df, {"known": F.col("s").isin("a", "b")}), V.check_unique(df, ["i"], "once"), V.check_count(df, 3, "three"))
    assert {r.rule: r.violations for r in checks.collect()} == {"known": 1, "once": 1, "three": 0}
    with pytest.raises(ValueError, match="known: 1; once: 1"):
        V.require(checks)
    assert V.check_same_rows(df, df, "same").first().violations == 0


def test_suite_equals_single_checks_and_reads_each_table_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (None, "a", 1.0), (3, "a", -1.0), (4, None, 1.0)], "i int, s string, x double").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1,), (1,), (None,), (5,)], "j int").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    suite = V.Suite().rows(a, {"positive": F.col("x") > 0, "any": F.lit(True)}).unique(a, ["i"], "once").unique(a, ["i", "s"], "pair_once").complete(a, "i", "s", ["b", "a"], "both")
    suite.references(a, "i", b, "known", "j").references(b, "j", a, "used", "i").references(a, "i", b, "known_b", "j", where=F.col("s") == "b")
    got = suite.checks()
    pairs = lambda x: {r.rule: r.violations for r in x.collect()}
    want = V.union(
        V.check_rows(a, {"positive": F.col("x") > 0, "any": F.lit(True)}), V.check_unique(a, ["i"], "once"), V.check_unique(a, ["i", "s"], "pair_once"), V.check_complete(a, "i", "s", ["a", "b"], "both"),
        V.check_references(a, "i", b.withColumnRenamed("j", "i"), "known"), V.check_references(b.withColumnRenamed("j", "i"), "i", a, "used"), V.check_references(a.filter("s = 'b'"), "i", b.withColumnRenamed("j", "i"), "known_b"),
    )
    assert pairs(got) == pairs(want) == {"positive": 2, "any": 0, "once": 1, "pair_once": 0, "both": 3, "known": 3, "used": 2, "known_b": 0}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_quantiles_of_a_value_that_most_rows_have(spark):
    """Equal values never stand in one task as rows: what is numbered are the distinct values."""
    x = np.concatenate([np.full(9000, 0.25), np.random.default_rng(3).random(1000), [np.inf, -1.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    shares = (0.0, 0.05, 0.5, 0.95, 0.99)
    got = Q.exact_quantiles(df, "x", shares)
    assert all(abs(got[p] - np.quantile(x, p)) < 1e-12 for p in shares)
    assert Q.exact_quantiles(df.filter("x IS NULL"), "x", shares) == dict.fromkeys(shares)


def test_match_counts_without_pairs(spark):
    """Many different lists that share two tokens: as counted by brute force, and no step has a row for each pair."""
    rng = np.random.default_rng(2)
    rows = [("1", i, sorted({"a", "b", f"t{i}"})) for i in range(1500)] + [("1", 2000 + i, sorted({f"t{x}" for x in rng.integers(0, 40, rng.integers(1, 5))})) for i in range(300)]
    rows += [("2", i, ["a"] if i % 3 else ["a", "c"]) for i in range(60)]
    df = spark.createDataFrame(rows, "level string, id long, tokens array<string>").repartition(3)
    got = T.match_counts(df)
    want = {}
    for level in ("1", "2"):
        mine = [(i, set(t)) for v, i, t in rows if v == level]
        for i, t in mine:
            want[level, i] = sum(bool(t & u) for _, u in mine) - 1
    assert {(r.level, r.id): r.matches for r in got.collect()} == want


def test_monotone_violations(spark):
    df = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.7), ("p", 2, 0.1)], "q string, r int, s double")
    assert tuple(Q.monotone_violations(df, "q", "r", "s", 2).first()) == (1, 1, 1)


def test_evaluation_mode(spark):
    ids = spark.createDataFrame([(i,) for i in range(4)], "id int")
    assert T.evaluation_mode(ids, ids.filter("id < 3"), ids.filter("id = 3")) == "transductive"
    assert T.evaluation_mode(ids, ids.filter("id < 2"), ids.filter("id = 3")) == "holdout"
    with pytest.raises(ValueError):
        T.evaluation_mode(ids.filter("id < 2"), ids, ids)


def test_same_order_and_revision(spark, tmp_path):
    from crucible.sources.sinks import git_revision

    kind = "p int, id string"
    a = spark.createDataFrame([(0, "x"), (1, None), (2, "z")], kind)
    assert V.check_same_order(a, a, "p", "id", "r").first().violations == 0
    b = spark.createDataFrame([(0, "x"), (1, "y"), (3, "z")], kind)
    assert V.check_same_order(a, b, "p", "id", "r").first().violations == 3  # another value, and a place that each lacks
    assert git_revision(str(tmp_path)) is None


def test_stage_uniqueness_plan_and_values(spark):
    """Two shuffles, none of all a group's vectors; a group of one row, one of repeats, one that falls together at the second stage."""
    rows = [("a", [1.0, 5.0], [0.5])] + [("b", [2.0, 2.0], [1.0])] * 5 + [("c", [float(i), -3.0 * i], [7.0]) for i in range(6)] + [(None, [0.0, 1.0], [1.0]), (None, [0.0, 1.5], [3.0])]
    got = Q.stage_uniqueness(spark.createDataFrame(rows, "g string, first array<float>, second array<float>").repartition(3), "g", ["first", "second"])
    want = {("a", 1, 1, 1, 0.0, 0.0, "first"), ("b", 5, 1, 1, 0.0, 0.0, "first"), ("c", 6, 6, 1, 15.0, 0.0, "second"), (None, 2, 2, 2, 0.5, 2.0, "not_exact_before_output")}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
    first = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert first.count("Exchange hashpartitioning") == 2


def test_blocks_meet_wherever_their_partitions_are(spark):
    """Before, keys of both sides had different types, so with several partitions blocks missed each other and rows were lost."""
    m = np.random.default_rng(11).normal(size=(90, 6))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r["query"], r["rank"], r["neighbour"]) for r in T.exact_neighbours(table(spark, m), 5, "id", "v", block=16).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(90)
    want = {i: [j for j in np.argsort(-s[i], kind="stable")[:5]] for i in range(90)}
    ids = sorted({q for q, _, _ in got})
    assert len(got) == 450 and all([n for q, _, n in got if q == ids[i]] == [ids[j] for j in want[i]] for i in range(90))
