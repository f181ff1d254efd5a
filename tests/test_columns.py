import hashlib
import json
from math import gcd

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crucible.functions import columns as C
from crucible.functions.tables import bucketed, with_running

PARTS = "participants array<struct<compound_id:string,coefficient:double,compartment:string>>, direction string"
STRICT = "870e4775ef210a6ae56ac12aada6cf89ad420e7dce1a4e8f7a5fd10dc59e525c"
LOOSE = "20806530ee33077eb44a45662aa18ec8857719fb67072c9d5f2fb7cb564bfa30"
STRICT_WATER = "21ccd48346ee7624786731f3b8522b8a51aaa809237fe320ffdbd178d7b58c29"


def keys(spark, parts):
    df = spark.createDataFrame([([(c, float(n), None) for c, n in parts], "undefined")], PARTS)
    r = df.select(C.strict_key(F.col("participants"), F.col("direction")).alias("s"), C.loose_key(F.col("participants"), ["CHEBI:15377"]).alias("l")).first()
    return r.s, r.l


def test_golden_keys(spark):
    one = [("CHEBI:A", -1), ("CHEBI:B", 1)]
    assert keys(spark, one) == (STRICT, LOOSE)
    assert keys(spark, [("CHEBI:A", -2), ("CHEBI:B", 2)]) == (STRICT, LOOSE)  # scale
    assert keys(spark, one[::-1]) == (STRICT, LOOSE)  # order
    assert keys(spark, [*one, ("CHEBI:15377", 1)]) == (STRICT_WATER, LOOSE)


def test_reduced_coefficients_match_python(spark):
    cases = [[], [("A", -2)], [("A", -2), ("B", 2)], [("B", 0.5), ("A", 4)], [("A", 6), ("A", -9), ("C", 15)], [("A", 1e6), ("B", 999_999)]]
    df = spark.createDataFrame([([(c, float(n), None) for c, n in x], None) for x in cases], PARTS)
    got = [[tuple(p) for p in r.r] for r in df.select(C.reduced_coefficients(F.col("participants")).alias("r")).collect()]
    for x, y in zip(cases, got, strict=True):
        d = 0
        for _, n in x:
            d = gcd(d, int(abs(n)))
        d = max(d, 1)
        assert y == sorted((c, int(n) // d, None) for c, n in x)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=8)), max_size=4))
def test_json_text_equals_python(spark, items):
    df = spark.createDataFrame([(items,)], "x array<string>")
    got = df.select(C.json_list(F.transform("x", C.json_text)).alias("j")).first().j
    assert got == json.dumps(items, ensure_ascii=False, separators=(",", ":"))
    assert df.select(C.stable_hash(F.lit(got))).first()[0] == hashlib.sha256(got.encode()).hexdigest()


@pytest.mark.parametrize(("have", "want"), [(["left_to_right"], "left_to_right"), (["right_to_left"], "right_to_left"), (["left_to_right", "right_to_left"], "reversible"), (["reversible", "left_to_right"], "reversible"), ([], "undefined"), (None, "undefined")])
def test_direction_policy(spark, have, want):
    df = spark.createDataFrame([(have,)], "d array<string>")
    assert df.select(C.direction_policy(F.col("d"))).first()[0] == want


def test_label_tokens(spark):
    df = spark.createDataFrame([(["1.2.3.4", "1.2", "7"],), ([],), (None,)], "e array<string>")
    get = lambda level: [sorted(r[0]) for r in df.select(C.label_tokens(F.col("e"), level)).collect()]
    assert get("1") == [["1", "7"], [], []]
    assert get("2") == [["1.2"], [], []]
    assert get("3") == [["1.2.3"], [], []]
    assert get("exact") == [["1.2", "1.2.3.4", "7"], [], []]


def test_split_sides_and_first_group(spark):
    df = spark.createDataFrame([("A.B>>C",), (">>C.D",), ("A",), (None,), ("A>>B>>C",)], "s string")
    left, right = C.split_sides("s")
    assert [(r[0], r[1]) for r in df.select(left, right).collect()] == [(["A", "B"], ["C"]), ([], ["C", "D"]), ([], []), ([], []), (["A"], ["B>>C"])]
    assert spark.createDataFrame([("x RHEA:release=141 y",), ("none",)], "s string").select(C.first_group("s", r"release=(\d+)")).collect() == [("141",), (None,)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(C.norm(F.col("a")), C.cosine(F.col("a"), F.col("b")), C.all_finite(F.col("a"))).collect()
    assert rows[0][0] == 5.0 and abs(rows[0][1] - 0.96) < 1e-12 and rows[1][1] == 0.0 and rows[0][2]
    assert spark.createDataFrame([([float("nan")],), ([float("inf")],), ([None],)], "a array<double>").select(C.all_finite(F.col("a"))).collect() == [(False,)] * 3


def test_running_numbers_and_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = with_running(df, ["x"], "i", ("x", "t")).orderBy("x").collect()
    assert [r.i for r in rows] == list(range(1, 1001))
    assert all(r.t == r.x * (r.x + 1) // 2 for r in rows)
    assert with_running(df.limit(0), ["x"], "i", ("x", "t")).count() == 0


def test_bucketed_tables_meet_without_shuffle(spark):
    a = bucketed(spark.range(500).select("id", (F.col("id") * 2).alias("a")), "left", "id").hint("merge")
    b = bucketed(spark.range(100, 600).select("id", F.array("id").alias("b")), "right", "id")
    joined = a.join(b, "id", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500 and joined.filter("b[0] = id").count() == 400
    grouped = spark.range(2000).selectExpr("id % 700 AS id").groupBy("id").count().join(a, "id")
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and grouped.count() == 500
