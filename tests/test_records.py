import random
from collections import defaultdict

from pyspark.sql import functions as F

from crucible.operators import evidence as E
from crucible.operators import records as R

KINDS = "record_id string, side string, pos int, compound_id string, original string, canonical string, status string"


def test_participants_worst_status_first_original_and_sign(spark):
    rows = [("r", "reactant", 1, "A", "o1", "CA", "sanitized"), ("r", "reactant", 0, "A", "o0", "CA", "unsanitized"), ("r", "product", 0, "A", "p", "CA", "sanitized"), ("r", "product", 1, "B", None, None, "failed")]
    got = {(x.side, x.compound_id): (x.coefficient, x.original, x.status, x.missing) for x in R.participants(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {("reactant", "A"): (-2.0, "o0", "unsanitized", False), ("product", "A"): (1.0, "p", "sanitized", False), ("product", "B"): (1.0, None, "failed", True)}
    log = R.changes(spark.createDataFrame(rows, KINDS)).collect()
    assert len(log) == 3  # null equals null


def test_balance_is_three_valued(spark):
    kind = "record_id string, side string, compound_id string, atoms map<string,bigint>, charge bigint, unknown_atoms int"
    rows = [
        ("ok", "reactant", "A", {"C": 1, "H": 4}, 0, 0), ("ok", "product", "B", {"C": 1, "H": 4}, 0, 0),
        ("off", "reactant", "A", {"C": 1}, 0, 0), ("off", "product", "B", {"C": 2, "O": 1}, 1, 0),
        ("generic", "reactant", "POLYMER:1", {"C": 1}, 0, 0), ("generic", "product", "B", None, None, 0),
        ("failed", "reactant", "A", None, None, 0), ("wild", "reactant", "A", {"*": 1}, 0, 1),
    ]
    got = {r.record_id: (r.is_balanced, r.status, r.reason, r.element_delta, r.charge_delta) for r in R.balance(spark.createDataFrame(rows, kind)).collect()}
    assert got["ok"] == (True, "balanced", None, "{}", 0)
    assert got["off"] == (False, "imbalanced", None, '{"C":1,"O":1}', 1)
    assert got["generic"][:3] == (None, "unknown", "generic_or_polymeric_participant")
    assert got["failed"][:3] == (None, "unknown", "smiles_parse_failure")
    assert got["wild"][:3] == (None, "unknown", "generic_or_polymeric_participant")


def test_coverage_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "participants array<struct<c:string>>, x string")
    assert R.coverage(df, {"x": F.col("x").isNotNull()}, {"c": lambda p: p["c"] != ""}).first().asDict() == {"x": 0.0, "c": 0.0}


def test_duplicates_winner_conflict_and_map(spark):
    kind = "record_id string, strict_key string, loose_key string, status string, labels array<string>"
    rows = [("RHEA:20", "k1", "l", "balanced", ["b"]), ("RHEA:3", "k1", "l", "balanced", None), ("RHEA:5", "k2", "l", "balanced", []), ("RHEA:6", "k2", "m", "unknown", []), ("RHEA:9", "k3", "n", "balanced", ["z"])]
    resolved = R.resolve_duplicates(spark.createDataFrame(rows, kind))
    got = {r.record_id: (r.canonical_id, r.dedup_status) for r in resolved.collect()}
    assert got == {"RHEA:20": ("RHEA:3", "merged_strict_exact"), "RHEA:3": ("RHEA:3", "kept"), "RHEA:5": ("RHEA:5", "kept_conflict"), "RHEA:6": ("RHEA:6", "kept_conflict"), "RHEA:9": ("RHEA:9", "kept")}
    kept = {r.record_id: (r.equivalent_ids, r.labels) for r in R.merged(resolved).collect()}
    assert kept["RHEA:3"] == (["RHEA:3", "RHEA:20"], ["b"])  # numbers, not texts, order
    assert kept["RHEA:5"] == (["RHEA:5"], None)
    assert set(kept) == {"RHEA:3", "RHEA:5", "RHEA:6", "RHEA:9"}
    loose = R.loose_candidates(resolved.filter("record_id = canonical_id")).collect()
    assert [(r.loose_key, r.record_ids, r.candidate_count) for r in loose] == [("l", ["RHEA:3", "RHEA:5"], 2)]
    stats = R.dedup_stats(resolved).first()
    assert (stats.record_count, stats.retained_count, stats.duplicate_group_count, stats.label_conflict_group_count, stats.conflict_group_count) == (5, 4, 2, 1, 1)
    sources = spark.createDataFrame([(r[0],) for r in rows] + [("RHEA:77",)], "record_id string")
    assert ("RHEA:77", None, "excluded_missing_rxn") in [tuple(r) for r in R.id_map(resolved, sources).collect()]


def test_null_statuses_conflict_with_values(spark):
    kind = "record_id string, strict_key string, status string"
    rows = [("R:1", "a", None), ("R:2", "a", "x"), ("R:3", "b", None), ("R:4", "b", None)]
    got = {r.record_id: r.dedup_status for r in R.resolve_duplicates(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"R:1": "kept_conflict", "R:2": "kept_conflict", "R:3": "kept", "R:4": "merged_strict_exact"}


def test_positional_zip_pads_with_null(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"]), ([], ["x"])], "l array<string>, r array<string>")
    assert [[tuple(p) for p in r[0]] for r in df.select(R.positional_zip(F.col("l"), F.col("r"))).collect()] == [[("a", "x"), ("b", None)], []]


def test_variants_against_loops(spark):
    random.seed(3)
    members = [(f"c{i % 4}", i) for i in range(9)]
    codes, rows = ["LR", "RL", "BI", "UN", "??"], []
    for _ in range(150):
        rows.append((random.randrange(9), random.choice(codes), f"db{random.randrange(2)}", f"id{random.randrange(12)}"))
    ev = E.direction_evidence(spark.createDataFrame(rows, "m int, c string, d string, i string"), "m", "c", "i", database="d")
    got = {(r.canonical_id, r.direction): r for r in E.direction_variants(spark.createDataFrame(members, "canonical_id string, m int"), ev, "m").collect()}
    names = {"LR": "left_to_right", "RL": "right_to_left", "BI": "reversible", "UN": "undefined"}
    sets = defaultdict(set)
    for m, c, d, i in rows:
        if c in names:
            sets[f"c{m % 4}", names[c], d].add(i)
    assert len(got) == 12
    for (c, direction), r in got.items():
        assert r.evidence_count == sum(len(v) for k, v in sets.items() if k[:2] == (c, direction))
        assert r.undefined_count == sum(len(v) for k, v in sets.items() if k[:2] == (c, "undefined"))
        assert r.swap_sides == (direction == "right_to_left") and r.has_evidence == (r.evidence_count > 0)


def test_multimaps(spark):
    rows = spark.createDataFrame([(1, "b", "2"), (1, "a", "9"), (1, "a", "1"), (1, "a", "1")], "k int, db string, v string")
    assert E.index_values(rows, "k", "v").first()["values"] == ["1", "2", "9"]
    assert E.index_xrefs(rows, "k", "db", "v").first().xrefs == {"a": ["1", "9"], "b": ["2"]}
