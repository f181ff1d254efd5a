"""Training and export from a corpus in the published layout; traces and audits of what the encoder reads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.operators.encoder import Config, encode_molecules, encode_records, new_weights, restore
from crucible.operators.quality import numbered_groups
from crucible.operators import training as TR
from crucible.operators import quality as Q
from crucible.plans import analyse as A
from crucible.plans import formats
from crucible.plans import model as M
from crucible.plans import prepare as P
from crucible.sources import readers
from test_plans import make

PART = "struct<compound_id:string,canonical_smiles:string,coefficient:double,side:string,compartment:string,role:string,cofactor_role:string>"
KIND = f"reaction_id string, participants array<{PART}>, ec_numbers array<string>, reaction_type string, supported_directions array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    structures = ["CCO", "CC=O", "O", "CC(=O)O", "c1ccccc1O", "C", "CCC", "N"]
    rows = []
    for i in range(24):
        left, right = structures[i % 8], structures[(3 * i + 1) % 8]
        parts = [("a", left, -1.0, "reactant", None, None, "nad" if i % 4 == 0 else None), ("b", right, 1.0 + i % 2, "product", None, None, None)]
        rows.append((f"R:{i:02}", parts, [f"1.{i % 3}"] if i % 5 else None, None, [["left_to_right"], ["right_to_left"], ["reversible"], []][i % 4]))
    return M.build_corpus(spark.createDataFrame(rows, KIND))


def test_corpus_indices(corpus):
    assert corpus.sizes == {"role": 1, "cofactor": 2, "compartment": 1, "label": 4, "reaction_type": 1} and corpus.molecules.count() == 8
    rows = {r.record_id: r for r in corpus.rows.collect()}
    assert rows["R:04"].label_index == [2] and rows["R:00"].label_index == [] and rows["R:04"].participants[0].cofactor_index == 1
    assert all([p.side for p in r.participants] == ["reactant", "product"] for r in rows.values())


def test_train_and_export(spark, corpus, tmp_path):
    config = Config(dim=16, steps=2, readout="attention_sum", dropout=0.0, cofactors=2)
    meta = M.train(spark, corpus, config, str(tmp_path), epochs=3, size=8, weights={"labels": 0.2}, fraction=0.1)
    assert (meta["train_count"], meta["validation_count"], meta["record_count"], meta["molecule_count"]) == (22, 2, 24, 8)
    history = [json.loads(x) for x in (tmp_path / "history.jsonl").read_text().splitlines()]
    assert [h["epoch"] for h in history] == [1, 2, 3] and meta["best_epoch"] == min(history, key=lambda h: h["validation"])["epoch"]
    assert meta["best_validation_loss"] == min(h["validation"] for h in history) and json.loads((tmp_path / "metadata.json").read_text()) == meta
    kept, weights, more = restore(str(tmp_path / "checkpoint.npz"))
    assert kept.cofactors == 2 and kept.labels == 3 and more["vocabularies"]["label"] == {"1.0": 1, "1.1": 2, "1.2": 3} and len(more["split"]) == 24
    report = M.export(spark, corpus, str(tmp_path / "checkpoint.npz"), str(tmp_path / "out"))
    assert report["shape"] == [24, 16] and report["invariance"]["passed"]
    matrix = np.load(tmp_path / "out" / "matrix" / "vectors.npy")
    assert matrix.shape == (24, 16) and (tmp_path / "out" / "manifest.json").exists()
    direct = encode_records(A.model_rows(corpus.rows), kept, weights).orderBy("record_id").collect()
    assert np.allclose(matrix, [r.embedding for r in direct], atol=1e-6)
    corpus.sizes["label"] += 1
    with pytest.raises(ValueError):
        M.export(spark, corpus, str(tmp_path / "checkpoint.npz"), str(tmp_path / "out"))
    corpus.sizes["label"] -= 1


def test_large_corpora_train_on_all_partitions(spark, corpus, tmp_path):
    meta = M.train(spark, corpus, Config(dim=8, steps=1, readout="sum", dropout=0.0), str(tmp_path), epochs=2, size=4, fraction=0.0, most_local=3)
    history = [json.loads(x) for x in (tmp_path / "history.jsonl").read_text().splitlines()]
    assert meta["train_count"] == 24 and meta["best_epoch"] == 2 and all(np.isfinite(h["train"]) for h in history)


def test_all_sizes_train_alike(spark, corpus, tmp_path):
    """On partitions too: each epoch takes every record once, has a loss on those held out, the best is kept, and split and vocabularies are whole."""
    meta = M.train(spark, corpus, Config(dim=8, steps=1, readout="sum", dropout=0.0), str(tmp_path), epochs=3, size=4, fraction=0.2, most_local=3)
    history = [json.loads(x) for x in (tmp_path / "history.jsonl").read_text().splitlines()]
    assert meta["best_epoch"] == min(history, key=lambda h: h["validation"])["epoch"] and meta["best_validation_loss"] == min(h["validation"] for h in history)
    split = spark.read.parquet(str(tmp_path / "split"))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": meta["train_count"], "validation": meta["validation_count"]}
    assert {r.label: r["index"] for r in spark.read.parquet(str(tmp_path / "vocabularies" / "label")).collect()} == {"1.0": 1, "1.1": 2, "1.2": 3}
    config, weights, more = restore(str(tmp_path / "checkpoint.npz"))
    held = A.model_rows(corpus.rows).join(split.filter("split = 'validation'"), "record_id")
    model = TR.Encoder(config, weights)
    assert more["split"] is None and abs(TR.held_loss(held, model, {**TR.WEIGHTS}, 0.1, 4) - meta["best_validation_loss"]) < 1e-5
    examples = [TR.example_of(r) for r in held.orderBy("record_id").collect()]
    assert abs(TR.epoch(model, examples, {**TR.WEIGHTS}, 0.1, None, 4, np.random.default_rng(0)) - meta["best_validation_loss"]) < 1e-5


def test_dealt_records_are_each_taken_once(spark, corpus):
    table, steps, parts = TR.dealt(A.model_rows(corpus.rows).repartition(3), 4, 1)
    sizes = {(r["_step"], r["_part"]): r["count"] for r in table.groupBy("_step", "_part").count().collect()}
    assert (steps, parts) == (2, 3) and len(sizes) == 6 and set(sizes.values()) == {4} and table.select("record_id").distinct().count() == 24


def test_labels_beyond_the_classes_are_refused(corpus):
    config, weights = M.untrained(corpus, 8, steps=1)
    few = TR.Encoder(config.__class__(**{**config.__dict__, "labels": 1}))
    examples = [TR.example_of(r) for r in A.model_rows(corpus.rows).orderBy("record_id").limit(8).collect()]
    with pytest.raises(ValueError, match="numbered from 1 to 1"):
        TR.label_loss(few, TR.T(np.zeros((8, 8))), TR.collate(examples))


def test_molecules_are_kept_between_batches(corpus):
    config, weights = M.untrained(corpus, 16, steps=2)
    rows = A.model_rows(corpus.rows)
    one, many = (encode_records(rows.coalesce(1), config, weights, size).orderBy("record_id").collect() for size in (1, 24))
    assert np.allclose([r.embedding for r in one], [r.embedding for r in many], atol=1e-5)


def test_audit_reaches_the_encoder(corpus, monkeypatch):
    config, weights = M.untrained(corpus, 16, steps=2)
    rows = corpus.rows.withColumnRenamed("labels", "labels")
    a = A.audit(rows, config, weights).first()
    assert a.record_count == 24 and a.label_max_difference == 0 and a.metadata_max_difference == 0 and a.direction_changed == 24 and a.passed
    # An encoder that reads a label is found out: here labels stand where cofactors do.
    swapped = rows.withColumn("participants", F.transform("participants", lambda p: p.withField("cofactor_index", F.coalesce(F.get("label_index", F.lit(0)) % 2, F.lit(0)))))
    base, other = (encode_records(A.model_rows(x), config, weights).orderBy("record_id").collect() for x in (rows, swapped))
    assert any(not np.allclose(x.embedding, y.embedding) for x, y in zip(base, other, strict=True))


def test_collision_trace(spark):
    kind = "record_id string, participants array<struct<side:string,coefficient:double,canonical:string>>, supported_directions array<string>, labels array<string>"
    of = lambda a, b: [("reactant", -1.0, a), ("product", 1.0, b)]
    rows = spark.createDataFrame([("1", of("A", "B"), [], []), ("2", of("C", "B"), [], []), ("3", of("B", "A"), [], []), ("4", of("D", "D"), [], []), ("5", of("A", "B"), [], []), ("6", [*of("A", "B"), ("product", 1.0, None)], [], []), ("7", of("A", "B"), [], []), ("8", [*of("A", "B"), ("product", 1.0, None)], [], []), ("9", [*of("A", "B"), ("product", 1.0, "*")], [], [])], kind)
    molecules = spark.createDataFrame([("A", [1.0]), ("B", [2.0]), ("C", [1.0]), ("D", [3.0]), ("E", [1.0])], "canonical string, vector array<float>")
    vectors = spark.createDataFrame([("1", [1.0]), ("2", [1.0]), ("3", [2.0]), ("4", [2.0]), ("5", [4.0]), ("6", [5.0]), ("7", [5.0]), ("8", [6.0]), ("9", [6.0])], "record_id string, embedding array<float>")
    members, summary = A.collision_trace(molecules, rows, vectors)
    s = summary.first()
    assert (s.molecule_count, s.distinct_count, s.excess, s.group_count, s.molecules_in_groups) == (5, 3, 2, 1, 3)
    assert (s.record_group_count, s.groups_with_equal_inputs, s.groups_with_equal_molecules) == (4, 2, 1)  # 6 and 7 differ in a molecule without structure, 8 and 9 are read alike
    assert sorted((r.group_id, r.smiles) for r in members.collect()) == [(1, "A"), (1, "C"), (1, "E")]


def test_groups_are_numbered_by_size_then_first(spark):
    df = spark.createDataFrame([("a", 2, "z"), ("b", 5, "y"), ("c", 2, "b")], "key string, group_size int, first_id string")
    assert [(r.key, r.group_id) for r in numbered_groups(df).orderBy("group_id").collect()] == [("b", 1), ("c", 2), ("a", 3)]


def test_groups_without_a_direction(spark):
    df = spark.createDataFrame([("g", "reversible"), ("g", "undefined"), ("h", "undefined")], "group string, direction string")
    assert [r.group for r in A.without_direction(df, "group").collect()] == ["h"]


def test_published_layout(spark, tmp_path):
    corpus = P.prepare(spark, make(tmp_path))
    published = corpus.published()
    reactions, sources, variants = (published[k] for k in ("reactions", "source_reactions", "direction_variants"))
    assert (len(reactions.columns), len(sources.columns), len(variants.columns)) == (27, 9, 11)
    assert len(reactions.schema["participants"].dataType.elementType.fields) == 15
    r = {x.reaction_id: x for x in reactions.collect()}["RHEA:3"]
    assert r.equivalence_group_id == "RHEA_EQ:3" and r.direction_variant_ids.reversible == "RHEA:6" and r.source_reaction_smiles == "OCC>>CC=O"
    assert r.source_ids.rhea == sorted(f"RHEA:{n}" for n in (3, 4, 5, 6, 20, 21, 22, 23)) and r.source_ids.bigg == []
    assert [p.source_reaction_id for p in r.provenance] == ["RHEA:3", "RHEA:20"] and r.provenance[0].source_release == "141"
    assert json.loads(r.direction_evidence_summary_json) == {"left_to_right": {"UniProtKB_Swiss-Prot": 1, "db": 1}, "right_to_left": {"db": 1}}
    assert not r.missing_masks.ec_numbers and not r.missing_masks.direction and r.missing_masks.flux and json.loads(r.external_xrefs_json) == {"db": ["x1", "x2"]}
    s = {x.source_reaction_id: x for x in sources.collect()}
    assert s["RHEA:20"].ec_numbers == ["1.1.1.1"] and s["RHEA:60"].deduplication_status == "excluded_missing_rxn" and not s["RHEA:60"].embedding_included
    c = formats.coverage(reactions).first().asDict()
    assert len(c) == 12 and c["direction_evidence_available"] == 0.5 and c["participant_canonical_smiles"] == 1.0 and c["atom_map"] == 0.0
    assert formats.report_counts(reactions).first().imbalanced_reaction_count == 2
    rules = {x.rule: x.violations for x in formats.rules(reactions, sources, variants, corpus.id_map).collect()}
    assert len(rules) == 12 and not any(rules.values())
    report = P.quality_report(corpus)
    assert report["dedup"]["xref_conflict_group_count"] == 1 and report["source_record_count"] == 5
    assert M.build_corpus(reactions).sizes["label"] == 2


def test_report_rules(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"r{i}", rng.normal(size=24).tolist(), [f"1.{i % 3}.1"]) for i in range(60)], "record_id string, embedding array<double>, labels array<string>")
    near = A.S.exact_neighbours(df, 10, "record_id", "embedding")
    report = A.quality_report(df, df, n_pairs=200) | {"shape": [60, 24]}
    assert formats.report_rules(report, near, 60, 24) == []
    assert len(formats.report_rules(report | {"shape": [61, 24]}, near.filter("rank <> 3"), 60, 24)) > 2
    plots = A.plot_tables(df, near, A.S.retrieval_metrics(near, df, "record_id", "labels"), n_pairs=200, bins=20)
    assert {k: v.count() > 0 for k, v in plots.items()} == {"spectrum": True, "cosines": True, "precision": True}


def test_fetched_only_where_absent(spark, tmp_path):
    (tmp_path / "there").write_bytes(b"first")
    at = f"file://{tmp_path}/sub/here"
    assert readers.fetched(spark, f"file://{tmp_path}/there", at) and (tmp_path / "sub" / "here").read_bytes() == b"first"
    (tmp_path / "there").write_bytes(b"second")
    assert not readers.fetched(spark, f"file://{tmp_path}/there", at) and (tmp_path / "sub" / "here").read_bytes() == b"first"


def test_diagnostic_tables(spark, corpus, tmp_path):
    config, weights = M.untrained(corpus, 16, steps=2)
    vectors = encode_records(A.model_rows(corpus.rows), config, weights).cache()
    near = A.S.exact_neighbours(vectors, 3, "record_id", "embedding")
    shared = spark.createDataFrame([("CCO", 2)], "canonical string, identity_count int")
    tables = A.diagnostic_tables(vectors, corpus.rows, shared, near)
    A.write_tables(tables, str(tmp_path))
    back = {n: spark.read.option("header", True).csv(str(tmp_path / n)) for n in tables}
    assert back["nearest_neighbors"].count() == 72 and back["duplicate_embedding_groups"].columns[-1] == "group_id"
    assert back["duplicate_embedding_members"].count() == sum(int(r.group_size) for r in back["duplicate_embedding_groups"].collect())


def test_write_tables(spark, tmp_path):
    A.write_tables({"neighbours": spark.createDataFrame([("a", 1, 0.123456789)], "query string, rank int, cosine double")}, str(tmp_path))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "neighbours")).collect()] == [("a", "1", "0.12345679")]


def test_molecules_once(spark):
    config = Config(dim=8, steps=1, readout="sum", dropout=0.0)
    got = encode_molecules(spark.createDataFrame([("C",), ("C",), ("O",)], "s string"), "s", config, new_weights(config)).collect()
    assert sorted(r.s for r in got) == ["C", "O"]


PARTS = "array<struct<side:string,coefficient:double,canonical:string,cofactor_index:int>>"


def repeated(spark, n=6):
    """Three inputs, each n times, with one label."""
    of = [([("reactant", -1.0, "CCO", 0), ("product", 1.0, "O", 1)], "left_to_right"), ([("reactant", -2.0, "CC=O", 0), ("product", 1.0, None, 0)], "reversible"), ([("reactant", -1.0, "", 0), ("product", 2.0, "CCO", 0)], "right_to_left")]
    return spark.createDataFrame([(f"r{i:02d}", *of[i % 3], ["x"], [1]) for i in range(3 * n)], f"record_id string, participants {PARTS}, direction string, labels array<string>, label_index array<int>")


def test_columns_make_the_same_batch_as_rows(spark):
    import pyarrow as pa

    from crucible.operators.encoder import collate, collate_rows, example_of

    rows = repeated(spark).collect()
    whole = pa.RecordBatch.from_pylist([{**r.asDict(), "participants": [p.asDict() for p in r.participants]} for r in rows])
    a, b = collate([example_of(r) for r in rows[4:11]], graphs=False), collate_rows(whole.slice(4, 7), labels="label_index")
    assert a.names == b.names and a.labels == b.labels and a.n_molecules == b.n_molecules
    for n in ("molecule", "coefficient", "side", "cofactor", "record", "begin", "direction"):
        assert np.array_equal(getattr(a, n), getattr(b, n)) and getattr(a, n).dtype == getattr(b, n).dtype, n


def test_collision_trace_counts_equal_inputs_and_joins_no_records_by_broadcast(spark):
    rows = repeated(spark)
    inputs = A.distinct_inputs(A.model_rows(rows), "participants", "direction")
    assert inputs.count() == 3 and {r.n_records for r in inputs.collect()} == {6}
    molecules = spark.createDataFrame([("CCO", [1.0]), ("O", [2.0])], "canonical string, vector array<float>")
    at = lambda df: df.select("record_id", F.array(F.size("participants").cast("float")).alias("embedding"))
    (_, one), (_, all_of) = A.collision_trace(molecules, inputs, at(inputs), "n_records"), A.collision_trace(molecules, rows, at(rows))
    assert one.first() == all_of.first() and one.first().record_group_count == 1
    alone = inputs.limit(1)
    assert A.collision_trace(molecules, alone, at(alone), "n_records")[1].first().record_group_count == 1  # six records stand behind it
    # Before, records met their vectors by broadcast where their file was small.
    hinted = []
    real = A.settled
    A.settled = lambda df, name: hinted.append(df._jdf.queryExecution().executedPlan().toString()) if name == "signed" else None or real(df, name)
    try:
        with pytest.raises(AttributeError):
            A.collision_trace(molecules, rows, at(rows))
    finally:
        A.settled = real
    assert "SortMergeJoin [record_id" in hinted[0] and "BroadcastHashJoin [record_id" not in hinted[0]


def test_equal_inputs_are_traced_once(spark):
    from crucible.operators.encoder import trace_records

    config = Config(dim=16, steps=2, readout="attention_sum", dropout=0.0, cofactors=2)
    inputs = A.distinct_inputs(A.model_rows(repeated(spark, 50)), "participants", "direction")
    traced = trace_records(inputs, config, new_weights(config), carry=("record_id", "n_records"))
    got = Q.stage_uniqueness(traced, "record_id", ["fusion_input", "linear1"], "n_records").collect()
    # Positions in a batch change the last bits of a vector, so equal inputs once had several.
    assert len(got) == 3 and all((r.group_size, r.fusion_input_unique, r.linear1_unique, r.first_collapsed) == (50, 1, 1, "fusion_input") for r in got)


def test_audit_and_diagnosis_count_equal_inputs(spark, monkeypatch):
    config = Config(dim=16, steps=2, readout="attention_sum", dropout=0.0, cofactors=2)
    staged = []
    monkeypatch.setattr(A, "settled", lambda df, name: staged.append((name, df.count())) or df.cache())
    a = A.audit(repeated(spark, 7), config, new_weights(config)).first()
    assert (a.record_count, a.direction_changed, a.label_max_difference, a.metadata_max_difference, a.passed) == (21, 21, 0, 0, True)
    assert staged == [("audit", 3)]  # 21 before
    rows = repeated(spark, 7)
    vectors = lambda df: df.select("record_id", F.array(F.size("participants").cast("float")).alias("embedding"))
    shared = spark.createDataFrame([("CCO", 2)], "canonical string, identity_count long")
    inputs = A.distinct_inputs(A.model_rows(rows), "participants", "direction", "labels")
    one, all_of = A.diagnose(vectors(inputs), inputs, shared, "n_records")[2], A.diagnose(vectors(rows), rows, shared)[2]
    assert one.first() == all_of.first() and one.first().rows_in_groups == 21
    assert Q.exact_quantiles(spark.createDataFrame([(1.0, 3), (5.0, 1)], "d double, n long"), "d", (0.5, 1.0), "n") == {0.5: 1.0, 1.0: 5.0}


def test_equal_inputs_of_a_batch_have_equal_vectors(spark):
    config = Config(dim=16, steps=2, readout="attention_sum", dropout=0.0, cofactors=2)
    rows = repeated(spark, 100).coalesce(1)
    got = encode_records(rows, config, new_weights(config)).collect()
    assert len(got) == 300 and len({tuple(r.embedding) for r in got}) == 3
    # Each input is encoded once; before, all 300 were.
    from crucible.operators.encoder import chosen, collate, distinct_records, example_of

    examples = [example_of(r) for r in rows.collect()]
    batch = collate(examples, graphs=False)
    first, of = distinct_records(batch)
    assert first.tolist() == [0, 1, 2] and of.tolist() == [0, 1, 2] * 100
    some, want = chosen(batch, np.array([1, 5, 3])), collate([examples[i] for i in (1, 5, 3)], graphs=False)
    assert [batch.names[i] for i in some.molecule] == [want.names[i] for i in want.molecule] and np.array_equal(some.coefficient, want.coefficient)
    assert np.array_equal(some.record, want.record) and np.array_equal(some.begin, want.begin) and np.array_equal(some.direction, want.direction)


def test_group_facts_shuffle_numbers_and_make_texts_after(spark):
    rows = spark.createDataFrame([("R:20", "R:3", 20, 21, 22, 23), ("R:3", "R:3", 3, 4, 5, 6), ("R:7", "R:7", 7, 7, 8, 9)], "record_id string, canonical_id string, master long, left_to_right long, right_to_left long, reversible long")
    facts = formats.group_facts(rows, "141", "R")
    got = {r.canonical_id: r for r in facts.collect()}
    assert got["R:3"].source_id_list == sorted(f"R:{n}" for n in (3, 4, 5, 6, 20, 21, 22, 23)) and got["R:7"].source_id_list == ["R:7", "R:8", "R:9"]
    assert [p.source_reaction_id for p in got["R:3"].provenance] == ["R:3", "R:20"] and {p.source_release for p in got["R:3"].provenance} == {"141"}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "concat" not in below and "141" not in below  # before, four texts and a constant struct for each member


def test_participants_and_records_share_a_shuffle(spark):
    """One shuffle of lines by record; before, one by participant and one by record."""
    from crucible import queries

    plan = queries.coefficients(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
