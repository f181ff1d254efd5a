import random
from dataclasses import replace

import numpy as np
import pytest

from crucible.operators import chemistry as C
from crucible.operators import training as TR
from crucible.operators.encoder import Config, Encoder, Example, collate, encode_records, new_weights, restore, save
from crucible.plans.analyse import ablation, decision, invariance

CONFIG = Config(dim=32, steps=2, readout="attention_sum", dropout=0.0, cofactors=2, labels=3)


def example(direction=2, i=0):
    return Example(f"r{i}", ["CCO", "O", "CC=O"], [-1.0, -1.0, 1.0], [0, 0, 1], [0, 1, 0], direction, [1 + i % 3])


def vector(examples, config=CONFIG, **masks):
    m = Encoder(config)
    b = collate(examples)
    return m.encode(m.molecules(b), b, **masks)[0].v


def test_graph_shapes_and_reverse_edges():
    g = C.graph_of("CC(=O)O")
    assert g.atoms.shape == (4, C.ATOM_DIM) and g.edge_features.shape == (6, C.BOND_DIM)
    assert (g.edges[g.reverse] == g.edges[:, ::-1]).all()
    assert C.graph_of("O").edges.shape == (0, 2)
    with pytest.raises(C.ParseError):
        C.graph_of("")
    with pytest.raises(ValueError):
        C.union([])


def shuffled(m, rng):
    """The molecule written with its atoms in another order."""
    order = list(range(len(m.atoms)))
    rng.shuffle(order)
    at = {a: i for i, a in enumerate(order)}
    atoms = [replace(m.atoms[a], order=tuple(at.get(x, -1) for x in m.atoms[a].order)) for a in order]
    return C.Molecule(atoms, [(at[a], at[b], o) for a, b, o in m.bonds], m.name, {(at[a], at[b]): (at[x], at[y], s) for (a, b), (x, y, s) in m.sides.items()})


@pytest.mark.parametrize("text", ["CCO", "c1ccccc1C(=O)[O-]", "C1CC2CCC1CC2", "*C(=O)[O-]", "[NH3+]CC(=O)[O-].O", "CC(C)(C)c1ccc(O)cc1", "N#CC=C", "[13CH4]", "OP(=O)(O)OC1CCCO1"])
def test_canonical_text_is_one_for_a_molecule(text):
    rng, want = random.Random(1), C.canonical_text(C.parse_smiles(text))
    assert C.canonical_text(C.parse_smiles(want)) == want
    for _ in range(10):
        assert C.canonical_text(shuffled(C.parse_smiles(text), rng)) == want
    assert C.composition(C.parse_smiles(want)) == C.composition(C.parse_smiles(text))


def test_different_molecules_differ():
    texts = ["CCC", "CCCCCCC", "*C(=O)[O-]", "[1*]C(=O)[O-]", "CCO", "COC", "C=CO", "CC=O"]
    assert len({C.canonical_text(C.parse_smiles(t)) for t in texts}) == len(texts)
    m = Encoder(CONFIG)
    v = m.molecules(collate([Example("", texts, [1.0] * 8, [0] * 8, [0] * 8, 3)])).v
    assert len({tuple(np.round(x, 9)) for x in v}) == len(texts)


@pytest.mark.parametrize("bad", ["C(", "C)", "C1CC", "[Xx]", "C$", "[C", "1CC"])
def test_bad_smiles(bad):
    with pytest.raises(C.ParseError):
        C.parse_smiles(bad)


def test_fallbacks():
    read = C.parse_smiles
    ok = C.canonicalise(lambda: read("OCC"), "ignored")
    assert (ok.status, ok.canonical, ok.error) == ("sanitized", "CCO", None)
    source = C.canonicalise(lambda: read("C(C)(C)(C)(C)C"), "OCC")
    assert source.status == "sanitized" and source.error.startswith("rxn_fallback") and source.canonical == "CCO"
    loose = C.canonicalise(lambda: read("?"), "C(C)(C)(C)(C)C")
    assert loose.status == "unsanitized" and loose.atoms is None and loose.canonical
    assert C.canonicalise(lambda: read("?"), None).status == "failed"


def test_participant_order_and_reversible_swap():
    m, b = Encoder(CONFIG), collate([example(d, d) for d in range(4)])
    mol = m.molecules(b)
    assert np.allclose(m.encode(mol, b)[0].v, m.encode(mol, b.permuted())[0].v, atol=1e-10)
    one = collate([example(2)])
    assert np.allclose(m.encode(m.molecules(one), one)[0].v, m.encode(m.molecules(one), one.swapped())[0].v, atol=1e-10)


def test_right_to_left_is_the_swapped_record():
    turned = Example("x", ["CCO", "O", "CC=O"], [1.0, 1.0, -1.0], [1, 1, 0], [0, 1, 0], 1)
    plain = vector([example(1)])
    m, b = Encoder(CONFIG), collate([turned])
    e, _ = m._once(m.molecules(b), b)
    assert np.allclose(plain, e.v)
    assert not np.allclose(vector([example(0)]), vector([example(1)]))


def test_labels_are_no_input():
    assert np.array_equal(vector([example(2, 0)]), vector([replace(example(2, 0), labels=[])]))
    with pytest.raises(ValueError):
        Config(use_ec=True)
    with pytest.raises(ValueError):
        Config(readout="mean")


def test_missing_metadata_and_masks_are_finite():
    assert np.isfinite(vector([example()], mask_metadata=True)).all()
    assert not np.allclose(vector([example(0)]), vector([example(0)], mask_direction=True))
    assert np.isfinite(vector([example()], participant_mask=np.array([True, False, False]), stoich_mask=np.array([False, True, False]))).all()


def test_regularisers():
    from crucible.operators.autograd import T

    flat, spread = [T(np.zeros((8, 32)))] * 2, [T(np.random.default_rng(0).normal(size=(8, 32)))] * 2
    assert float(TR.variance_loss(flat).v) > float(TR.variance_loss(spread).v)
    assert float(TR.covariance_loss(flat).v) == 0.0 and np.isfinite(TR.covariance_loss(spread).v)


@pytest.mark.parametrize("readout", ["sum", "attention", "attention_sum"])
def test_gradients_equal_differences(readout):
    config = Config(dim=8, molecule_dim=6, steps=2, readout=readout, dropout=0.0, cofactors=2, labels=3)
    m, ex = Encoder(config, trainable=True), [example(d, d) for d in range(4)]
    weights = {"contrastive": 1.0, "variance": 1.0, "covariance": 0.1, "labels": 0.5}
    grads, _ = TR.gradients(m, ex, weights, 0.1)
    b, rng = collate(ex), np.random.default_rng(0)
    for k, x in m.w.items():
        i = tuple(rng.integers(0, n) for n in x.v.shape)
        old, f = x.v[i], lambda: float(TR.total(TR.losses(m, b), weights).v)
        x.v[i] = old + 1e-6
        hi = f()
        x.v[i] = old - 1e-6
        lo = f()
        x.v[i] = old
        assert abs((hi - lo) / 2e-6 - (grads[k][i] if k in grads else 0.0)) < 1e-4 * (1 + abs(hi - lo) / 2e-6)


def test_training_lowers_the_loss_and_is_repeatable():
    config = replace(CONFIG, dropout=0.1)
    ex = [replace(example(i % 4, i), molecules=[["CCO", "O", "CC=O"], ["CCC", "O", "CCO"], ["CC", "[NH4+]", "CCN"]][i % 3]) for i in range(12)]
    w, history = TR.fit(ex[:9], ex[9:], config, epochs=4, size=6)
    assert history[-1]["train"] < history[0]["train"] and set(w) == set(new_weights(config))
    again, h2 = TR.fit(ex[:9], ex[9:], config, epochs=4, size=6)
    assert all(np.array_equal(w[k], again[k]) for k in w) and [x["train"] for x in history] == [x["train"] for x in h2]


def test_checkpoint_round_trip(tmp_path):
    w = new_weights(CONFIG)
    save(str(tmp_path / "m.npz"), CONFIG, w, vocabularies={"label": ["a"]}, split=[1, 2])
    config, back, meta = restore(str(tmp_path / "m.npz"))
    assert config == CONFIG and meta["split"] == [1, 2] and all(np.array_equal(w[k], back[k]) for k in w)


def rows(spark, n):
    kind = "record_id string, participants array<struct<canonical:string,coefficient:double,side:string>>, direction string"
    side = lambda s: "product" if s else "reactant"
    names = ["left_to_right", "right_to_left", "reversible", "undefined"]
    return spark.createDataFrame([(f"r{i}", [(m, c, side(s)) for m, c, s in zip(example().molecules, example().coefficients, example().sides, strict=True)], names[i % 4]) for i in range(n)], kind)


def test_spark_encoding_equals_single(spark):
    got = {r.record_id: np.array(r.embedding) for r in encode_records(rows(spark, 9).repartition(3), CONFIG, new_weights(CONFIG), size=2).collect()}
    want = vector([replace(example(i % 4, i), cofactors=[0, 0, 0]) for i in range(9)])
    assert all(np.allclose(got[f"r{i}"], want[i], atol=1e-5) for i in range(9))


def test_distributed_training_runs(spark):
    w, history = TR.fit_distributed(rows(spark, 24).repartition(2), replace(CONFIG, dim=8), steps=8, size=6)
    assert history[-1] < history[0] and all(np.isfinite(x).all() for x in w.values())


def test_invariance_report_and_ablation():
    assert invariance([replace(example(d, d), molecules=["OCC", "O", "CC=O"]) for d in range(4)], CONFIG, new_weights(CONFIG))["passed"]
    ablation({"a": 1, "w": 0}, {"a": 1, "w": 2}, "w")
    with pytest.raises(ValueError):
        ablation({"a": 1, "w": 0}, {"a": 2, "w": 2}, "w")
    assert (decision(0.1, 0.2), decision(-0.2, -0.1), decision(-0.1, 0.1)) == ("second_better", "second_worse", "no_clear_difference")
