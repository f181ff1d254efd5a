"""The record encoder: directed message passing over molecules, pooling over each side's participants, fusion with the direction.

One forward function serves training (with gradients) and export; on a cluster
each Arrow batch of records is encoded with the broadcast weights. A worker keeps
the vectors of a bounded number of molecules, so most are encoded once a worker.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from crucible.functions.columns import DIRECTIONS
from crucible.operators import chemistry
from crucible.operators.autograd import T, concat, layer_norm, relu, segment_softmax, segment_sum, unit, where

MASKED = 4
#: Molecules whose vectors a worker keeps between batches.
KEPT_MOLECULES = 50_000


@dataclass(frozen=True)
class Config:
    dim: int = 256
    molecule_dim: int | None = None
    steps: int = 4
    readout: str = "attention"
    dropout: float = 0.1
    use_cofactor: bool = True
    #: Labels are never an input: a true value is an error.
    use_ec: bool = False
    cofactors: int = 1
    labels: int = 1
    seed: int = 42

    def __post_init__(self):
        if self.use_ec:
            raise ValueError("labels are not an input of the encoder; they have an auxiliary head")
        if self.readout not in ("sum", "attention", "attention_sum"):
            raise ValueError(f"unknown readout {self.readout!r}")

    @property
    def inner(self) -> int:
        return self.molecule_dim or self.dim


@dataclass
class Example:
    record_id: str
    molecules: list[str]
    coefficients: list[float]
    sides: list[int]
    cofactors: list[int]
    direction: int
    labels: list[int] = field(default_factory=list)


@dataclass
class Batch:
    """Participants of all records in a row, with the record and molecule of each."""

    graphs: chemistry.Graph | None
    atom_of: np.ndarray
    n_molecules: int
    molecule: np.ndarray
    coefficient: np.ndarray
    side: np.ndarray
    cofactor: np.ndarray
    record: np.ndarray
    begin: np.ndarray
    direction: np.ndarray
    labels: list[list[int]]
    names: list[str] = field(default_factory=list)
    """The distinct molecules, by number."""

    def __len__(self) -> int:
        return len(self.direction)

    def swapped(self) -> Batch:
        """Sides exchanged."""
        return replace(self, side=1 - self.side, coefficient=-self.coefficient)

    def permuted(self) -> Batch:
        """Each record's participants in reverse."""
        order = np.concatenate([np.arange(b - 1, a - 1, -1) for a, b in zip(self.begin, self.begin[1:], strict=False)]) if len(self) else np.zeros(0, dtype=np.int64)
        return replace(self, molecule=self.molecule[order], coefficient=self.coefficient[order], side=self.side[order], cofactor=self.cofactor[order], record=self.record[order])


def collate(examples: list[Example], graphs: bool = True) -> Batch:
    """Each molecule once, by first occurrence; without graphs the molecules' vectors come from elsewhere."""
    place: dict[str, int] = {}
    for e in examples:
        for m in e.molecules:
            place.setdefault(m, len(place))
    whole, atom_of = chemistry.union([chemistry.graph_of(m) for m in place]) if graphs else (None, np.zeros(0, dtype=np.int64))
    flat = lambda f, kind: np.array([x for e in examples for x in f(e)], dtype=kind)
    sizes = [len(e.molecules) for e in examples]
    return Batch(
        whole, atom_of, len(place), flat(lambda e: [place[m] for m in e.molecules], np.int64), flat(lambda e: e.coefficients, np.float64), flat(lambda e: e.sides, np.int64),
        flat(lambda e: e.cofactors, np.int64), np.repeat(np.arange(len(examples)), sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([e.direction for e in examples], dtype=np.int64), [e.labels for e in examples], [*place],
    )


def new_weights(c: Config) -> dict[str, np.ndarray]:
    rng, d, m = np.random.default_rng(c.seed), c.dim, c.inner
    w: dict[str, np.ndarray] = {}

    def linear(name: str, i: int, o: int, bias: bool = True) -> None:
        r = 1 / np.sqrt(i)
        w[name + ".w"] = rng.uniform(-r, r, (i, o))
        if bias:
            w[name + ".b"] = rng.uniform(-r, r, o)

    def norm(name: str, n: int) -> None:
        w[name + ".gain"], w[name + ".shift"] = np.ones(n), np.zeros(n)

    linear("edge", chemistry.ATOM_DIM + chemistry.BOND_DIM, m)
    linear("message", m, m)
    linear("atom", chemistry.ATOM_DIM + m, m)
    linear("atom_score", m, 1)
    if c.readout == "attention_sum":
        linear("readout", 2 * m + 1, m)
        norm("readout_norm", m)
    if m != d:
        linear("molecule", m, d)
    w["side"] = rng.normal(size=(2, 16))
    linear("stoich1", 2, 32)
    linear("stoich2", 32, 32)
    w["cofactor"] = rng.normal(size=(max(1, c.cofactors), 8))
    linear("participant", d + 16 + 32 + 8 + 1, d)
    norm("participant_norm", d)
    linear("participant_score", d, 1)
    linear("pool", 2 * d + 2, d)
    norm("pool_norm", d)
    linear("delta", d, d, bias=False)
    w["masked_molecule"] = np.zeros(d)
    w["direction"] = rng.normal(size=(5, 32))
    linear("fuse1", 4 * d + 33, 2 * d)
    linear("fuse2", 2 * d, d)
    norm("fuse_norm", d)
    linear("project1", d, d)
    linear("project2", d, d)
    linear("label1", d, d)
    linear("label2", d, max(1, c.labels))
    return w


class Encoder:
    def __init__(self, config: Config, weights: dict[str, np.ndarray] | None = None, trainable: bool = False):
        self.c = config
        self.w = {k: T(v, wants=trainable) for k, v in (weights or new_weights(config)).items()}
        self.rng: np.random.Generator | None = None  # with one, dropout is on
        self.captures: dict[str, np.ndarray] | None = None

    def weights(self) -> dict[str, np.ndarray]:
        return {k: x.v for k, x in self.w.items()}

    def _linear(self, name: str, x: T) -> T:
        out = x @ self.w[name + ".w"]
        return out + self.w[name + ".b"] if name + ".b" in self.w else out

    def _norm(self, name: str, x: T) -> T:
        return layer_norm(x, self.w[name + ".gain"], self.w[name + ".shift"])

    def _drop(self, x: T) -> T:
        if self.rng is None or not self.c.dropout:
            return x
        return x * T((self.rng.random(x.shape) >= self.c.dropout) / (1 - self.c.dropout))

    def _seen(self, name: str, x: T) -> T:
        if self.captures is not None:
            self.captures[name] = x.v
        return x

    def molecules(self, b: Batch) -> T:
        """A vector for each molecule."""
        g, atoms = b.graphs, T(b.graphs.atoms)
        n = len(g.atoms)
        if len(g.edges):
            source, target = g.edges[:, 0], g.edges[:, 1]
            first = relu(self._linear("edge", T(np.concatenate([g.atoms[source], g.edge_features], axis=1))))
            h = first
            for _ in range(self.c.steps - 1):
                into = segment_sum(h, target, n)
                h = self._drop(relu(first + self._linear("message", into[source] - h[g.reverse])))
            arrived = segment_sum(h, target, n)
        else:
            arrived = T(np.zeros((n, self.c.inner)))
        a = self._drop(relu(self._linear("atom", concat([atoms, arrived]))))
        total = segment_sum(a, b.atom_of, b.n_molecules)
        if self.c.readout == "sum":
            out = total
        else:
            share = segment_softmax(self._linear("atom_score", a).reshape(-1), b.atom_of, b.n_molecules)
            out = segment_sum(a * share.reshape(-1, 1), b.atom_of, b.n_molecules)
            if self.c.readout == "attention_sum":
                size = np.maximum(np.bincount(b.atom_of, minlength=b.n_molecules), 1)[:, None]
                out = self._norm("readout_norm", relu(self._linear("readout", concat([out, total / T(np.sqrt(size)), T(np.log1p(size))]))))
        return self._linear("molecule", out) if self.c.inner != self.c.dim else out

    def _once(self, molecules: T, b: Batch, participant_mask=None, stoich_mask=None, mask_direction=False, mask_metadata=False) -> tuple[T, T]:
        m = molecules[b.molecule]
        if participant_mask is not None:
            m = where(participant_mask[:, None], self.w["masked_molecule"].reshape(1, -1) + T(np.zeros(m.shape)), m)
        size, gone = np.log1p(np.abs(b.coefficient))[:, None], np.zeros((len(b.coefficient), 1))
        if stoich_mask is not None:
            size, gone = np.where(stoich_mask[:, None], 0.0, size), stoich_mask[:, None].astype(np.float64)
        stoich = self._linear("stoich2", relu(self._linear("stoich1", T(np.concatenate([size, gone], axis=1)))))
        cofactor = b.cofactor if self.c.use_cofactor and not mask_metadata else np.zeros_like(b.cofactor)
        x = concat([m, self.w["side"][b.side], stoich, self.w["cofactor"][cofactor], T((cofactor == 0)[:, None])])
        tokens = self._norm("participant_norm", self._drop(relu(self._linear("participant", x))))
        seg, n = b.record * 2 + b.side, len(b) * 2
        share = segment_softmax(self._linear("participant_score", tokens).reshape(-1), seg, n)
        count = np.maximum(np.bincount(seg, minlength=n), 1)[:, None]
        amount = np.bincount(seg, weights=np.abs(b.coefficient), minlength=n)[:, None]
        sides = concat([segment_sum(tokens * share.reshape(-1, 1), seg, n), segment_sum(tokens, seg, n) / T(np.sqrt(count)), T(np.log1p(count)), T(np.log1p(amount))])
        pooled = self._norm("pool_norm", self._drop(relu(self._linear("pool", sides))))
        left, right = pooled[np.arange(0, n, 2)], pooled[np.arange(1, n, 2)]
        delta = segment_sum(self._linear("delta", m) * T(b.coefficient[:, None]), b.record, len(b))
        direction = np.full_like(b.direction, MASKED) if mask_direction else b.direction
        gone = np.ones((len(b), 1)) if mask_direction else (b.direction == 3)[:, None]
        fused = self._seen("fusion_input", concat([left, right, right - left, delta, self.w["direction"][direction], T(gone)]))
        h = self._seen("relu", relu(self._seen("linear1", self._linear("fuse1", fused))))
        e = self._seen("layernorm", self._norm("fuse_norm", self._seen("linear2", self._linear("fuse2", self._drop(h)))))
        return e, unit(self._linear("project2", relu(self._linear("project1", e))))

    def encode(self, molecules: T, b: Batch, **masks) -> tuple[T, T]:
        """(vector, unit projection): right to left is encoded with sides exchanged, reversible as the mean of both, others as they stand."""
        e, p = self._once(molecules, b, **masks)
        turned, both = b.direction == 1, b.direction == 2
        if not (turned | both).any():
            return e, p
        kept = self.captures
        self.captures = None
        e2, p2 = self._once(molecules, b.swapped(), **masks)
        self.captures = kept
        e = where(turned[:, None], e2, where(both[:, None], (e + e2) * 0.5, e))
        p = where(turned[:, None], p2, where(both[:, None], unit((p + p2) * 0.5), p))
        return e, p

    def label_logits(self, e: T) -> T:
        return self._linear("label2", relu(self._linear("label1", e)))


def save(path: str, config: Config, weights: dict[str, np.ndarray], **more) -> None:
    """A checkpoint: configuration, weights and what else belongs to it (vocabularies, split, data hash) in one npz."""
    import json

    np.savez_compressed(path, **weights, __meta__=np.frombuffer(json.dumps({"config": asdict(config), **more}, sort_keys=True).encode(), dtype=np.uint8))


def restore(path: str) -> tuple[Config, dict[str, np.ndarray], dict]:
    import json

    with np.load(path, allow_pickle=False) as f:
        meta = json.loads(bytes(f["__meta__"]).decode())
        return Config(**meta.pop("config")), {k: f[k] for k in f.files if k != "__meta__"}, meta


def packed(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def example_of(row) -> Example:
    """From a row or dict (record_id, participants of canonical, coefficient, side and perhaps cofactor_index, direction, perhaps label_index)."""
    of = lambda x, k, other=None: x.get(k, other) if isinstance(x, dict) else getattr(x, k, other)
    parts, labels = list(of(row, "participants")), of(row, "label_index")
    get = lambda p, k, other: of(p, k) or other
    return Example(
        of(row, "record_id"), [get(p, "canonical", "*") for p in parts], [float(get(p, "coefficient", 0.0)) for p in parts], [int(get(p, "side", "") == "product") for p in parts],
        [int(get(p, "cofactor_index", 0)) for p in parts], DIRECTIONS.index(of(row, "direction")), [int(x) for x in labels] if labels is not None else [],
    )


class Molecules:
    """The vectors of molecules, of which `most` are kept from batch to batch."""

    def __init__(self, model: Encoder, most: int = KEPT_MOLECULES):
        self.model, self.most, self.kept = model, most, {}

    def __call__(self, names: list[str]) -> T:
        new = [n for n in names if n not in self.kept]
        if len(self.kept) + len(new) > self.most:
            self.kept, new = {}, names
        if new:
            batch = collate([Example("", new, [1.0] * len(new), [0] * len(new), [0] * len(new), 3)])
            self.kept.update(zip(new, self.model.molecules(batch).v, strict=True))
        return T(np.stack([self.kept[n] for n in names]))


def collate_rows(rows: pa.RecordBatch, participants: str = "participants", labels: str | None = None) -> Batch:
    """As collate() of each row's example, without graphs, from whole columns."""
    lists, direction = rows.column(participants), pc.index_in(rows.column("direction"), value_set=pa.array(DIRECTIONS))
    if lists.null_count or direction.null_count:
        raise ValueError("a record without participants or of an unknown direction")
    flat = lists.flatten()
    part = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    number = lambda n, kind: pc.fill_null(part[n], 0).to_numpy(zero_copy_only=False).astype(kind) if n in part else np.zeros(len(flat), dtype=kind)
    text = part["canonical"]
    molecule = pc.if_else(pc.fill_null(pc.equal(text, ""), True), "*", text).dictionary_encode()  # numbers by first occurrence
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    names = molecule.dictionary.to_pylist()
    return Batch(
        None, np.zeros(0, dtype=np.int64), len(names), molecule.indices.to_numpy(zero_copy_only=False).astype(np.int64), number("coefficient", np.float64),
        pc.fill_null(pc.equal(part["side"], "product"), False).to_numpy(zero_copy_only=False).astype(np.int64), number("cofactor_index", np.int64), np.repeat(np.arange(len(lists)), sizes),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), direction.to_numpy(zero_copy_only=False).astype(np.int64), rows.column(labels).to_pylist() if labels else [[]] * len(lists), names,
    )


def distinct_records(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the records whose inputs are new, for each record the place of its input among these); labels are part of an input."""
    whole = np.stack([b.molecule, b.coefficient.view(np.int64), b.side, b.cofactor], axis=1)
    ends, direction, place, first, of = b.begin.tolist(), b.direction.tolist(), {}, [], np.empty(len(b), dtype=np.int64)
    for i, labels in enumerate(b.labels):
        key = (whole[ends[i] : ends[i + 1]].tobytes(), direction[i], tuple(labels or ()))
        of[i] = place.setdefault(key, len(place))
        if of[i] == len(first):
            first.append(i)
    return np.array(first, dtype=np.int64), of


def chosen(b: Batch, records: np.ndarray) -> Batch:
    """Some records of a batch; molecules keep their numbers."""
    sizes = b.begin[records + 1] - b.begin[records]
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rows = np.arange(begin[-1]) + np.repeat(b.begin[records] - begin[:-1], sizes)
    return replace(
        b, molecule=b.molecule[rows], coefficient=b.coefficient[rows], side=b.side[rows], cofactor=b.cofactor[rows], record=np.repeat(np.arange(len(records)), sizes),
        begin=begin, direction=b.direction[records], labels=[b.labels[i] for i in records],
    )


def encode_variants(records: DataFrame, config: Config, weights: dict[str, np.ndarray], variants: dict[str, dict], carry: tuple[str, ...] = ("record_id",), size: int = 128) -> DataFrame:
    """The columns `carry` of each record (participants, direction) and a vector for each variant, all made of it in one task, so nothing is joined.

    Equal inputs of an Arrow batch are encoded once, in batches of `size`.
    A variant names what it reads: `participants` and `labels`, other columns in
    their place (none: the column participants, and no labels), and the masks of encode().
    """
    shared = records.sparkSession.sparkContext.broadcast((config, weights))

    def work(batches):
        model = Encoder(*shared.value)
        molecules = Molecules(model)
        for big in batches:
            if not big.num_rows:
                continue
            read, out = {}, []
            for v in variants.values():
                columns = (v.get("participants", "participants"), v.get("labels"))
                if columns not in read:
                    batch = collate_rows(big, *columns)
                    read[columns] = (batch, *distinct_records(batch))
                batch, first, of = read[columns]
                vectors = molecules(batch.names) if batch.names else T(np.zeros((0, model.c.dim)))
                e = np.concatenate([model.encode(vectors, chosen(batch, first[at : at + size]), **v.get("masks", {}))[0].v.astype(np.float32) for at in range(0, len(first), size)])
                out.append(pa.FixedSizeListArray.from_arrays(pa.array(e[of].reshape(-1)), e.shape[1]).cast(pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([*(big.column(c) for c in carry), *out], names=[*carry, *variants])

    need = dict.fromkeys([*carry, "direction", *(v.get("participants", "participants") for v in variants.values()), *(v["labels"] for v in variants.values() if v.get("labels"))])
    kinds = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in carry]
    return records.select(*need).mapInArrow(work, ", ".join([*kinds, *(f"`{n}` array<float>" for n in variants)]))


def encode_records(records: DataFrame, config: Config, weights: dict[str, np.ndarray], size: int = 128, carry: tuple[str, ...] = ("record_id",), **masks) -> DataFrame:
    """(record_id, embedding) for each record (record_id, participants, direction, perhaps label_index), in batches of `size`; `carry` names the columns that stay beside the vector."""
    return encode_variants(records, config, weights, {"embedding": {"labels": "label_index" if "label_index" in records.columns else None, "masks": masks}}, carry, size)


def trace_records(records: DataFrame, config: Config, weights: dict[str, np.ndarray], size: int = 128, carry: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(record_id, fusion_input, linear1, relu, linear2, layernorm, output): what each layer of the fusion gives; `carry` names the columns that stay beside them."""
    shared = records.sparkSession.sparkContext.broadcast((config, weights))
    stages = ["fusion_input", "linear1", "relu", "linear2", "layernorm"]

    def work(batches):
        model = Encoder(*shared.value)
        molecules = Molecules(model)
        for big in batches:
            for at in range(0, big.num_rows, size):
                part, model.captures = big.slice(at, size), {}
                batch = collate_rows(part)
                e, _ = model.encode(molecules(batch.names), batch)
                out = [pa.array(list(x), pa.list_(pa.float64())) for x in (*(model.captures[s] for s in stages), e.v)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *out], names=[*carry, *stages, "output"])

    kinds = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in carry]
    return records.select(*dict.fromkeys([*carry, "participants", "direction"])).mapInArrow(work, ", ".join([*kinds, *(f"{s} array<double>" for s in [*stages, "output"])]))


def encode_molecules(texts: DataFrame, column: str, config: Config, weights: dict[str, np.ndarray], size: int = 256) -> DataFrame:
    """(column, vector) of distinct SMILES."""
    shared = texts.sparkSession.sparkContext.broadcast((config, weights))

    def work(frames: Iterator[pd.DataFrame]):
        model = Encoder(*shared.value)
        for f in frames:
            for at in range(0, len(f), size):
                part = f[column].iloc[at : at + size].tolist()
                batch = collate([Example("", part, [1.0] * len(part), [0] * len(part), [0] * len(part), 3)])
                yield pd.DataFrame({column: part, "vector": list(model.molecules(batch).v.astype(np.float32))})

    return texts.select(column).distinct().mapInPandas(work, f"{column} string, vector array<float>")
