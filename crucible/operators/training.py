"""Training of the encoder: losses with gradients, AdamW, epochs over a split, the best epoch kept.

Gradients are additive over batches, so a step can be one batch on the driver
or one batch on each partition; fit_partitions and fit_distributed do the latter
and bring one set of gradients for each partition to the driver.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.tables import shared_folder, with_running
from crucible.operators.autograd import T, backward, log1p_exp, log_sum_exp, relu, sqrt
from crucible.operators.encoder import Batch, Config, Encoder, Example, collate, example_of

WEIGHTS = {"contrastive": 1.0, "variance": 1.0, "covariance": 0.04, "labels": 0.0}


def info_nce(a: T, b: T, temperature: float = 0.1) -> T:
    s = a @ b.t() * (1 / temperature)
    own = (s * T(np.eye(len(s.v)))).sum(axis=1)
    return ((log_sum_exp(s) - own).mean() + (log_sum_exp(s.t()) - own).mean()) * 0.5


def variance_loss(views: list[T], target: float = 1.0, eps: float = 1e-4) -> T:
    out = T(0.0)
    for v in views:
        d = v - v.mean(axis=0, keepdims=True)
        out = out + relu(target - sqrt((d * d).mean(axis=0) + eps)).mean()
    return out * (1 / len(views))


def covariance_loss(views: list[T]) -> T:
    out = T(0.0)
    for v in views:
        n, d = v.shape
        c = v - v.mean(axis=0, keepdims=True)
        m = c.t() @ c * (1 / max(1, n - 1)) * T(1 - np.eye(d))
        out = out + (m * m).sum() * (1 / d)
    return out * (1 / len(views))


def label_loss(model: Encoder, e: T, b: Batch) -> T:
    """Binary cross entropy of the annotated rows' classes (numbered from 1); 0 where none is annotated."""
    at = [(i, int(x)) for i, some in enumerate(b.labels) for x in some]
    n = max(1, model.c.labels)
    if any(not 1 <= x <= n for _, x in at):
        raise ValueError(f"labels are numbered from 1 to {n}: {sorted({x for _, x in at if not 1 <= x <= n})}")
    if not at:
        return T(0.0)
    row, label = np.array(at).T
    on, place = np.unique(row, return_inverse=True)
    target = np.zeros((len(on), n))
    target[place, label - 1] = 1.0
    logits = model.label_logits(e[on])
    return (log1p_exp(logits) - logits * T(target)).mean()


def losses(model: Encoder, b: Batch, temperature: float = 0.1) -> dict[str, T]:
    """Two views of each record: as it is and with its participants in reverse; they differ by dropout alone."""
    e1, p1 = model.encode(model.molecules(b), b)
    other = b.permuted()
    e2, p2 = model.encode(model.molecules(other), other)
    return {"contrastive": info_nce(p1, p2, temperature), "variance": variance_loss([e1, e2]), "covariance": covariance_loss([e1, e2]), "labels": label_loss(model, (e1 + e2) * 0.5, b)}


def total(parts: dict[str, T], weights: dict[str, float]) -> T:
    out = T(0.0)
    for name, x in parts.items():
        out = out + x * float(weights[name])
    return out


def gradients(model: Encoder, examples: list[Example], weights: dict[str, float], temperature: float) -> tuple[dict[str, np.ndarray], float]:
    for x in model.w.values():
        x.g = None
    loss = total(losses(model, collate(examples), temperature), weights)
    backward(loss)
    return {k: x.g for k, x in model.w.items() if x.g is not None}, float(loss.v)


@dataclass
class AdamW:
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 5.0
    betas: tuple[float, float] = (0.9, 0.999)
    step_no: int = 0
    m: dict = field(default_factory=dict)
    s: dict = field(default_factory=dict)

    def step(self, model: Encoder, grads: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        self.step_no += 1
        a, b = self.betas
        for k, g in grads.items():
            g = g * scale
            self.m[k] = a * self.m.get(k, 0.0) + (1 - a) * g
            self.s[k] = b * self.s.get(k, 0.0) + (1 - b) * g * g
            m, s = self.m[k] / (1 - a**self.step_no), self.s[k] / (1 - b**self.step_no)
            x = model.w[k]
            x.v = x.v * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(s) + 1e-8)


def reproducible(seed: int, threads: int = 1) -> np.random.Generator:
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, str(threads))
    return np.random.default_rng(seed)


def epoch(model: Encoder, examples: list[Example], weights: dict[str, float], temperature: float, optimiser: AdamW | None, size: int, rng: np.random.Generator) -> float:
    """The mean loss, batches weighed by size; with an optimiser, in a shuffled order and with a step for each batch."""
    order = rng.permutation(len(examples)) if optimiser else np.arange(len(examples))
    model.rng = rng if optimiser else None
    loss_sum = n = 0.0
    for at in range(0, len(order), size):
        part = [examples[i] for i in order[at : at + size]]
        if optimiser:
            grads, loss = gradients(model, part, weights, temperature)
            optimiser.step(model, grads)
        else:
            loss = float(total(losses(model, collate(part), temperature), weights).v)
        loss_sum, n = loss_sum + loss * len(part), n + len(part)
    model.rng = None
    return loss_sum / max(n, 1)


def fit(train: list[Example], validation: list[Example], config: Config, epochs: int = 5, size: int = 64, weights: dict[str, float] | None = None, temperature: float = 0.1, rate: float = 1e-3, seed: int = 42):
    """(weights of the best epoch, history): best by validation loss, or by training loss without validation; a tie keeps the earlier."""
    weights, rng = {**WEIGHTS, **(weights or {})}, reproducible(seed)
    model, optimiser, history, best, kept, began = Encoder(config, trainable=True), AdamW(rate), [], np.inf, None, time.time()
    for i in range(1, epochs + 1):
        loss = epoch(model, train, weights, temperature, optimiser, size, rng)
        held = epoch(model, validation, weights, temperature, None, size, rng) if validation else None
        history.append({"epoch": i, "train": loss, "validation": held, "elapsed": time.time() - began})
        if (held if held is not None else loss) < best:
            best, kept = (held if held is not None else loss), {k: v.copy() for k, v in model.weights().items()}
    return kept, history


def dealt(records: DataFrame, size: int, seed: int) -> tuple[DataFrame, int, int]:
    """(records with a step and a part, number of steps, number of parts): in an order drawn by seed, each record in one batch of some `size`, a batch for each partition in each step.

    The table is written by step, so a step reads its own records. Steps and parts
    differ by one record at most, and no batch has fewer than two where the table has two.
    """
    n = records.count()
    parts = max(1, min(records.rdd.getNumPartitions(), n // 2))
    steps = max(1, min(-(-n // (size * parts)), n // (2 * parts)))
    numbered = with_running(records, [F.xxhash64(F.lit(seed), F.col("record_id")), F.col("record_id")], "_n")
    at = F.col("_n") - 1
    out = numbered.withColumn("_step", (at % steps).cast("int")).withColumn("_part", (F.floor(at / steps) % parts).cast("int")).drop("_n")
    path = f"{shared_folder(records.sparkSession)}/batches-{uuid.uuid4().hex}"
    out.repartition("_step").write.partitionBy("_step").parquet(path)
    return records.sparkSession.read.schema(out.schema).parquet(path), steps, parts


def _of_batch(shared, config: Config, weights: dict[str, float], temperature: float, seed: tuple[int, int]):
    """What gives a batch's gradients, as 32-bit floats in the order of the weights' names, its loss and its size; nothing for one record alone."""

    def work(frames):
        f = pd.concat(list(frames) or [pd.DataFrame()])  # some `size` records
        if len(f) < 2:
            return
        own = Encoder(config, shared.value, trainable=True)
        own.rng = np.random.default_rng([*seed, int(f["_part"].iloc[0])])
        grads, loss = gradients(own, [example_of(r) for r in f.sort_values("record_id").itertuples(index=False)], weights, temperature)
        flat = np.concatenate([grads.get(k, np.zeros_like(own.w[k].v)).ravel() for k in sorted(own.w)])
        yield pd.DataFrame({"g": [flat.astype(np.float32).tobytes()], "loss": [loss], "n": [len(f)]})

    return work


def steps_of(table: DataFrame, steps: int, parts: int, model: Encoder, optimiser: AdamW, weights: dict[str, float], temperature: float, seed: int):
    """(mean loss, records) of each step over a dealt table: every batch gives gradients, and their mean is applied."""
    names = sorted(model.w)
    config = model.c
    for step in range(steps):
        shared = table.sparkSession.sparkContext.broadcast(model.weights())

        # A part's number is its partition's, so each task has one batch.
        got = table.filter(F.col("_step") == step).drop("_step").repartitionById(parts, F.col("_part")).mapInPandas(_of_batch(shared, config, weights, temperature, (seed, step)), "g binary, loss double, n long").collect()
        if not got:
            raise ValueError("two records are needed to contrast")
        mean, at, grads = np.mean([np.frombuffer(r.g, dtype=np.float32) for r in got], axis=0), 0, {}
        for k in names:
            n = model.w[k].v.size
            grads[k], at = mean[at : at + n].reshape(model.w[k].v.shape).astype(np.float64), at + n
        optimiser.step(model, grads)
        shared.unpersist()
        yield float(np.average([r.loss for r in got], weights=[r.n for r in got])), sum(r.n for r in got)


def fit_distributed(records: DataFrame, config: Config, steps: int = 50, size: int = 64, weights: dict[str, float] | None = None, temperature: float = 0.1, rate: float = 1e-3, seed: int = 42):
    """(weights, mean loss of each step): a number of steps, each over one batch for each partition; after a pass over all records they are dealt anew.

    Records have record_id, participants, direction and perhaps label_index. The
    gradients have the size of the weights, whatever the table.
    """
    weights = {**WEIGHTS, **(weights or {})}
    model, optimiser, history = Encoder(config, trainable=True), AdamW(rate), []
    while len(history) < steps:
        table, n, parts = dealt(records, size, seed + len(history))
        history += [loss for loss, _ in steps_of(table, min(n, steps - len(history)), parts, model, optimiser, weights, temperature, seed + len(history))]
    return model.weights(), history


def held_loss(records: DataFrame, model: Encoder, weights: dict[str, float], temperature: float, size: int) -> float | None:
    """The mean loss over records in batches of `size` in the order of their identifiers, weighed by size; None without records."""
    shared, config = model.weights(), model.c

    def work(key, f):
        own = Encoder(config, shared)
        examples = [example_of(r) for r in f.sort_values("record_id").itertuples(index=False)]
        return pd.DataFrame({"loss": [float(total(losses(own, collate(examples), temperature), weights).v) * len(f)], "n": [len(f)]})

    batches = with_running(records, ["record_id"], "_n").withColumn("_batch", F.floor((F.col("_n") - 1) / size)).drop("_n")
    got = batches.groupBy("_batch").applyInPandas(work, "loss double, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return got.loss / got.n if got.n else None


def fit_partitions(train: DataFrame, validation: DataFrame, config: Config, epochs: int = 5, size: int = 64, weights: dict[str, float] | None = None, temperature: float = 0.1, rate: float = 1e-3, seed: int = 42):
    """As `fit`, over tables of any size: an epoch is a pass over all records, with a step for one batch of each partition."""
    weights = {**WEIGHTS, **(weights or {})}
    model, optimiser, history, best, kept, began = Encoder(config, trainable=True), AdamW(rate), [], np.inf, None, time.time()
    for i in range(1, epochs + 1):
        table, steps, parts = dealt(train, size, seed + i)
        done = list(steps_of(table, steps, parts, model, optimiser, weights, temperature, seed + i))
        loss = float(np.average([x for x, _ in done], weights=[n for _, n in done]))
        held = held_loss(validation, model, weights, temperature, size)
        history.append({"epoch": i, "train": loss, "validation": held, "elapsed": time.time() - began})
        if (held if held is not None else loss) < best:
            best, kept = (held if held is not None else loss), {k: v.copy() for k, v in model.weights().items()}
    return kept, history
