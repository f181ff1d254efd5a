"""From a corpus to a trained encoder, and from an encoder to vectors: vocabularies, split, checkpoint, history, export, manifest."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions.tables import settled
from crucible.operators import quality as Q
from crucible.operators import segments as S
from crucible.operators import training as TR
from crucible.operators import validate as V
from crucible.operators.encoder import Config, encode_records, example_of, new_weights, restore, save
from crucible.plans import analyse as A
from crucible.sources import sinks

#: Vocabularies and where their values stand: a field of participants, or a column.
OF_PARTICIPANTS = {"role": "role", "cofactor": "cofactor_role", "compartment": "compartment"}
#: Records that are trained on in one process; larger corpora train on all partitions.
MOST_LOCAL = 100_000


@dataclass
class Corpus:
    rows: DataFrame
    """record_id, participants with indices, supported_directions, labels, label_index, reaction_type_index."""
    vocabularies: dict[str, DataFrame]
    molecules: DataFrame
    """(canonical, index) of the distinct structures in order, from 1."""
    sizes: dict[str, int]
    """Values of each vocabulary and one place for a missing one."""


def build_corpus(records: DataFrame) -> Corpus:
    """The encoder's view of records in the published layout (reaction_id, participants, ec_numbers, reaction_type, supported_directions).

    Vocabularies are numbered from 1 in the order of their values; 0 stands for a
    missing value. A vocabulary without values is not joined.
    """
    base = settled(records.select(F.col("reaction_id").alias("record_id"), "participants", F.col("ec_numbers").alias("labels"), "reaction_type", "supported_directions"), "model-records")
    parts = base.select("record_id", F.posexplode("participants").alias("pos", "p")).select("record_id", "pos", "p.*")
    columns = {n: parts.select(F.col(c).alias(n)) for n, c in OF_PARTICIPANTS.items()}
    columns |= {"label": base.select(F.explode("labels").alias("label")), "reaction_type": base.select("reaction_type")}
    vocabularies = {n: settled(S.vocabulary(df, n), f"vocabulary-{n}") for n, df in columns.items()}
    sizes = {n: v.count() + 1 for n, v in vocabularies.items()}
    numbered = lambda df, column, name: S.with_index(df, vocabularies[name].withColumnRenamed(name, column), column, f"{name}_index") if sizes[name] > 1 else df.withColumn(f"{name}_index", F.lit(0).cast("bigint"))
    for name, column in OF_PARTICIPANTS.items():
        parts = numbered(parts, column, name)
    fields = ["pos", "side", "coefficient", F.col("canonical_smiles").alias("canonical"), F.col("cofactor_role").alias("cofactor"), *(f"{n}_index" for n in OF_PARTICIPANTS)]
    nested = parts.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("participants"))
    labels = numbered(base.select("record_id", F.explode("labels").alias("label")), "label", "label").groupBy("record_id").agg(F.array_sort(F.collect_list("label_index")).alias("label_index"))
    rows = numbered(base.drop("participants"), "reaction_type", "reaction_type").join(nested, "record_id").join(labels, "record_id", "left")
    rows = rows.withColumn("label_index", F.coalesce("label_index", F.array().cast("array<bigint>")))
    molecules = S.vocabulary(parts.select(F.col("canonical_smiles").alias("canonical")), "canonical")
    return Corpus(settled(rows, "model-rows"), vocabularies, settled(molecules, "model-molecules"), sizes)


def train(spark: SparkSession, corpus: Corpus, config: Config, folder: str, epochs: int = 5, size: int = 64, weights: dict[str, float] | None = None, fraction: float = 0.05, seed: int = 42, limit: int | None = None, rate: float = 1e-3, most_local: int = MOST_LOCAL) -> dict:
    """Train and write into a folder of the driver: checkpoint.npz (weights of the best epoch, configuration), history.jsonl and metadata.json, which is returned; `split` and `vocabularies` as Parquet.

    Up to `most_local` records train in this process, more on all partitions. Either
    way an epoch is a pass over all records, followed by the loss on those held out,
    and the weights of the best epoch are kept. The checkpoint itself holds the
    split and a vocabulary only up to `most_local` rows; the tables are whole.
    """
    began = time.time()
    config = replace(config, cofactors=corpus.sizes["cofactor"], labels=max(1, corpus.sizes["label"] - 1))
    split = settled(S.split(corpus.rows, "record_id", fraction, seed, limit), "split")
    rows = A.model_rows(corpus.rows).join(split, "record_id")
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    if sum(n.values()) <= most_local:
        examples = {"train": [], "validation": []}
        for r in rows.orderBy("position").collect():  # most_local rows at most
            examples[r.split].append(example_of(r))
        kept, history = TR.fit(examples["train"], examples["validation"], config, epochs, size, weights, rate=rate, seed=seed)
    else:
        kept, history = TR.fit_partitions(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), config, epochs, size, weights, rate=rate, seed=seed)
    best = min(history, key=lambda h: h["train"] if h["validation"] is None else h["validation"])["epoch"]
    os.makedirs(folder, exist_ok=True)
    sinks.parquet(split, f"{folder}/split")
    for name, v in corpus.vocabularies.items():
        sinks.parquet(v, f"{folder}/vocabularies/{name}")
    values = {k: {r[k]: r["index"] for r in v.collect()} for k, v in corpus.vocabularies.items() if corpus.sizes[k] <= MOST_LOCAL}
    ids = [(r.record_id, r.split) for r in split.orderBy("position").select("record_id", "split").collect()] if sum(n.values()) <= most_local else None  # None: see the table
    data = sinks.checksum(corpus.rows)
    more = {"vocab_sizes": corpus.sizes, "vocabularies": values, "vocabulary_checksums": sinks.manifest(corpus.vocabularies), "split": ids, "data_checksum": data, "epoch": best, "loss_weights": {**TR.WEIGHTS, **(weights or {})}}
    save(f"{folder}/checkpoint.npz", config, kept, **more)
    with open(f"{folder}/history.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(h, sort_keys=True) + "\n" for h in history)
    held = history[best - 1]["validation"]
    metadata = {
        "created_at_utc": datetime.now(UTC).isoformat(), "best_epoch": best, "best_validation_loss": held, "train_count": n.get("train", 0), "validation_count": n.get("validation", 0), "record_count": corpus.rows.count(), "molecule_count": corpus.molecules.count(),
        "seed": seed, "config": asdict(config), "loss_weights": more["loss_weights"], "data_checksum": data, "git_revision": sinks.git_revision(), "elapsed_seconds": round(time.time() - began, 3),
    }
    with open(f"{folder}/metadata.json", "w", encoding="utf-8") as f:
        json.dump(metadata, f, indent=2, sort_keys=True)
    return metadata


def export(spark: SparkSession, corpus: Corpus, checkpoint: str, folder: str, matrix: bool = True) -> dict:
    """Vectors of all records of a corpus by a checkpoint, as Parquet and, if asked for, as a matrix with identifiers; report.json, manifest.json. Returns the report.

    An error where the vocabularies are not those of the checkpoint, where an
    identifier is missing or twice, a component is not finite, or an invariance
    check fails.
    """
    config, weights, meta = restore(checkpoint)
    if meta["vocab_sizes"] != corpus.sizes:
        raise ValueError(f"the checkpoint's vocabularies have sizes {meta['vocab_sizes']}, the corpus's {corpus.sizes}")
    if differ := sinks.verify_manifest(corpus.vocabularies, meta["vocabulary_checksums"]):
        raise ValueError(f"vocabularies that are not those of the checkpoint: {sorted(differ)}")
    rows = A.model_rows(corpus.rows)
    sinks.parquet(encode_records(rows, config, weights), f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    V.require(A.check_export(vectors, rows, config.dim))
    examples = [example_of(r) for r in rows.orderBy("record_id").limit(8).collect()]
    checks = A.invariance(examples, config, weights)
    if not checks["passed"]:
        raise ValueError(f"invariance checks failed: {checks}")
    if matrix:
        sinks.matrix_files(vectors, "record_id", "embedding", f"{folder}/matrix")
    norms, dup = Q.norm_stats(vectors, "embedding").first().asDict(), Q.duplicate_excess(vectors, "embedding").first().asDict()
    report = {"shape": [norms["row_count"], config.dim], "norms": norms, "duplicates": dup, "invariance": checks, "epoch": meta["epoch"], "loss_weights": meta["loss_weights"], "labels_are_input": config.use_ec}
    sinks.report(report, f"{folder}/report.json")
    manifest = {"outputs": sinks.manifest({"vectors": vectors}), "data_checksum": sinks.checksum(corpus.rows), "checkpoint_data_checksum": meta["data_checksum"], "config": asdict(config), "git_revision": sinks.git_revision()}
    sinks.report(manifest, f"{folder}/manifest.json")
    return report


def untrained(corpus: Corpus, dim: int = 32, **more) -> tuple[Config, dict[str, np.ndarray]]:
    """A configuration that fits the corpus, with its first weights."""
    config = Config(dim=dim, cofactors=corpus.sizes["cofactor"], labels=max(1, corpus.sizes["label"] - 1), **more)
    return config, new_weights(config)
