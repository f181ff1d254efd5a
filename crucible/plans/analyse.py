"""From records to vectors and from vectors to a quality report; diagnosis of equal vectors, audits and invariance checks of the encoder."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import DIRECTIONS, direction_policy, json_list, json_number, json_text, label_tokens, stable_hash
from crucible.functions.tables import settled
from crucible.operators import quality as Q
from crucible.operators import similarity as S
from crucible.operators import validate as V
from crucible.operators.encoder import Config, Encoder, Example, collate, encode_variants
from crucible.sources import sinks


#: Indices of a participant, as far as it has them.
INDICES = ("role_index", "cofactor_index", "compartment_index")


def oriented(participants: Column, direction: Column) -> Column:
    """Sorted (side, coefficient, structure, cofactor) in the order of the direction: right to left exchanges the sides."""
    swap = direction == "right_to_left"
    turn = lambda p: F.struct(
        F.when(swap, F.when(p["side"] == "reactant", "product").otherwise("reactant")).otherwise(p["side"]).alias("side"),
        F.round(F.when(swap, -p["coefficient"]).otherwise(p["coefficient"]), 8).alias("coefficient"), p["canonical"].alias("canonical"), p["cofactor"].alias("cofactor"),
    )
    return F.array_sort(F.transform(participants, turn))


def core(participants: Column, direction: Column) -> Column:
    """As oriented; for a reversible record the lesser of both ways round."""
    there = oriented(participants, direction)
    back = F.array_sort(F.transform(there, lambda p: F.struct(F.when(p["side"] == "reactant", "product").otherwise("reactant").alias("side"), (-p["coefficient"]).alias("coefficient"), p["canonical"].alias("canonical"), p["cofactor"].alias("cofactor"))))
    return F.when(direction == "reversible", F.least(there, back)).otherwise(there)


def signatures(participants: Column, direction: Column, labels: Column) -> dict[str, Column]:
    """Hashes of what the encoder reads: the structure, the main inputs, and all with the labels."""
    c = core(participants, direction)
    items = json_list(F.transform(c, lambda p: json_list(F.array(json_text(p["side"]), json_number(p["coefficient"]), json_text(p["canonical"]), json_text(p["cofactor"])))))
    head = F.concat(F.lit('{"direction":'), json_text(direction), F.lit(',"participants":'), items)
    missing = json_list(F.transform(c, lambda p: p["cofactor"].isNull().cast("string")))
    return {
        "structure": stable_hash(F.concat(head, F.lit("}"))),
        "main": stable_hash(F.concat(head, F.lit(',"cofactor_missing":'), missing, F.lit("}"))),
        "legacy": stable_hash(F.concat(head, F.lit(',"labels":'), json_list(F.transform(F.array_sort(F.coalesce(labels, F.array().cast("array<string>"))), json_text)), F.lit("}"))),
    }


def model_rows(records: DataFrame, *carry: str) -> DataFrame:
    """(record_id, participants, direction, labels) as the encoder takes them, and the columns `carry`."""
    have = records.schema["participants"].dataType.elementType.fieldNames()
    more = [c for c in INDICES if c in have]
    part = lambda p: F.struct(p["side"].alias("side"), p["coefficient"].alias("coefficient"), p["canonical"].alias("canonical"), (p["cofactor"] if "cofactor" in have else F.lit(None).cast("string")).alias("cofactor"), *(p[c].alias(c) for c in more))
    direction = direction_policy(F.col("supported_directions")) if "supported_directions" in records.columns else F.col("direction")
    return records.select("record_id", F.transform("participants", part).alias("participants"), direction.alias("direction"), *(c for c in ("labels", "label_index", "reaction_type_index") if c in records.columns), *carry)


def distinct_inputs(rows: DataFrame, *names: str) -> DataFrame:
    """Rows that agree in the columns `names` once: the smallest record_id and in n_records how many they are. Equal inputs have equal vectors, so each is encoded once and counts for all."""
    return rows.groupBy(*names).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n_records"))


def encoded_signature(participants: Column, direction: Column, molecule_key, labels: Column | None = None, reaction_type: Column | None = None, indices: tuple[str, ...] = ()) -> Column:
    """A hash of what the encoder reads as numbers: sides, coefficients, molecules by key, the indices of role, cofactor and compartment, direction, kind and labels.

    As signatures(): right to left exchanges the sides, a reversible record is
    the lesser of both ways round. molecule_key makes the key of a participant;
    `indices` names those of INDICES that the participants have, others are 0.
    """
    number = F.array_position(F.array(*map(F.lit, DIRECTIONS)), direction).cast("int") - 1
    index = lambda p, n: F.coalesce(p[n], F.lit(0)).cast("int") if n in indices else F.lit(0)
    have = INDICES
    one = lambda p: F.struct(
        (p["side"] == "product").cast("int").alias("side"), F.round(p["coefficient"], 8).alias("coefficient"), molecule_key(p).alias("molecule"), *(index(p, n).alias(n) for n in have),
    )
    back = lambda p: F.struct((1 - p["side"]).alias("side"), (-p["coefficient"]).alias("coefficient"), p["molecule"].alias("molecule"), *(p[n].alias(n) for n in have))
    there = F.array_sort(F.transform(participants, one))
    turned = F.array_sort(F.transform(there, back))
    chosen = F.when(direction == "right_to_left", turned).when(direction == "reversible", F.least(there, turned)).otherwise(there)
    items = json_list(F.transform(chosen, lambda p: json_list(F.array(json_number(p["side"]), json_number(p["coefficient"]), json_text(p["molecule"]), *(json_number(p[n]) for n in have)))))
    labels = json_list(F.transform(F.array_sort(F.coalesce(labels, F.array().cast("array<bigint>"))), json_number)) if labels is not None else F.lit("[]")
    kind = json_number(F.coalesce(reaction_type, F.lit(0))) if reaction_type is not None else F.lit("0")
    return stable_hash(F.concat(F.lit('{"direction_index":'), json_number(number), F.lit(',"ec_indices":'), labels, F.lit(',"participants":'), items, F.lit(',"reaction_type_index":'), kind, F.lit("}")))


def diagnose(vectors: DataFrame, records: DataFrame, shared: DataFrame, count: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, summary) of records with equal vectors: are their inputs equal, do they hold wildcards or structures that several compounds share?

    `count` names the column of records that says how many each stands for. Joins on records are by sorting, none by broadcast.
    """
    rows = model_rows(records, *([count] if count else [])).join(vectors.hint("merge"), "record_id")
    several = rows.select("record_id", F.explode("participants.canonical").alias("canonical")).join(shared.select("canonical"), "canonical", "left_semi").select("record_id").distinct().withColumn("_several", F.lit(True))
    rows = rows.join(several.hint("merge"), "record_id", "left")
    flags = {"wildcard": F.exists("participants", lambda p: p["canonical"].contains("*")), "unparsed": F.exists("participants", lambda p: p["canonical"].isNull()), "shared_identity": F.coalesce("_several", F.lit(False))}
    return Q.diagnose(rows, "record_id", Q.bit_key(F.col("embedding")), signatures(F.col("participants"), F.col("direction"), F.col("labels")), flags, count)


def quality_report(vectors: DataFrame, labels: DataFrame, id_col: str = "record_id", vector_col: str = "embedding", labels_col: str = "labels", k: int = 10, unexplained: int | None = None, n_pairs: int = 200_000) -> dict:
    """Neighbours, label agreement, spectrum and collapse of a vector table, as small tables."""
    near = S.exact_neighbours(vectors, k, id_col, vector_col).persist()
    metrics = S.retrieval_metrics(near, labels, id_col, labels_col)
    first = near.filter("rank = 1")
    out = {
        "norms": Q.norm_stats(vectors, vector_col), "retrieval": metrics.orderBy("level", "k"), "nearest": Q.quantiles(first, "cosine", (0.5, 0.95, 0.99), (0.999, 0.9999)),
        "collapse": Q.collapse_report(vectors, id_col, vector_col, unexplained, n_pairs), "most_similar": Q.global_top(near, "cosine", 20, ["query", "neighbour"]),
        "ranks": Q.monotone_violations(near, "query", "rank", "cosine", k),
    }
    rows = {name: [r.asDict() for r in df.collect()] for name, df in out.items()}
    near.unpersist()
    return rows


def holdout(vectors: DataFrame, split: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Vectors that neither training nor validation saw, both as queries and as candidates."""
    return vectors.join(split.select(id_col).distinct(), id_col, "left_anti")


def write_report(rows: dict, path: str) -> None:
    sinks.report(rows, path + ".json")
    sinks.markdown("Vector quality", {k: v for k, v in rows.items() if isinstance(v, list)}, path + ".md")


def check_export(vectors: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """An export keeps: one vector of the right size for each identifier, finite, no identifier twice or missing."""
    from crucible.functions.columns import all_finite

    suite = V.Suite().rows(vectors, {"size": F.size("embedding") == size, "finite": all_finite(F.col("embedding"))}).unique(vectors, ["record_id"], "record_unique")
    return suite.references(ids, "record_id", vectors, "every_record").references(vectors, "record_id", ids, "no_other_record").checks()


def collision_trace(molecules: DataFrame, records: DataFrame, vectors: DataFrame, count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbered members of molecule groups, summary) of molecules with equal vectors (canonical, vector), and of records with equal ones.

    Of the groups of records with equal vectors: in how many the encoded inputs
    are equal, with each molecule as its vector's hash, and how many hold two
    molecules of one vector. A molecule without structure is read as the encoder
    reads it, as an atom of any kind (*); one that `molecules` lacks is itself.
    `count` names the column of records that says how many each stands for.
    Joins on records and groups are by sorting, none by broadcast: staged files
    are far smaller than their rows in memory.
    """
    keyed = molecules.select("canonical", F.sha2(Q.bit_key(F.col("vector")), 256).alias("molecule"))
    sizes = keyed.groupBy("molecule").agg(F.count(F.lit(1)).alias("group_size"), F.min("canonical").alias("first_id"))
    groups = Q.numbered_groups(sizes.filter("group_size > 1"))
    members = keyed.join(groups, "molecule").select("group_id", "group_size", F.col("canonical").alias("smiles"))
    found = vectors.select("record_id", F.sha2(Q.bit_key(F.col("embedding")), 256).alias("group"))
    rows = model_rows(records.withColumn("_n", F.col(count) if count else F.lit(1)), "_n").join(found.hint("merge"), "record_id")
    parts = rows.select("group", "record_id", "direction", "_n", F.posexplode_outer("participants").alias("pos", "p")).select("group", "record_id", "direction", "_n", "pos", "p.*")
    parts = parts.withColumn("canonical", F.coalesce("canonical", F.lit("*"))).join(keyed, "canonical", "left").withColumn("molecule", F.coalesce("molecule", "canonical"))
    more = tuple(c for c in INDICES if c in parts.columns)
    again = parts.groupBy("group", "record_id", "direction", "_n").agg(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("side", "coefficient", "molecule", "canonical", *more))).alias("participants"))
    sign = encoded_signature(F.col("participants"), F.col("direction"), lambda p: p["molecule"], indices=more)
    pairs = F.array_distinct(F.transform("participants", lambda p: F.struct(p["molecule"].alias("molecule"), p["canonical"].alias("canonical"))))
    signed = settled(again.select("group", "_n", F.when(F.size("participants") > 0, sign).alias("s"), pairs.alias("pairs")), "signed")
    explained = signed.groupBy("group").agg(F.sum("_n").alias("n"), (F.min("s") == F.max("s")).alias("explained")).filter("n > 1 AND explained IS NOT NULL")
    structures = signed.select("group", F.explode("pairs").alias("x")).select("group", "x.*").distinct().groupBy("group", "molecule").agg(F.count(F.lit(1)).alias("c"))
    collided = structures.groupBy("group").agg((F.max("c") > 1).alias("collided"))
    of_records = explained.join(collided.hint("merge"), "group").agg(
        F.count(F.lit(1)).alias("record_group_count"), F.count_if("explained").alias("groups_with_equal_inputs"), F.count_if("collided").alias("groups_with_equal_molecules"),
    )
    of_molecules = sizes.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("molecule_count"), F.count(F.lit(1)).alias("distinct_count"), F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("excess"),
        F.count_if(F.col("group_size") > 1).alias("group_count"), F.coalesce(F.sum(F.when(F.col("group_size") > 1, F.col("group_size"))), F.lit(0)).alias("molecules_in_groups"),
    )
    one = F.lit(0).alias("_one")
    return members, of_molecules.select("*", one).join(of_records.select("*", one), "_one").drop("_one")  # one row each


def without_direction(rows: DataFrame, group: str, direction: str = "reversible") -> DataFrame:
    """rows without the groups that hold a record of that direction."""
    return rows.join(rows.filter(F.col("direction") == direction).select(group).distinct(), group, "left_anti")


def audit(records: DataFrame, config: Config, weights: dict[str, np.ndarray]) -> DataFrame:
    """One row: what leaving out the direction changes (distance of each record's vectors), and that labels and excluded indices change nothing.

    The records are encoded as they are, with labels on all of them exchanged
    for another, and with other roles, compartments and kinds: all reach the
    encoder, which must not read them. Equal inputs are encoded once and count
    for all, the four vectors of an input in one task.
    """
    rows = model_rows(records)
    if "label_index" not in rows.columns:
        rows = rows.withColumn("label_index", F.array(F.lit(1)))
    others = ("role_index", "compartment_index")
    have = rows.schema["participants"].dataType.elementType.fieldNames()
    altered = lambda p: F.struct(*(p[n].alias(n) for n in have if n not in others), *(F.lit(7).alias(n) for n in others))
    inputs = distinct_inputs(rows, "participants", "direction", "label_index")
    inputs = inputs.withColumns({"other_labels": F.transform("label_index", lambda x: x + 1), "other_participants": F.transform("participants", altered)})
    vectors = encode_variants(inputs, config, weights, {
        "embedding": {"labels": "label_index"}, "d": {"labels": "label_index", "masks": {"mask_direction": True}},
        "l": {"labels": "other_labels"}, "m": {"participants": "other_participants", "labels": "label_index"},
    }, carry=("n_records",))
    gap = lambda n: F.array_max(F.zip_with("embedding", n, lambda x, y: F.abs(x - y)))
    squares = F.zip_with("embedding", "d", lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    d = settled(vectors.select("n_records", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("d"), gap("l").alias("l"), gap("m").alias("m")), "audit")
    median, n = Q.exact_quantiles(d, "d", (0.5,), "n_records")[0.5], F.col("n_records")
    out = d.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("record_count"), F.min("d").alias("direction_min"), F.lit(median).cast("double").alias("direction_median"), (F.sum(F.col("d") * n) / F.sum(n)).alias("direction_mean"), F.max("d").alias("direction_max"),
        F.coalesce(F.sum(F.when(F.col("d") > 1e-6, n)), F.lit(0)).alias("direction_changed"), F.max("l").alias("label_max_difference"), F.max("m").alias("metadata_max_difference"),
    )
    return out.withColumn("passed", (F.col("label_max_difference") == 0) & (F.col("metadata_max_difference") == 0) & (F.col("direction_changed") == F.col("record_count")))


def plot_tables(vectors: DataFrame, near: DataFrame, metrics: DataFrame, id_col: str = "record_id", vector_col: str = "embedding", n_pairs: int = 200_000, bins: int = 60) -> dict[str, DataFrame]:
    """The data of the report's three panels: the spectrum, the cosines of nearest and of random pairs, and precision by level and k beside chance."""
    width = lambda df, name: sinks.histogram(df, "cosine", -1.0, 1.0, bins).withColumn("pairs", F.lit(name))
    return {
        "spectrum": Q.spectrum(vectors, vector_col),
        "cosines": width(near.filter("rank = 1"), "nearest").unionByName(width(Q.random_pairs(vectors, id_col, vector_col, n_pairs), "random")),
        "precision": metrics.select("level", "k", "precision", "random_precision", "lift"),
    }


def neighbour_table(near: DataFrame, labels: DataFrame, id_col: str = "record_id", labels_col: str = "labels") -> DataFrame:
    """Neighbours with the labels of both, joined by semicolons, and whether they agree at level 1, level 2 and as a whole; a side without labels never agrees."""
    empty = F.array().cast("array<string>")
    of = labels.select(F.col(id_col).alias("_id"), F.coalesce(labels_col, empty).alias("_l"))
    both = near.join(of.select(F.col("_id").alias("query"), F.col("_l").alias("a")), "query", "left").join(of.select(F.col("_id").alias("neighbour"), F.col("_l").alias("b")), "neighbour", "left")
    agree = lambda level: F.coalesce(F.arrays_overlap(label_tokens(F.col("a"), level), label_tokens(F.col("b"), level)), F.lit(False))
    return both.select(
        F.col("query").alias("query_reaction_id"), "rank", F.col("neighbour").alias("neighbor_reaction_id"), F.col("cosine").alias("cosine_similarity"),
        F.array_join(F.coalesce("a", empty), ";").alias("query_ec"), F.array_join(F.coalesce("b", empty), ";").alias("neighbor_ec"),
        agree("1").alias("ec_level1_match"), agree("2").alias("ec_level2_match"), agree("exact").alias("exact_ec_match"),
    )


def diagnostic_tables(vectors: DataFrame, records: DataFrame, shared: DataFrame, near: DataFrame) -> dict[str, DataFrame]:
    """What write_tables writes for a set of vectors: neighbours, label agreement, and groups of equal vectors, numbered, with their members."""
    members, groups, _ = diagnose(vectors, records, shared)
    numbered = settled(Q.numbered_groups(groups), "groups")
    return {
        "nearest_neighbors": neighbour_table(near, records), "ec_consistency": S.retrieval_metrics(near, records, "record_id", "labels"),
        "duplicate_embedding_groups": numbered.drop("key"), "duplicate_embedding_members": members.join(numbered.select("key", "group_id"), "key").drop("key", "first_id").withColumnRenamed("id", "reaction_id"),
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Diagnostic tables as delimited files with a header: neighbours, label agreement, groups, members, traces, ablation. Scores have eight decimals."""
    for name, df in tables.items():
        sinks.delimited(df, f"{folder}/{name}", sep=",", decimals={c: 8 for c, t in df.dtypes if t == "double"})


def direction_counts(records: DataFrame) -> DataFrame:
    """(direction, n) with all four directions, also those that no record has."""
    have = model_rows(records).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
    all_of = records.sparkSession.createDataFrame([(d,) for d in DIRECTIONS], "direction string")
    return all_of.join(have, "direction", "left").select("direction", F.coalesce("n", F.lit(0)).alias("n"))


#: Largest differences that the invariance checks allow; the last is a least cosine.
TOLERANCES = {"order": 1e-5, "repeat": 0.0, "single": 1e-5, "reversible_swap": 1e-6, "rewritten_cosine": 0.999}


def invariance(examples: list[Example], config: Config, weights: dict[str, np.ndarray]) -> dict:
    """What may not change a vector: participants' order, repetition, the batch, exchanged sides of a reversible record, another SMILES of a molecule."""
    from crucible.operators.chemistry import canonical_text, parse_smiles

    model = Encoder(config, weights)
    batch = collate(examples[:8])
    molecules = model.molecules(batch)
    base = model.encode(molecules, batch)[0].v
    gap = lambda a, b: float(np.abs(a - b).max())
    single = collate(examples[:1])
    reversible = next((e for e in examples if e.direction == 2), replace(examples[0], direction=2))
    one = collate([reversible])
    m = model.molecules(one)
    texts = next(((t, canonical_text(parse_smiles(t))) for e in examples for t in e.molecules if canonical_text(parse_smiles(t)) != t), None)
    cosine = 1.0
    if texts:
        pair = model.molecules(collate([Example("", list(texts), [1.0, 1.0], [0, 0], [0, 0], 3)])).v
        cosine = float(pair[0] @ pair[1] / np.linalg.norm(pair[0]) / np.linalg.norm(pair[1])) if len(pair) == 2 else 1.0
    out = {
        "order": gap(base, model.encode(molecules, batch.permuted())[0].v), "repeat": gap(base, model.encode(molecules, batch)[0].v),
        "single": gap(base[0], model.encode(model.molecules(single), single)[0].v[0]), "reversible_swap": gap(model.encode(m, one)[0].v, model.encode(m, one.swapped())[0].v),
        "rewritten_cosine": cosine, "metadata_missing_finite": bool(np.isfinite(model.encode(molecules, batch, mask_metadata=True)[0].v).all()),
    }
    out["passed"] = all(out[k] <= t for k, t in TOLERANCES.items() if k != "rewritten_cosine") and cosine >= TOLERANCES["rewritten_cosine"] and out["metadata_missing_finite"]
    return out


def ablation(first: dict, second: dict, only: str) -> None:
    """An error unless two configurations differ in one entry alone."""
    differ = sorted(k for k in first.keys() | second.keys() if first.get(k) != second.get(k))
    if differ != [only]:
        raise ValueError(f"configurations differ in {differ}, not in {only!r} alone")


def decision(low: float, high: float) -> str:
    """What a paired interval says about the second model."""
    return "second_better" if low > 0 else "second_worse" if high < 0 else "no_clear_difference"
