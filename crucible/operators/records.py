"""Nested records: participants, balance, coverage, keys, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions.columns import loose_key, numeric_suffix, strict_key
from crucible.functions.tables import join_facts, settled

#: Name prefixes of compounds without a definite structure.
GENERIC_PREFIXES = ("POLYMER:", "RHEA-COMP:")


def participants(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Participants from one row per molecule (record_id, side, pos, compound_id, original, canonical, status).

    Equal compounds with equal canonical structure on a side are one participant
    with their number as coefficient, negative for reactants; its original is
    the first by position, its status the worst.
    """
    sign = F.when(F.col("side") == "reactant", -1.0).otherwise(1.0)
    n = F.count(F.lit(1)).cast("double")
    unsanitized = F.max((F.col("status") == "unsanitized").cast("int")) == 1
    grouped = members.groupBy(*(by or ["record_id"]), "side", "compound_id", "canonical").agg(
        (n * F.first(sign)).alias("coefficient"),
        F.min_by("original", "pos").alias("original"),
        F.when(F.first("canonical").isNull(), "failed").when(unsanitized, "unsanitized").otherwise("sanitized").alias("status"),
    )
    return grouped.withColumn("missing", F.col("canonical").isNull())


def nested(parts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(record_id, participants): reactants, then products, each sorted by compound and structure."""
    fields = fields or ["side_order", "compound_id", "canonical", "coefficient", "side", "compartment", "status"]
    have = parts.withColumn("side_order", F.when(F.col("side") == "reactant", 0).otherwise(1))
    for name, kind in (("compartment", "string"), ("status", "string")):
        if name not in have.columns:
            have = have.withColumn(name, F.lit(None).cast(kind))
    return have.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("participants"))


def changes(members: DataFrame) -> DataFrame:
    """A row for each molecule whose canonical text differs from the source's, null being a value of its own."""
    return members.filter(~F.col("original").eqNullSafe(F.col("canonical"))).select(
        "record_id", "compound_id", F.lit("structure").alias("field"), F.col("original").alias("original_value"), F.col("canonical").alias("processed_value"),
        F.when(F.col("canonical").isNotNull(), "high").otherwise("low").alias("confidence"),
    )


def balance(members: DataFrame) -> DataFrame:
    """Element and charge balance from one row per molecule (record_id, side, compound_id, atoms map, charge, unknown_atoms).

    Three-valued: null where a participant is generic, has unknown atoms or no
    known composition. The deltas are products minus reactants; elements whose
    delta is zero are left out.
    """
    generic = F.lit(False)
    for p in GENERIC_PREFIXES:
        generic = generic | F.col("compound_id").startswith(p)
    sign = F.when(F.col("side") == "reactant", -1).otherwise(1)
    state = members.groupBy("record_id").agg(
        F.max((generic | (F.col("unknown_atoms") > 0)).cast("int")).alias("_generic"),
        F.max((F.col("atoms").isNull() | F.col("charge").isNull()).cast("int")).alias("_failed"),
        F.sum(sign * F.coalesce("charge", F.lit(0))).alias("charge_delta"),
    )
    elements = members.select("record_id", sign.alias("_sign"), F.explode("atoms").alias("element", "n")).groupBy("record_id", "element").agg(F.sum(F.col("_sign") * F.col("n")).alias("d"))
    off = elements.filter("d <> 0").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("element", "d"))).alias("delta"))
    known = (F.col("_generic") == 0) & (F.col("_failed") == 0)
    none = F.col("delta").isNull()
    balanced = F.when(known, none & (F.col("charge_delta") == 0))
    return state.join(off, "record_id", "left").select(
        "record_id", balanced.alias("is_balanced"),
        F.when(~known, "unknown").when(balanced, "balanced").otherwise("imbalanced").alias("status"),
        F.when(F.col("_generic") == 1, "generic_or_polymeric_participant").when(F.col("_failed") == 1, "smiles_parse_failure").alias("reason"),
        F.when(known, F.coalesce(F.to_json(F.map_from_entries("delta")), F.lit("{}"))).alias("element_delta"),
        F.when(known, F.col("charge_delta")).alias("charge_delta"),
    )


def coverage(records: DataFrame, fields: dict[str, Column], of_participants: dict[str, object]) -> DataFrame:
    """One row of shares: of records for which a condition holds, and of all participants for which one does; 0 where there are none."""
    n = F.count(F.lit(1))
    parts = F.sum(F.size("participants"))
    share = lambda x, of: F.round(F.when(of > 0, x / of).otherwise(0.0), 6)
    aggs = [share(F.count_if(F.coalesce(c, F.lit(False))), n).alias(k) for k, c in fields.items()]
    aggs += [share(F.sum(F.size(F.filter("participants", f))), parts).alias(k) for k, f in of_participants.items()]
    return records.agg(*aggs)


def with_keys(records: DataFrame, ignored: list[str], direction: Column | None = None) -> DataFrame:
    """records with strict_key and loose_key; keys are made before any direction is known."""
    direction = F.lit("undefined") if direction is None else direction
    return records.withColumn("strict_key", strict_key(F.col("participants"), direction)).withColumn("loose_key", loose_key(F.col("participants"), ignored))


def resolve_duplicates(records: DataFrame, key: str = "strict_key", number: Column | None = None, conflict: str = "status") -> DataFrame:
    """records with canonical_id and dedup_status for each record (record_id, number order, conflict column).

    Records of one key are merged into the one of the smallest number, unless
    their conflict values differ: then all stay. The groups' facts come from an
    aggregation, combined before the shuffle, and meet the records in a join that
    deals out the records of large groups.
    """
    number = numeric_suffix("record_id") if number is None else number
    numbered = records.withColumn("_number", number)
    facts = numbered.groupBy(key).agg(
        F.min_by("record_id", "_number").alias("_winner"), F.count(F.lit(1)).alias("group_size"),
        (F.min(conflict).eqNullSafe(F.max(conflict)) & ((F.count(conflict) == 0) | (F.count(conflict) == F.count(F.lit(1))))).alias("_agree"),
    )
    joined = join_facts(numbered, settled(facts, "duplicate-facts"), key, "group_size", F.col("record_id"))
    first = F.col("record_id") == F.col("_winner")
    clash = (F.col("group_size") > 1) & ~F.col("_agree")
    return joined.select(
        *records.columns, "group_size",
        F.when(clash, F.col("record_id")).otherwise(F.col("_winner")).alias("canonical_id"),
        F.when(clash, "kept_conflict").when(first, "kept").otherwise("merged_strict_exact").alias("dedup_status"),
    )


def merged(resolved: DataFrame, labels: str = "labels", number: Column | None = None) -> DataFrame:
    """A row for each kept record: the winner's columns, the ids of its group in order of number, the united labels (null for none)."""
    number = numeric_suffix("record_id") if number is None else number
    pairs = F.array_sort(F.collect_list(F.struct(number.alias("n"), F.col("record_id").alias("id"))))
    groups = resolved.groupBy("canonical_id").agg(pairs.alias("_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(labels, F.array().cast("array<string>")))))).alias("_labels"))
    kept = resolved.filter(F.col("record_id") == F.col("canonical_id")).drop(labels)
    return kept.join(groups, "canonical_id").withColumn("equivalent_ids", F.transform("_ids", lambda x: x["id"])).withColumn(labels, F.when(F.size("_labels") > 0, F.col("_labels"))).drop("_ids", "_labels")


def id_map(resolved: DataFrame, sources: DataFrame, failed_status: str = "excluded_missing_rxn") -> DataFrame:
    """(source_id, canonical_id, status) for every source, also for those that were never parsed."""
    known = resolved.select(F.col("record_id").alias("source_id"), "canonical_id", F.col("dedup_status").alias("status"))
    lost = sources.select(F.col("record_id").alias("source_id")).join(known, "source_id", "left_anti")
    return known.unionByName(lost.select("source_id", F.lit(None).cast("string").alias("canonical_id"), F.lit(failed_status).alias("status")))


def loose_candidates(kept: DataFrame, number: Column | None = None) -> DataFrame:
    """Kept records that share a loose key: reported, never merged."""
    number = numeric_suffix("record_id") if number is None else number
    ids = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.col("record_id").alias("id")))), lambda x: x["id"])
    return kept.groupBy("loose_key").agg(ids.alias("record_ids"), F.count(F.lit(1)).alias("candidate_count")).filter("candidate_count > 1").withColumn("action", F.lit("report_only_not_merged"))


def dedup_stats(resolved: DataFrame, key: str = "strict_key", labels: str = "labels", xrefs: str | None = None) -> DataFrame:
    """One row of counts over records and key groups; differing labels and cross references never stop a merge, they are counted."""
    refs = F.coalesce(F.to_json(xrefs), F.lit("{}")) if xrefs else F.lit("{}")
    groups = resolved.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.array_join(labels, ";"), F.lit(""))).alias("label_sets"), F.count_distinct(refs).alias("xref_sets"),
        F.max((F.col("dedup_status") == "kept_conflict").cast("int")).alias("clash"),
    )
    several = F.col("n") > 1
    return groups.agg(
        F.sum("n").alias("record_count"),
        F.sum(F.when(F.col("clash") == 1, F.col("n")).otherwise(1)).alias("retained_count"),
        F.count_if(several).alias("duplicate_group_count"),
        F.count_if(several & (F.col("label_sets") > 1)).alias("label_conflict_group_count"),
        *([F.count_if(several & (F.col("xref_sets") > 1)).alias("xref_conflict_group_count")] if xrefs else []),
        F.count_if(F.col("clash") == 1).alias("conflict_group_count"),
        F.sum(F.when(F.col("clash") == 1, 0).otherwise(F.col("n") - 1)).alias("merged_count"),
    )


def parse_outcomes(sources: DataFrame, blobs: DataFrame, on: str = "member", key: str = "record_id", release: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources that meet their blob, and a dead letter for those that do not (stage, error). Of blobs of one name the last counts."""
    last = Window.partitionBy(on).orderBy(F.desc("ordinal"))
    one = blobs.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    joined = sources.join(one, on, "left")
    lost = joined.filter(F.col("content").isNull()).select(F.col(key), F.lit("rxn_lookup").alias("stage"), F.concat(F.lit("no member "), F.col(on)).alias("error"))
    return joined.filter(F.col("content").isNotNull()), lost


def source_records(sources: DataFrame, mapping: DataFrame, failures: DataFrame) -> DataFrame:
    """Every source with what became of it."""
    out = sources.join(mapping.withColumnRenamed("source_id", "record_id"), "record_id", "left").join(failures.select("record_id", "stage", "error"), "record_id", "left")
    return out.withColumn("included", F.col("canonical_id").isNotNull()).withColumn("parse_status", F.when(F.col("canonical_id").isNotNull(), "parsed").otherwise(F.coalesce("stage", F.lit("not_parsed")))).withColumnRenamed("error", "parse_error").drop("stage")


def positional_zip(left: Column, right: Column) -> Column:
    """Pairs by position as long as the left list; null where the right one is shorter."""
    return F.transform(left, lambda x, i: F.struct(x.alias("left"), F.get(right, i).alias("right")))


def text_of(parts: Column) -> Column:
    """Both sides as one text: structures joined by dots, null as nothing."""
    side = lambda s: F.array_join(F.transform(F.filter(parts, lambda p: p["side"] == s), lambda p: F.coalesce(p["canonical"], F.lit(""))), ".")
    return F.concat(side("reactant"), F.lit(">>"), side("product"))


