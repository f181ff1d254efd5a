"""Evidence: multimaps of identifiers, direction evidence, direction variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import DIRECTION_CODES, DIRECTIONS, SEMANTICS, recode


def index_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of each key."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def index_xrefs(rows: DataFrame, key: str, database: str, value: str) -> DataFrame:
    """(key, xrefs): a map from database to sorted distinct identifiers, databases in order."""
    lists = rows.groupBy(key, database).agg(F.sort_array(F.collect_set(value)).alias("ids"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(database), "ids")))).alias("xrefs"))


def direction_evidence(rows: DataFrame, key: str, code: str, value: str, database: str | None = None, fixed_database: str | None = None, codes: dict[str, str] | None = None) -> DataFrame:
    """(key, direction, database, value), each once; rows with an unknown direction code are left out."""
    source = F.col(database) if database else F.lit(fixed_database)
    return rows.select(F.col(key), recode(code, codes or DIRECTION_CODES).alias("direction"), source.alias("database"), F.col(value).alias("value")).filter("direction IS NOT NULL").distinct()


def evidence_counts(members: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(canonical_id, direction, database, n): distinct identifiers of the evidence that a record's members (canonical_id, key) have together."""
    return members.join(evidence, key).groupBy("canonical_id", "direction", "database").agg(F.count_distinct("value").alias("n"))


def direction_variants(members: DataFrame, evidence: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Three rows for each record of members (canonical_id, key): what evidence its members have together for each direction.

    Identifiers count once for each direction and database, over all members
    and sources. Records without evidence have rows with zero counts. Counts that
    are there already (of `evidence_counts`) can be given.
    """
    counts = evidence_counts(members, evidence, key) if counts is None else counts
    by = counts.groupBy("canonical_id", "direction").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("database", "n")))).alias("by_database"))
    wanted = members.select("canonical_id").distinct().withColumn("direction", F.explode(F.array(*map(F.lit, DIRECTIONS[:3]))))
    undefined = by.filter(F.col("direction") == "undefined").select("canonical_id", F.col("n").alias("undefined_count"))
    out = wanted.join(by, ["canonical_id", "direction"], "left").join(undefined, "canonical_id", "left")
    return out.select(
        "canonical_id", "direction",
        F.concat_ws("|", F.col("canonical_id").cast("string"), "direction").alias("variant_id"),
        (F.col("direction") == "right_to_left").alias("swap_sides"),
        (F.col("direction") == "reversible").alias("symmetrized"),
        F.coalesce("n", F.lit(0)).cast("long").alias("evidence_count"),
        (F.coalesce("n", F.lit(0)) > 0).alias("has_evidence"),
        F.coalesce(F.to_json("by_database"), F.lit("{}")).alias("evidence_by_database"),
        F.coalesce("undefined_count", F.lit(0)).cast("long").alias("undefined_count"),
        recode("direction", SEMANTICS).alias("semantics"),
    )


def supported(variants: DataFrame) -> DataFrame:
    """(canonical_id, directions): those with evidence, in their fixed order; undefined is never one."""
    order = F.array(*map(F.lit, DIRECTIONS[:3]))
    have = F.collect_set(F.when(F.col("has_evidence"), F.col("direction")))
    return variants.groupBy("canonical_id").agg(have.alias("_have")).select("canonical_id", F.filter(order, lambda d: F.array_contains("_have", d)).alias("directions"))


def support_stats(variants: DataFrame) -> DataFrame:
    """One row: records, records with evidence, and records with evidence for each direction."""
    per = variants.groupBy("canonical_id").agg(F.max(F.col("has_evidence").cast("int")).alias("any"), *(F.max((F.col("has_evidence") & (F.col("direction") == d)).cast("int")).alias(d) for d in DIRECTIONS[:3]))
    return per.agg(F.count(F.lit(1)).alias("record_count"), F.coalesce(F.sum("any"), F.lit(0)).alias("with_evidence"), *(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIRECTIONS[:3]))
