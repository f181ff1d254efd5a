"""Tables in the published layout of a canonical corpus: records, sources, variants; their coverage, counts and rules.

Column names and constant texts here are fixed values of that layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import numeric_suffix, prefixed
from crucible.operators import records as R
from crucible.operators import validate as V

VARIANTS = ("master", "left_to_right", "right_to_left", "reversible")
#: What a record may lack; those that a record of the archives always lacks are true.
MASKS = ("reaction_type", "cofactor", "ec_numbers", "atom_map", "compartment", "context", "flux", "direction")


def variant_ids(prefix: str) -> Column:
    """The struct of a source's identifier and those of its directions, from their numbers."""
    return F.struct(*(prefixed(prefix, v).alias(v) for v in VARIANTS))


def provenance(release: str, record_id: Column) -> Column:
    """Where a source record comes from."""
    fields = {"source": F.lit("Rhea"), "source_release": F.lit(release), "source_reaction_id": record_id, "rxn_direction_used": F.lit("left_to_right"), "match_confidence": F.lit("exact")}
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def group_facts(resolved: DataFrame, release: str, prefix: str, number: Column | None = None) -> DataFrame:
    """(canonical_id, source_id_list, provenance) of each kept record: all identifiers of its group, sorted, and the members' provenance in order of number.

    Only numbers are shuffled; texts are made of a group's members where they have met.
    """
    number = numeric_suffix("record_id") if number is None else number
    rows = resolved.select("canonical_id", F.struct(number.alias("n"), "record_id", *VARIANTS).alias("x"))
    groups = rows.groupBy("canonical_id").agg(F.array_sort(F.collect_list("x")).alias("members"))
    return groups.select(
        "canonical_id", F.array_sort(F.array_distinct(F.flatten(F.transform("members", lambda x: F.array(*(prefixed(prefix, x[v]) for v in VARIANTS)))))).alias("source_id_list"),
        F.transform("members", lambda x: provenance(release, x["record_id"])).alias("provenance"),
    )


def evidence_summary(counts: DataFrame) -> DataFrame:
    """(canonical_id, direction_evidence_summary_json) of counted evidence: by direction and database, how many identifiers; both in order."""
    by = counts.groupBy("canonical_id", "direction").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("database", "n"))))).alias("j"))
    item = lambda x: F.concat(F.lit('"'), x["direction"], F.lit('":'), x["j"])
    return by.groupBy("canonical_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("direction", "j"))), item), ","), F.lit("}")).alias("direction_evidence_summary_json"))


def participant(p: Column, have: list[str]) -> Column:
    """A participant of 15 fields; what the archives do not say is null and marked as missing."""
    text = lambda n: (p[n] if n in have else F.lit(None)).cast("string")
    fields = {
        "compound_id": p["compound_id"], "original_smiles": text("original"), "canonical_smiles": p["canonical"], "smiles_sanitization_status": text("status"), "smiles_missing": p["canonical"].isNull(),
        "mapped_smiles": F.lit(None).cast("string"), "original_coefficient": p["coefficient"], "coefficient": p["coefficient"], "side": p["side"],
        "compartment": text("compartment"), "role": text("role"), "cofactor_role": text("cofactor"),
        "cofactor_missing": text("cofactor").isNull(), "compartment_missing": text("compartment").isNull(), "role_missing": text("role").isNull(),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def records(kept: DataFrame, prefix: str) -> DataFrame:
    """The record of 27 fields from kept records (record_id, canonical_id, equivalent_ids, master and the three directions' numbers,
    participants, reaction_smiles, source_reaction_smiles, supported_directions, direction_evidence_summary_json, labels, is_balanced,
    status, element_delta, charge_delta, xrefs, source_id_list, provenance, strict_key, loose_key)."""
    have = kept.schema["participants"].dataType.elementType.fieldNames()
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    labels = F.when(F.size(F.coalesce("labels", empty)) > 0, F.col("labels"))
    no_direction = F.size("supported_directions") == 0
    marks = {m: F.lit(True) for m in MASKS} | {"ec_numbers": labels.isNull(), "direction": no_direction}
    return kept.select(
        F.col("record_id").alias("reaction_id"), F.col("record_id").alias("canonical_reaction_id"), F.concat(F.lit(f"{prefix}_EQ:"), F.col("master").cast("string")).alias("equivalence_group_id"),
        F.struct(F.col("source_id_list").alias("rhea"), *(empty.alias(x) for x in ("metanetx", "modelseed", "bigg"))).alias("source_ids"),
        F.col("equivalent_ids").alias("equivalent_rhea_master_ids"), variant_ids(prefix).alias("direction_variant_ids"),
        F.transform("participants", lambda p: participant(p, have)).alias("participants"),
        "reaction_smiles", "source_reaction_smiles", none.alias("atom_mapped_reaction_smiles"), F.lit("undefined").alias("direction"), none.alias("reaction_type"),
        "supported_directions", no_direction.alias("direction_missing"), F.coalesce("direction_evidence_summary_json", F.lit("{}")).alias("direction_evidence_summary_json"),
        labels.alias("ec_numbers"), "is_balanced", F.col("status").alias("balance_check_status"), F.col("element_delta").alias("balance_element_delta_json"), F.col("charge_delta").cast("bigint").alias("balance_charge_delta"),
        F.lit(0).cast("bigint").alias("balance_unknown_atom_count"),  # a balance with unknown atoms is unknown
        none.alias("context"), F.coalesce(F.to_json("xrefs"), F.lit("{}")).alias("external_xrefs_json"),
        F.struct(*(c.alias(m) for m, c in marks.items())).alias("missing_masks"), "provenance", F.col("strict_key").alias("canonical_key_sha256"), F.col("loose_key").alias("loose_key_sha256"),
    )


def source_records(outcomes: DataFrame, prefix: str) -> DataFrame:
    """The source record of 9 fields from sources with what became of them (record_id, canonical_id, included, status, parse_status, parse_error, the four numbers, labels, xrefs)."""
    return outcomes.select(
        F.col("record_id").alias("source_reaction_id"), F.col("canonical_id").alias("canonical_reaction_id"), F.col("included").alias("embedding_included"),
        F.coalesce("status", F.lit("excluded_missing_rxn")).alias("deduplication_status"), "parse_status", "parse_error", variant_ids(prefix).alias("direction_variant_ids"),
        F.col("labels").alias("ec_numbers"), F.coalesce(F.to_json("xrefs"), F.lit("{}")).alias("external_xrefs_json"),
    )


def variants(rows: DataFrame) -> DataFrame:
    """The direction variant of 11 fields from rows as direction_variants makes them, with directional_ids."""
    names = {
        "variant_id": "direction_variant_id", "canonical_id": "canonical_reaction_id", "direction": "direction", "directional_ids": "rhea_directional_ids", "swap_sides": "swap_sides", "symmetrized": "reversible_symmetrization",
        "evidence_count": "directional_evidence_count", "has_evidence": "has_directional_evidence", "evidence_by_database": "evidence_by_database_json", "undefined_count": "undefined_evidence_count", "semantics": "semantics",
    }
    return rows.select(*(F.col(a).alias(b) for a, b in names.items()))


def coverage(table: DataFrame) -> DataFrame:
    """One row of the 12 shares of records or participants that have a field; 0 where there are none."""
    given = lambda f: lambda p: p[f].isNotNull()
    filled = lambda f: lambda p: p[f].isNotNull() & (p[f] != "")
    return R.coverage(
        table,
        {
            "reaction_smiles": F.col("reaction_smiles") != "", "direction_defined": F.col("direction") != "undefined", "direction_evidence_available": F.size("supported_directions") > 0,
            "ec_numbers": F.size(F.coalesce("ec_numbers", F.array().cast("array<string>"))) > 0, "reaction_type": F.col("reaction_type").isNotNull(),
            "atom_map": F.col("atom_mapped_reaction_smiles").isNotNull(), "context": F.col("context").isNotNull(),
        },
        {
            "participant_compound_id": filled("compound_id"), "participant_canonical_smiles": filled("canonical_smiles"), "participant_compartment": given("compartment"),
            "participant_role": given("role"), "participant_cofactor_role": given("cofactor_role"),
        },
    )


def report_counts(table: DataFrame) -> DataFrame:
    """One row: records; participants without structure and with an unsanitized one; records whose balance is off or unknown."""
    parts = lambda cond: F.coalesce(F.sum(F.size(F.filter("participants", cond))), F.lit(0))
    return table.agg(
        F.count(F.lit(1)).alias("reaction_count"), parts(lambda p: p["canonical_smiles"].isNull()).alias("failed_smiles_count"), parts(lambda p: p["smiles_sanitization_status"] == "unsanitized").alias("unsanitized_smiles_count"),
        F.count_if(F.col("balance_check_status") == "imbalanced").alias("imbalanced_reaction_count"), F.count_if(F.col("balance_check_status") == "unknown").alias("unknown_balance_count"),
    )


def rules(table: DataFrame, sources: DataFrame, variant_rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """What holds between the tables of a corpus: (rule, violations)."""
    p = F.col("participants")
    has = lambda s: F.exists(p, lambda x: x["side"] == s)
    signed = F.forall(p, lambda x: F.when(x["side"] == "reactant", x["coefficient"] < 0).otherwise(x["coefficient"] > 0))
    included = F.col("embedding_included")
    suite = V.Suite()
    suite.rows(table, {"both_sides": has("reactant") & has("product"), "structures_given": F.forall(p, lambda x: F.coalesce(x["canonical_smiles"], F.lit("")) != ""), "signs_follow_sides": signed})
    suite.unique(table, ["reaction_id"], "record_once").unique(variant_rows, ["direction_variant_id"], "variant_once")
    suite.complete(variant_rows, "canonical_reaction_id", "direction", list(VARIANTS[1:]), "three_directions")
    suite.references(table, "reaction_id", variant_rows, "record_has_variants", "canonical_reaction_id")
    suite.references(variant_rows, "canonical_reaction_id", table, "variant_has_record", "reaction_id")
    suite.rows(sources, {"excluded_has_error": included | (F.col("canonical_reaction_id").isNull() & F.col("parse_error").isNotNull())})
    suite.references(sources, "canonical_reaction_id", table, "included_has_record", "reaction_id", where=included)
    suite.unique(id_map, ["source_id"], "mapped_once").references(sources, "source_reaction_id", id_map, "source_mapped", "source_id")
    return suite.checks()


def report_rules(report: dict, neighbours: DataFrame, rows: int, size: int, k: int = 10) -> list[str]:
    """What is wrong with a quality report and its neighbours (query, rank, neighbour, cosine): texts, none where all is right.

    The report's flag must be that of all its criteria, label agreement must
    have a row for each level and k, and each query k neighbours in order, none
    of them itself.
    """
    from crucible.operators.quality import monotone_violations

    wrong = []
    if report.get("shape") != [rows, size]:
        wrong.append(f"shape {report.get('shape')} is not {[rows, size]}")
    collapse = report["collapse"][0]
    if collapse["passed"] != all(v for c, v in collapse.items() if c.endswith("_ok")):
        wrong.append("the collapse flag is not that of its criteria")
    if len(report["retrieval"]) != 12:
        wrong.append(f"{len(report['retrieval'])} rows of label agreement, not 12")
    m = monotone_violations(neighbours, "query", "rank", "cosine", k).first()
    own, queries = neighbours.filter("query = neighbour").count(), neighbours.select("query").distinct().count()
    wrong += [f"{n}: {v}" for n, v in (*m.asDict().items(), ("own_neighbours", own), ("missing_queries", rows - queries)) if v]
    return wrong
