"""From archives to a canonical corpus: scan, parse, normalise, key, merge, evidence, variants, report."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions.columns import first_group, numeric_suffix, prefixed
from crucible.functions.tables import bucketed, settled
from crucible.operators import evidence as E
from crucible.operators import records as R
from crucible.operators import validate as V
from crucible.operators.chemistry import canonicalise, parse_molblock, parse_rxn
from crucible.plans import formats
from crucible.sources import readers, sinks

#: File and column names of the public reaction archives.
DIRECTIONS_FILE, EC_FILE, XREFS_FILE, UNIPROT_FILE, SMILES_FILE = "rhea-directions.tsv", "rhea2ec.tsv", "rhea2xrefs.tsv", "rhea2uniprot_sprot.tsv", "rhea-reaction-smiles.tsv"
DIRECTION_COLUMNS = ["RHEA_ID_MASTER", "RHEA_ID_LR", "RHEA_ID_RL", "RHEA_ID_BI"]
UNIPROT = "UniProtKB_Swiss-Prot"


@dataclass
class Config:
    tsv_archive: str
    rxn_archive: str
    release: str
    ignored: list[str] = field(default_factory=list)
    prefix: str = "RHEA"

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Config:
        return cls(**readers.yaml_config(spark, path))


@dataclass
class Corpus:
    records: DataFrame
    molecules: DataFrame
    resolved: DataFrame
    id_map: DataFrame
    source_records: DataFrame
    variants: DataFrame
    loose: DataFrame
    changes: DataFrame
    failures: DataFrame
    balance: DataFrame
    prefix: str

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if k not in ("molecules", "resolved", "prefix")}

    def published(self) -> dict[str, DataFrame]:
        """The tables in their published layout."""
        return {"reactions": formats.records(self.records, self.prefix), "source_reactions": formats.source_records(self.source_records, self.prefix), "direction_variants": formats.variants(self.variants)}


MOLECULES = "record_id string, side string, pos int, compound_id string, original string, canonical string, status string, atoms map<string,bigint>, charge bigint, unknown_atoms int, error string, stage string"


def parse_members(found: DataFrame) -> DataFrame:
    """A row for each molecule of each record (record_id, text, reaction_smiles); a record that cannot be parsed gives one row with stage and error."""
    from crucible.functions.columns import split_sides

    left, right = split_sides("reaction_smiles")
    one = found.select("record_id", "text", left.alias("l"), right.alias("r"))

    def work(batches):
        for batch in batches:
            rows = []
            for rid, text, l, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # noqa: E741
                try:
                    sides = parse_rxn(text)
                except Exception as e:
                    rows.append((rid, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}", "rxn_parse"))
                    continue
                for side, blocks, source in zip(("reactant", "product"), sides, (l, r), strict=True):
                    for i, block in enumerate(blocks):
                        p = canonicalise(lambda block=block: parse_molblock(block), source[i] if i < len(source) else None)
                        name = block[0].strip() if block and block[0].strip() else "UNKNOWN"
                        rows.append((rid, side, i, name, p.original, p.canonical, p.status, p.atoms, p.charge, p.unknown_atoms, p.error, None))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(12)]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.int64()), pa.int64(), pa.int32(), pa.string(), pa.string()]
            fixed = [[list(x.items()) if isinstance(x, dict) else x for x in c] if t == types[7] else list(c) for c, t in zip(cols, types, strict=True)]
            names = [x.split()[0] for x in MOLECULES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fixed, types, strict=True)], names=names)

    return one.mapInArrow(work, MOLECULES)


def prepare(spark: SparkSession, c: Config) -> Corpus:
    tables = settled(readers.tar_members(spark, c.tsv_archive, ".tsv"), "archive")  # the archive is read once
    tsv = lambda name, columns, header=True: readers.tsv_from_members(tables, name, columns, header)
    number = lambda x: F.col(x).cast("bigint")
    raw = tsv(DIRECTIONS_FILE, DIRECTION_COLUMNS).withColumn("_at", F.monotonically_increasing_id())
    directions = readers.last_wins(raw.select(number("RHEA_ID_MASTER").alias("master"), number("RHEA_ID_LR").alias("left_to_right"), number("RHEA_ID_RL").alias("right_to_left"), number("RHEA_ID_BI").alias("reversible"), "_at"), "master", "_at").drop("_at")
    directions = bucketed(directions.withColumn("record_id", prefixed(c.prefix, "master")).withColumn("member", F.concat(F.col("left_to_right").cast("string"), F.lit(".rxn"))), "directions", "master")
    ec = E.index_values(tsv(EC_FILE, ["MASTER_ID", "ID"]).select(number("MASTER_ID").alias("master"), "ID"), "master", "ID").withColumnRenamed("values", "labels")
    ec = bucketed(ec, "labels", "master")
    xrefs_raw = tsv(XREFS_FILE, ["MASTER_ID", "DB", "ID", "DIRECTION"]).select(number("MASTER_ID").alias("master"), "DB", "ID", "DIRECTION")
    xrefs = bucketed(E.index_xrefs(xrefs_raw, "master", "DB", "ID"), "xrefs", "master")
    # One row for each record, first in buckets of the master number, then of the identifier.
    sources = bucketed(directions.join(ec, "master", "left").join(xrefs, "master", "left"), "sources", "record_id")
    smiles = readers.last_wins(tsv(SMILES_FILE, ["id", "reaction_smiles"], header=False).select(number("id").alias("left_to_right"), "reaction_smiles").withColumn("_at", F.monotonically_increasing_id()), "left_to_right", "_at").drop("_at")
    members = readers.decoded(readers.last_by_name(readers.tar_members(spark, c.rxn_archive, ".rxn"))).select(F.col("basename").alias("member"), "ordinal", F.col("text").alias("content"))
    found, lost = R.parse_outcomes(directions, members)
    releases = found.select(first_group("content", r"RHEA:release=(\d+)").alias("release"))
    V.require(V.check_single_value(releases, "release", c.release, "one_release"))
    parsed = settled(parse_members(found.withColumnRenamed("content", "text").join(smiles, "left_to_right", "left")), "molecules")
    molecules = parsed.filter("stage IS NULL")
    failures = lost.unionByName(parsed.filter("stage IS NOT NULL").select("record_id", "stage", "error"))
    parts = R.participants(molecules)
    balance = R.balance(molecules)
    fields = ["side_order", "compound_id", "canonical", "coefficient", "side", "compartment", "status", "original"]
    no_xrefs = F.expr("map()").cast("map<string,array<string>>")
    records = R.nested(parts, fields).join(sources, "record_id").join(balance, "record_id")
    records = records.join(smiles.withColumnRenamed("reaction_smiles", "source_reaction_smiles"), "left_to_right", "left")
    records = records.withColumn("reaction_smiles", R.text_of(F.col("participants"))).withColumn("xrefs", F.coalesce("xrefs", no_xrefs))
    keyed = settled(R.with_keys(records, c.ignored), "keyed")
    resolved = settled(R.resolve_duplicates(keyed), "resolved")
    kept = R.merged(resolved)
    # Cross references of a group, united by database.
    united = resolved.select("canonical_id", F.explode("xrefs").alias("db", "ids")).groupBy("canonical_id", "db").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("db", "ids")))).alias("xrefs"))
    kept = kept.drop("xrefs").join(united, "canonical_id", "left").join(formats.group_facts(resolved, c.release, c.prefix), "canonical_id")
    id_map = R.id_map(resolved, directions)
    uniprot = tsv(UNIPROT_FILE, ["MASTER_ID", "ID", "DIRECTION"]).select(number("MASTER_ID").alias("master"), "ID", "DIRECTION")
    ev = E.direction_evidence(xrefs_raw, "master", "DIRECTION", "ID", database="DB").unionByName(E.direction_evidence(uniprot, "master", "DIRECTION", "ID", fixed_database=UNIPROT)).distinct()
    of = resolved.select("canonical_id", "master")
    counts = settled(E.evidence_counts(of, ev, "master"), "evidence-counts")  # read by variants and summary
    variants = E.direction_variants(of, ev, "master", counts)
    ids = resolved.select("canonical_id", F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), prefixed(c.prefix, d).alias("id")) for d in ("left_to_right", "right_to_left", "reversible")))).alias("x"))
    ids = ids.groupBy("canonical_id", "x.direction").agg(F.array_sort(F.collect_list("x.id")).alias("directional_ids"))
    variants = settled(variants.join(ids, ["canonical_id", "direction"]), "variants")
    kept = kept.join(E.supported(variants).withColumnRenamed("directions", "supported_directions"), "canonical_id").join(formats.evidence_summary(counts), "canonical_id", "left")
    return Corpus(
        kept.withColumn("direction_missing", F.size("supported_directions") == 0), molecules, resolved, id_map, R.source_records(sources, id_map, failures),
        variants, R.loose_candidates(kept), R.changes(molecules), failures, balance, c.prefix,
    )


def quality_report(corpus: Corpus) -> dict:
    """Counts and coverage of a corpus: one row from each aggregation."""
    table = corpus.published()["reactions"]
    states = {r.status: r["count"] for r in corpus.balance.groupBy("status").count().collect()}
    return {
        "coverage": formats.coverage(table).first().asDict(), "counts": formats.report_counts(table).first().asDict(), "balance": states, "dedup": R.dedup_stats(corpus.resolved, xrefs="xrefs").first().asDict(), "support": E.support_stats(corpus.variants).first().asDict(),
        "source_record_count": corpus.source_records.count(), "rxn_smiles_fallback_count": corpus.molecules.filter(F.col("error").startswith("rxn_fallback")).count(), "failures": corpus.failures.count(), "loose_groups": corpus.loose.count(),
        "molecule_status": {r.status: r["count"] for r in corpus.molecules.groupBy("status").count().collect()},
    }


def constraints(corpus: Corpus) -> DataFrame:
    """The rules that a prepared corpus keeps."""
    signs = corpus.records.select(F.explode("participants").alias("p")).select("p.*")
    published = corpus.published()
    return V.union(
        formats.rules(published["reactions"], published["source_reactions"], published["direction_variants"], corpus.id_map),
        V.check_rows(signs, {"sign_follows_side": F.when(F.col("side") == "reactant", F.col("coefficient") < 0).otherwise(F.col("coefficient") > 0)}),
        V.check_unique(corpus.records, ["record_id"], "record_unique"),
        V.check_complete(corpus.variants, "canonical_id", "direction", ["left_to_right", "right_to_left", "reversible"], "three_variants"),
        V.check_unique(corpus.id_map, ["source_id"], "source_once"),
        V.check_references(corpus.id_map.filter("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("record_id")), "record_id", corpus.records, "map_to_kept"),
    )


def write(corpus: Corpus, folder: str) -> dict[str, str]:
    """All tables as Parquet, also in the published layout, variants and maps as TSV, records and the change log as JSON lines; the manifest of contents."""
    for name, df in (corpus.tables() | corpus.published()).items():
        sinks.parquet(df, f"{folder}/{name}")
    sinks.json_lines(corpus.published()["reactions"], f"{folder}/reactions_jsonl")
    sinks.json_lines(corpus.published()["source_reactions"], f"{folder}/source_reactions_jsonl")
    sinks.delimited(corpus.id_map.orderBy(numeric_suffix("source_id")), f"{folder}/id_map_tsv", single=True)
    sinks.delimited(corpus.loose, f"{folder}/loose_tsv")
    sinks.delimited(corpus.variants, f"{folder}/variants_tsv")
    sinks.json_lines(corpus.changes, f"{folder}/changes_jsonl")
    return sinks.manifest(corpus.tables())


def main(arguments: list[str] | None = None) -> dict:
    """Command line: CONFIG.yaml OUTPUT. Prints and returns the summary."""
    import argparse
    import json

    p = argparse.ArgumentParser(description="Prepare a canonical corpus from archives")
    p.add_argument("config")
    p.add_argument("output")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("prepare").getOrCreate()
    corpus = prepare(spark, Config.from_yaml(spark, a.config))
    V.require(constraints(corpus))
    summary = quality_report(corpus) | {"manifest": write(corpus, a.output)}
    print(json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    return summary
