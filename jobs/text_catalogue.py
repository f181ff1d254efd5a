"""Catalogues the texts of a table: which are copies, which record stands for them, where their labels disagree.

    python -m jobs.text_catalogue --documents DIR --labels DIR --out DIR [--config FILE]

Texts are records, their digest is the strict key, and the rule of duplicates is
that of records: copies are merged into the one of the smallest identifier
unless they differ in the conflict column, in which case all stay. Written are

catalogue/origin=S   one row for each document: key, group, canonical record, status, labels
texts/origin=S       the whole texts of the records that stay
groups/              for each group of copies: its size, whether sources and languages agree and
                     how many of its members' labels differ
summary/             counts by source, as CSV

Every table is overwritten, so a second run on the same input leaves the same
rows. A null text is an empty one, a null or empty source its own partition;
rows without identifier never stand for a group. Of several labels of a document
the largest counts in each column.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions.tables import settled
from crucible.operators.quality import diagnose
from crucible.operators.records import resolve_duplicates

log = logging.getLogger("jobs.text_catalogue")
CONFIG = Path(__file__).with_suffix(".json")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> tuple[dict, DataFrame]:
    """One run. Returns what it logs, and the catalogue read back."""
    c = json.loads(CONFIG.read_text()) | (config or {})
    i, names = c["id"], c["label_columns"]
    docs = spark.read.parquet(documents)
    marked = spark.read.parquet(labels).filter(F.col(i).isNotNull()).groupBy(F.col(i).alias("record_id")).agg(*(F.max(x).alias(x) for x in names))
    text = F.coalesce(F.col(c["text"]), F.lit(""))
    facts = docs.select(F.col(i).alias("record_id"), F.col(c["source"]).alias("source"), F.col(c["conflict"]).alias("status"), F.sha2(text, 256).alias("text_key"), F.char_length(text).cast("long").alias("length"))
    facts = settled(facts.join(marked, "record_id", "left"), "catalogue-facts")
    resolved = settled(resolve_duplicates(facts, key="text_key", number=F.col("record_id")), "catalogue-resolved")

    # A source may hold most rows, so its rows are dealt to several tasks and files.
    def write(df, folder):
        spread = df.withColumn("origin", F.coalesce(F.nullif("source", F.lit("")), F.lit("none"))).repartition("origin", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(int(c["parts_of_a_source"]))))
        spread.write.mode("overwrite").option("maxRecordsPerFile", int(c["rows_of_a_file"])).partitionBy("origin").parquet(f"{out}/{folder}")
        return spark.read.schema(spread.schema).parquet(f"{out}/{folder}")  # a folder without rows has no files to tell the schema

    catalogue = resolved.select(F.col("record_id").alias("doc_id"), "source", "text_key", "length", "group_size", "canonical_id", "dedup_status", *names)
    written = write(catalogue, "catalogue").drop("origin")
    staying = catalogue.filter("dedup_status <> 'merged_strict_exact'").select("doc_id", "text_key", "source")
    whole = docs.select(F.col(i).alias("doc_id"), F.sha2(text, 256).alias("text_key"), F.col(c["text"]).alias("text"))
    texts = write(staying.join(whole, ["doc_id", "text_key"]), "texts")

    _, groups, _ = diagnose(facts, "record_id", F.col("text_key"), {"source": F.col("source"), "status": F.col("status")} | {x: F.col(x) for x in names}, {})
    groups.write.mode("overwrite").parquet(f"{out}/groups")
    summary = catalogue.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("length").alias("characters"),
        *(F.count_if(F.col("dedup_status") == x).alias(x) for x in ("kept", "merged_strict_exact", "kept_conflict")), *(F.sum(x).alias(x) for x in names),
    )
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/summary")
    said = {"documents_read": facts.count(), "labels_read": marked.count(), "catalogue": written.count(), "texts": texts.count(), "groups": spark.read.schema(groups.schema).parquet(f"{out}/groups").count()}
    log.info("read %(documents_read)d documents and labels of %(labels_read)d; wrote %(catalogue)d catalogue rows, %(texts)d texts, %(groups)d groups", said)
    return said, written


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("text_catalogue").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
