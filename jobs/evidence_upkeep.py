"""Keeps the direction variants of records up to date with a growing folder of evidence.

    python -m jobs.evidence_upkeep --events DIR_OR_PATTERN --members DIR --out DIR --checkpoint DIR [--config FILE]

Each run takes the files that came since the last one (a file stream with
availableNow; its checkpoint is the high-water mark) and keeps three tables in
the output folder:

evidence/part=P/batch=B   the evidence of batch B for the records of part P; a batch that runs
                          again after a failure overwrites its own folders
variants/part=P           three rows for each record of part P, and in `through` the last batch
                          that they count
members/                  which key belonged to which record at the end of the last run

Only parts with later evidence than their variants count, or with new members,
are made again, each as a whole from the evidence, so a run that ended anywhere
can be repeated. Evidence of keys that no record has yet waits in part -1.
Identifiers count once over all batches; a database that cannot be told is "unknown". A key that moves to another record is
an error: its evidence is filed under the old one; such a change needs new folders.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.operators.evidence import direction_evidence, direction_variants

log = logging.getLogger("jobs.evidence_upkeep")
CONFIG = Path(__file__).with_suffix(".json")
WAITING = -1
EVIDENCE = "direction string, database string, value string, {key}, part int, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as it stands; no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace_parts(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, events: str, members: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """One run; waits for the stream to end. Returns what it logs."""
    c = json.loads(CONFIG.read_text()) | (config or {})
    parts, key = int(c["parts"]), c["key"]
    owners = spark.read.parquet(members).select(F.expr(c["member_record"]).alias("canonical_id"), F.expr(c["member_key"]).alias(key)).dropna().distinct()
    owners = owners.withColumn("part", F.pmod(F.xxhash64("canonical_id"), F.lit(parts)).cast("int"))
    kinds = dict(owners.dtypes)
    evidence_schema, member_schema = EVIDENCE.format(key=f"`{key}` {kinds[key]}"), f"canonical_id {kinds['canonical_id']}, `{key}` {kinds[key]}, part int"

    before = _read(spark, f"{out}/members", member_schema)
    moved = owners.join(before.select(key, F.col("canonical_id").alias("was")), key).filter("canonical_id <> was").limit(1).collect()
    if moved:
        raise ValueError(f"{key} {moved[0][key]} moved from record {moved[0].was} to {moved[0].canonical_id}: start with new folders")

    read: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_database", F.coalesce(F.expr(c["database"]), F.lit("unknown"))).filter(F.col(key).isNotNull())
        found = direction_evidence(rows, key, c["code"], c["value"], database="_database", codes=c["codes"]).withColumn("value", F.col("value").cast("string"))
        filed = found.join(owners.select(key, "part"), key, "left").withColumn("part", F.coalesce("part", F.lit(WAITING))).withColumn("batch", F.lit(number))
        # A part's rows of one large record go to several files, not to one task.
        _replace_parts(filed.repartition("part", F.pmod(F.xxhash64("value"), F.lit(8))), f"{out}/evidence", "part", "batch")
        read.append(batch.count())

    source = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", int(c["files_per_batch"])).parquet(events)
    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    said = {"events_read": sum(read), "batches": len(read)}

    evidence = _read(spark, f"{out}/evidence", evidence_schema)
    counted = _read(spark, f"{out}/variants", "through long, part int").groupBy("part").agg(F.max("through").alias("through"))
    latest = evidence.groupBy("part").agg(F.max("batch").alias("batch"))
    late = latest.join(counted, "part", "left").filter("part >= 0 AND (through IS NULL OR batch > through)").select("part")
    fresh = owners.join(before.select("canonical_id", key), ["canonical_id", key], "left_anti").select("part")
    stale = sorted(r.part for r in late.unionByName(fresh).distinct().collect())  # `parts` numbers at most
    if stale:
        mine = owners.filter(F.col("part").isin(stale))
        known = evidence.filter(F.col("part").isin([*stale, WAITING])).select(key, "direction", "database", "value")
        through = evidence.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        rows = direction_variants(mine.select("canonical_id", key), known, key)
        rows = rows.withColumn("through", F.lit(through).cast("long")).withColumn("part", F.pmod(F.xxhash64("canonical_id"), F.lit(parts)).cast("int"))
        _replace_parts(rows.repartition("part"), f"{out}/variants", "part")
        owners.write.mode("overwrite").parquet(f"{out}/members")
    said |= {"members_read": owners.count(), "parts_written": len(stale), "variants": _read(spark, f"{out}/variants", "part int").count()}
    log.info("read %(events_read)d events in %(batches)d batches and %(members_read)d members; wrote %(parts_written)d parts; %(variants)d variants stand", said)
    return said


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("events", "members", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("evidence_upkeep").getOrCreate()
    try:
        run(spark, a.events, a.members, a.out, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
