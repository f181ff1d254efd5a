"""Tables between plans: places where lineage ends, and row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one, but only if all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="crucible-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later plans do not compute it anew."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, whose key is nearly unique, written to the shared folder in sorted buckets of the key and read again.

    There are as many buckets as shuffles have partitions, so joins on the key with
    such tables, or with what was grouped by it, shuffle nothing. A key of many
    rows stays in one bucket, which no plan divides: such tables go to `settled`.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def with_running(df: DataFrame, order: list[Column | str], index: str = "index", total: tuple[str, str] | None = None) -> DataFrame:
    """df with a 1-based number in the given (total) order, and on request the running total of a column: total = (column, name).

    Rows are range-partitioned and sorted; each partition numbers its own, and
    the counts of the partitions, one row each, give the offsets.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    sums = [F.count(F.lit(1)).alias("_n"), *([F.sum(total[0]).alias("_s")] if total else [])]
    parts = placed.groupBy("_part").agg(*sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0")] if total else []))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(offsets), "_part").withColumn(index, F.col("_n0") + F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    if total:
        out = out.withColumn(total[1], F.col("_s0") + F.sum(total[0]).over(within))
    return out.drop("_part", "_at", "_n0", "_s0")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, by: Column, most: int = 1024, salts: int = 64) -> DataFrame:
    """rows joined with facts, which has one row for each key (null is one) and in `size` how many rows have it.

    Keys of more than 1/most of all rows are fewer than `most`. Their rows are
    dealt out over `salts` parts by a hash of `by`, and their facts go to each
    part, so no task gets all rows of a key, whatever its share, with or without
    adaptive execution.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.broadcast(facts.filter(F.col(size) * most > total).select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot")))  # fewer than `most` rows
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = rows.join(hot, rows[key].eqNullSafe(F.col("_hot")), "left").withColumn("_salt", salt).drop("_hot", "_is_hot")
    every = F.when(F.col(size) * most > total, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = facts.withColumn("_at", F.explode(every)).withColumnRenamed(key, "_key")
    return left.join(right, (left["_salt"] == right["_at"]) & left[key].eqNullSafe(right["_key"])).drop("_salt", "_at", "_key")
