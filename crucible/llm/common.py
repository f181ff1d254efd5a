"""What the operators of this subpackage share: staged tables in the shared folder and text rules."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions.shipping import ship
from crucible.functions.tables import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return its reader: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, batches handed to Python have at most so many rows: for columns of large values. For plans that run within it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, by: Column, most: int = 1024, salts: int = 32) -> DataFrame:
    """rows joined with facts, which has a row for each key and in `size` the number of its rows.

    Keys with more than 1/most of all rows, of which there are fewer than
    `most`, are dealt out over several parts by a hash of `by`; their facts are
    repeated for each part. `size` does not stay.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = [r[0] for r in facts.filter(F.col(size) * most > total).filter(F.col(size) > 1).select(keys[0]).distinct().limit(most).collect()]
    if not hot:
        return rows.join(facts.drop(size), keys)
    is_hot = F.col(keys[0]).isin(hot)
    left = rows.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = facts.drop(size).withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_part"]).drop("_part")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() has a fast path for plain ASCII; translate() serves the rest."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """The lower-cased words as UTF-8: bytes.lower() and bytes.split() know exactly A-Z and the six white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to be no column of df in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unused_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, with as many underscores behind it as it takes for no column of df to begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
