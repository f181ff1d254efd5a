"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Rows that leave are
found by their place in the stage's input, so repeated rows and null
identifiers are safe. A stage's input must be a table scan, as run() makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.llm.bpe import digests
from crucible.llm.common import stage, table, unused, unused_prefix
from crucible.llm.exact_dedup import content_sort_dedup
from crucible.llm.mixing import mixed_documents
from crucible.llm.copies import near_copies
from crucible.llm.toxicity import judge


def _without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    return docs.join(dropped, row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    Null, empty and blank texts have no features and stay. Texts are read whole,
    repeated rows are judged alike, an empty table gives no rows. Without labels
    of both classes nothing is rejected. Columns keep their values whatever their names.
    """
    flag = unused(docs, "rejected")
    return judge(docs, table(spark, sf_dir, "labels"), prefix=unused_prefix(docs, "p_"), flag=flag).filter(~F.col(flag)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document of the largest identifier.

    A null text is an empty one, and one of all empty ones stays. A null
    identifier loses to any other; of rows that agree in text and identifier one
    stays. Texts are compared whole, an empty table gives no rows, and other
    columns keep their values whatever their names.
    """
    row = unused(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = content_sort_dedup(rows.select("doc_id", "text", row), carry=(row,))
    return _without(rows, found.filter(~F.col("kept")).select(row), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document of the smallest identifier.

    Null and empty texts are copies of each other, and so are short texts of
    equal words. A null identifier loses to any other; of rows that agree in
    identifier the first in the table stays. Texts are compared whole, an empty
    table gives no rows, and other columns keep their values whatever their names.
    """
    row = unused(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_copies(rows, row).select(F.col("row").alias("_r"), "label")
    of = stage(rows.select(F.col(row).alias("_r"), F.col("doc_id").alias("_id")).join(groups, "_r"), "near-groups")
    first = of.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_r"))["_r"].alias("_r"))
    return _without(rows, of.join(first, "_r", "left_anti").select(F.col("_r").alias(row)), row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, shard by shard: a document's row for each time that the mix takes it, its text cut where a quota ends.

    A null source is a source. Null, empty and blank texts have no words, so the
    mix takes nothing of them. Repeated rows are documents of their own. An empty
    table gives no rows; other columns than text and n_chars keep their values
    whatever their names.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to, a row for each row.

    Null and empty texts have no ids. Texts of any length are encoded whole;
    other columns are not read; an empty table gives no rows.
    """
    return digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classifier, SimHash, the mix and BPE cannot be written in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
