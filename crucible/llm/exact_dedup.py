"""Exact deduplication by content sort, with DataFrame operations only.

Sampled splitters range-partition the rows by their normalised content, the
external sort inside each range places equal texts next to each other, and the
window compares each full text with its neighbour's. The splitter key is the
text's first PREFIX_CHARS characters and its digest, so a sampled key has a
bounded size however long the texts are; rows of one range are sorted by their
whole text. Copies of one text lie in one range. Only where they are more than
1/MOST_HOT of all rows, a salt ends the key, so that splitters can fall among
them; the parts' first rows then meet once more, and are again compared by
their whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import ascii_lower, stage, table

PREFIX_CHARS = 128
#: A text with more than one in so many rows is hot; there are fewer hot texts than this.
MOST_HOT = 1024


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", salts: int = 64, carry: tuple[str, ...] = (), most_hot: int = MOST_HOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the columns of `carry` (small ones: they travel along).

    Identifiers may have any type that has an order. Null texts count as empty,
    and all empty texts form one group. Null identifiers lose to any other;
    where a group has no other, keep_id is null and one of its rows is kept. Of
    rows repeated with one identifier, one is kept. Texts are compared whole.
    Other columns of the input are not read, whatever their names; an empty
    table gives an empty result. docs must be a table scan or a staged table:
    hot rows are salted by their place in it.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    best, order = (F.max, F.col("_id").desc_nulls_last()) if keep == "largest" else (F.min, F.col("_id").asc_nulls_last())
    carried = [f"_c{i}" for i in range(len(carry))]
    norm = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)), F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"), F.monotonically_increasing_id().alias("_row"))
    # Few rows have one hash by chance: a salt too many does no harm.
    sizes = norm.groupBy(F.xxhash64("_norm").alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.filter("n > 1"), "content-sizes")
    total = docs.select(F.count(F.lit(1)).alias("n")).first().n
    hot = [r._h for r in sizes.filter(F.col("n") * most_hot > total).select("_h").limit(most_hot).collect()]
    is_hot = F.xxhash64("_norm").isin(hot) if hot else F.lit(False)
    keyed = norm.select(
        *carried, "_id", "_norm",
        F.substring("_norm", 1, PREFIX_CHARS).alias("_prefix"),
        F.sha2("_norm", 256).alias("_sha"),
        F.when(is_hot, F.pmod(F.xxhash64("_row"), F.lit(salts)) + 1).otherwise(0).cast("int").alias("_salt"),
    )
    ranged = keyed.repartitionByRange("_prefix", "_sha", "_salt")
    same = Window.partitionBy("_prefix", "_norm", "_sha", "_salt")  # sorts by the whole text
    parts = ranged.select(
        *carried, "_id", "_sha", "_salt",
        F.row_number().over(same.orderBy(order)).alias("_rank"),
        best("_id").over(same).alias("_best"),
        F.count(F.lit(1)).over(same).alias("_n"),
        "_norm",
    )
    head = (F.col("_salt") > 0) & (F.col("_rank") == 1)
    parts = parts.withColumn("_norm", F.when(head, F.col("_norm")))
    if not hot:
        out = parts.select(F.col("_id").alias(id_col), F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_rank") == 1).alias("kept"), F.col("_sha").alias("text_sha256"), *(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)))
        return out
    parts = stage(parts, "content-sort")
    # At most `salts` rows for each of fewer than most_hot texts; those of one text are compared by it.
    whole = Window.partitionBy("_sha", "_norm")
    place = F.row_number().over(whole.orderBy(F.col("_best").desc_nulls_last() if keep == "largest" else F.col("_best").asc_nulls_last(), "_salt"))
    groups = parts.filter(head).select("_sha", "_salt", best("_best").over(whole).alias("_all_best"), F.sum("_n").over(whole).alias("_all"), (place == 1).alias("_wins"))
    calm, salted = parts.filter("_salt = 0"), parts.filter("_salt > 0").join(F.broadcast(groups), ["_sha", "_salt"])
    columns = lambda best_id, n, wins: [
        F.col("_id").alias(id_col), best_id.alias("keep_id"), n.alias("group_size"), (wins & (F.col("_rank") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"),
        *(F.col(x).alias(c) for c, x in zip(carry, carried, strict=True)),
    ]
    return calm.select(columns(F.col("_best"), F.col("_n"), F.lit(True))).unionByName(salted.select(columns(F.col("_all_best"), F.col("_all"), F.col("_wins"))))


def op5_content_sort_dedup(spark, sf_dir):
    return content_sort_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
