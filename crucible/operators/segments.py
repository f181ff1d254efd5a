"""Sums, softmax and numbers over segments; vocabularies, pointers and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions.tables import with_running


def segment_sum(df: DataFrame, segment: str, vector: str) -> DataFrame:
    """(segment, vector): component sums."""
    sums = df.select(segment, F.posexplode(vector).alias("dim", "x")).groupBy(segment, "dim").agg(F.sum("x").alias("x"))
    return sums.groupBy(segment).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias(vector))


def segment_counts(df: DataFrame, segments: DataFrame, segment: str) -> DataFrame:
    """(segment, n) for all segments, at least 1 even for empty ones."""
    n = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    return segments.select(segment).distinct().join(n, segment, "left").select(segment, F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))


def segment_softmax(df: DataFrame, segment: str, score: str, name: str = "weight", least: float = 1e-12) -> DataFrame:
    """df with each score's share in its segment: exp(score - largest) over their sum.

    The largest and the sum come from aggregations, combined before the shuffle,
    that meet the rows in joins, whose skewed parts adaptive execution splits.
    """
    top = df.groupBy(segment).agg(F.max(score).alias("_top"))
    shifted = df.join(top, segment).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(segment).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, segment).withColumn(name, F.col("_e") / F.greatest("_sum", F.lit(least))).drop("_top", "_e", "_sum")


def vocabulary(df: DataFrame, value: str) -> DataFrame:
    """(value, index): distinct values in order, from 1; 0 is for missing ones."""
    return with_running(df.select(value).filter(F.col(value).isNotNull()).distinct(), [value])


def with_index(df: DataFrame, vocab: DataFrame, value: str, name: str = "index") -> DataFrame:
    """df with the value's number, 0 where it is missing or unknown."""
    return df.join(vocab.select(F.col(value).alias("_v"), F.col("index").alias("_i")), F.col(value) == F.col("_v"), "left").withColumn(name, F.coalesce("_i", F.lit(0))).drop("_v", "_i")


def pointers(df: DataFrame, group: str) -> DataFrame:
    """(group, n, begin, end): where each group's rows lie in the concatenation by group order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return with_running(sizes, [group], "_i", ("n", "end")).select(group, "n", (F.col("end") - F.col("n")).alias("begin"), "end")


def cumulative_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, share, cumulative) of a value's total, groups of largest total first."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole")).first().whole
    shares = sums.select(group, (F.col("total") / F.lit(whole)).alias("share"))
    return with_running(shares, [F.desc("share"), F.col(group)], "position", ("share", "cumulative"))


def split(df: DataFrame, id_col: str, fraction: float, seed: int = 42, limit: int | None = None) -> DataFrame:
    """(id, position, split): the first max(1, n * fraction) in hash order are validation, the others train; fraction 0: all train.

    `limit` takes the first of the order. It is an error if the fraction is not
    in [0, 1), if there are no rows, or if none is left for training.
    """
    if not 0 <= fraction < 1:
        raise ValueError(f"fraction must be in [0, 1), not {fraction}")
    order = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))), 256)
    placed = with_running(df.select(id_col, order.alias("_h")), ["_h", id_col], "position")
    placed = placed.filter(F.col("position") <= limit) if limit is not None else placed
    n = placed.count()
    validation = max(1, int(n * fraction)) if fraction else 0
    if not n or validation >= n:
        raise ValueError(f"{n} rows leave nothing to train on")
    return placed.select(id_col, "position", F.when(F.col("position") <= validation, "validation").otherwise("train").alias("split"))


def best_so_far(history: DataFrame, order: str, value: str) -> DataFrame:
    """history with whether each value is smaller than all before it; a training history has a row for each epoch."""
    before = F.min(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("is_best", before.isNull() | (F.col(value) < before))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1))
