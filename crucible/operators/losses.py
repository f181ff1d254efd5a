"""Losses over batches of vectors, as DataFrame aggregations. A batch is a group of rows; views are vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import dot


def variance_loss(df: DataFrame, batch: str, views: list[str], target: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """(batch, loss): mean over dimensions of what the deviation lacks to the target, averaged over the views."""
    out = None
    for v in views:
        std = df.select(batch, F.posexplode(v).alias("dim", "x")).groupBy(batch, "dim").agg(F.sqrt(F.var_pop("x") + eps).alias("s"))
        part = std.groupBy(batch).agg(F.avg(F.greatest(F.lit(target) - F.col("s"), F.lit(0.0))).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(batch).agg(F.avg("loss").alias("loss"))


def covariance_loss(df: DataFrame, batch: str, views: list[str]) -> DataFrame:
    """(batch, loss): squared covariances (n - 1) of different dimensions over the number of dimensions, averaged over the views. A batch, of training size, is one matrix product; null for a batch of one."""

    def of_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for v in views:
            m = np.stack(pdf[v].to_numpy()).astype(np.float64)
            c = m - m.mean(0)
            if len(m) > 1:
                cov = c.T @ c / (len(m) - 1)
                parts.append(((cov**2).sum() - (np.diag(cov) ** 2).sum()) / m.shape[1])
        return pd.DataFrame({batch: pdf[batch].iloc[:1], "loss": [float(np.mean(parts)) if parts else None]})

    return df.select(batch, *views).groupBy(batch).applyInPandas(of_batch, f"`{batch}` {df.schema[batch].dataType.simpleString()}, loss double")


def info_nce(df: DataFrame, batch: str, key: str, first: str, second: str, temperature: float = 0.1) -> DataFrame:
    """(batch, loss): symmetric cross entropy of each row's pair against all others of its batch. Batches are of training size."""
    a = df.select(batch, F.col(key).alias("i"), F.col(first).alias("a"))
    b = df.select(batch, F.col(key).alias("j"), F.col(second).alias("b"))
    logits = a.join(b, batch).select(batch, "i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("s"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))
    row = lambda k: logits.groupBy(batch, k).agg(F.max("s").alias("m"), own.alias("own"), F.collect_list("s").alias("all"))
    entropy = F.log(F.aggregate("all", F.lit(0.0), lambda x, s: x + F.exp(s - F.col("m")))) + F.col("m") - F.col("own")
    both = row("i").select(batch, entropy.alias("l")).unionByName(row("j").select(batch, entropy.alias("l")))
    return both.groupBy(batch).agg(F.avg("l").alias("loss"))


def binary_cross_entropy(logit, target):
    """Of one logit and one 0/1 target, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def label_loss(df: DataFrame, batch: str, logits: str, targets: str) -> DataFrame:
    """(batch, loss): mean binary cross entropy over all classes of the annotated rows; 0 where none is."""
    annotated = F.exists(targets, lambda t: t > 0)
    rows = df.withColumn("_on", annotated)
    parts = rows.filter("_on").select(batch, F.explode(F.arrays_zip(F.col(logits).alias("l"), F.col(targets).alias("t"))).alias("x")).select(batch, binary_cross_entropy(F.col("x.l"), F.col("x.t")).alias("l"))
    means = parts.groupBy(batch).agg(F.avg("l").alias("loss"))
    return rows.select(batch).distinct().join(means, batch, "left").select(batch, F.coalesce("loss", F.lit(0.0)).alias("loss"))


def total_loss(losses: dict[str, DataFrame], weights: dict[str, float], batch: str) -> DataFrame:
    """(batch, loss): the weighted sum; every loss needs a weight."""
    out = None
    for name, part in losses.items():
        one = part.select(batch, (F.col("loss") * float(weights[name])).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(batch).agg(F.sum("loss").alias("loss"))
