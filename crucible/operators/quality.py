"""Vector tables: norms, spectrum, collapse, duplicates and where they come from."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions.columns import all_finite, cosine, norm
from crucible.functions.tables import settled, with_running

#: Thresholds of the collapse report.
CRITERIA = {"effective_rank_min": 20.0, "top1_max": 0.5, "top10_max": 0.95, "zero_variance_max": 0, "random_cosine_std_min": 0.01, "unexplained_duplicates_max": 0}


def norm_stats(df: DataFrame, vector_col: str) -> DataFrame:
    """One row: how many vectors, how many with non-finite components, and min, max, mean and population deviation of the norms."""
    v = F.col(vector_col).cast("array<double>")
    n = norm(v)
    return df.select(n.alias("n"), all_finite(v).alias("ok")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("ok")).alias("non_finite_count"),
        F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"),
    )


def dimension_stats(df: DataFrame, vector_col: str) -> DataFrame:
    """(dim, mean, std): population statistics of each component. Each partition adds up its own rows; what is shuffled has a row for each partition and component."""
    import pyarrow as pa

    def add(batches):
        n, mean, off = 0, None, None  # off: the sum of squares about the mean
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x is not None]
            if not rows:
                continue
            m = np.array(rows, dtype=np.float64)
            k, own = len(m), m.mean(0)
            part = ((m - own) ** 2).sum(0)
            if n:
                d = own - mean
                mean, off = mean + d * (k / (n + k)), off + part + d * d * (n * k / (n + k))
            else:
                mean, off = own, part
            n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(np.full(len(mean), n)), pa.array(mean), pa.array(off)], names=["dim", "n", "m", "s"])

    parts = df.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(add, "dim int, n long, m double, s double")
    whole = parts.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("s").alias("within"), F.collect_list(F.struct("n", "m")).alias("all"))
    between = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean")))
    return whole.select("dim", "mean", F.sqrt((F.col("within") + between) / F.col("n")).alias("std"))


def exact_quantiles(df: DataFrame, value: str, shares, count: str | None = None) -> dict[float, float | None]:
    """The linearly interpolated quantiles of a column, without its nulls.

    Equal values are counted first, so a value counts as one row however often it
    occurs; the values are range-partitioned and their numbers added up, and
    those that hold the ranks next to each share are picked, two for each.
    `count` names a column that says how many rows each stands for.
    """
    rows = df.select(value, (F.col(count) if count else F.lit(1)).alias("_c")).filter(F.col(value).isNotNull())
    counts = settled(rows.groupBy(value).agg(F.sum("_c").alias("_n")), "value-counts")
    placed = with_running(counts, [value], "_i", ("_n", "_last"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not n:
        return dict.fromkeys(shares)
    at = {p: p * (n - 1) for p in shares}
    need = sorted({int(f(h)) + 1 for h in at.values() for f in (math.floor, math.ceil)})
    holds = F.filter(F.array(*map(F.lit, need)), lambda r: (r <= F.col("_last")) & (r > F.col("_last") - F.col("_n")))
    got = {r["_rank"]: float(r[value]) for r in placed.select(value, F.explode(holds).alias("_rank")).collect()}
    low = {p: got[int(math.floor(h)) + 1] for p, h in at.items()}
    return {p: low[p] + (h - math.floor(h)) * (got[int(math.ceil(h)) + 1] - low[p]) for p, h in at.items()}


def quantiles(df: DataFrame, value: str, shares=(0.05, 0.5, 0.95, 0.99), thresholds=()) -> DataFrame:
    """One row: min, mean, max, population deviation, exact linearly interpolated quantiles, and counts at or above thresholds."""
    name = lambda p: f"p{round(p * 100):02d}"
    df = settled(df.select(value), "values")  # read by the ranks and by the sums
    at = exact_quantiles(df, value, shares)
    return df.agg(
        F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"),
        *(F.lit(at[p]).cast("double").alias(name(p)) for p in shares),
        *(F.count_if(F.col(value) >= t).alias(f"count_ge_{str(t).replace('.', '_')}") for t in thresholds),
    )


def covariance_sums(df: DataFrame, vector_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter matrix): each partition adds up its own rows by blocks; what comes to the driver has d * d numbers for each partition's row."""
    import pyarrow as pa

    def add(batches):
        n, s, ss = 0, None, None
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x is not None]
            if not rows:
                continue
            m = np.array(rows, dtype=np.float64)
            n += len(m)
            s, ss = (m.sum(0), m.T @ m) if s is None else (s + m.sum(0), ss + m.T @ m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s) + 1)), pa.array([np.append(x, n).tolist() for x in [s, *ss]])], names=["i", "v"])

    parts = df.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(add, "i long, v array<double>")
    rows = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r.i for r in rows), default=0)
    m = np.zeros((d + 1, d + 1))
    for r in rows:
        m[r.i, r.j] = r.x
    n = int(round(m[0, d])) if d else 0
    mean = m[0, :d] / max(1, n)
    return n, mean, m[1:, :d] - n * np.outer(mean, mean)


def spectrum(df: DataFrame, vector_col: str) -> DataFrame:
    """(component, eigenvalue, ratio, cumulative) of the covariance (n - 1), largest first."""
    n, _, scatter = covariance_sums(df, vector_col)
    values = np.sort(np.linalg.eigvalsh(scatter / max(1, n - 1)))[::-1].clip(min=0) if n else np.zeros(0)
    ratio = values / values.sum() if values.sum() else values
    rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(values, ratio, np.cumsum(ratio), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, ratio double, cumulative double")


def rank_measures(values: np.ndarray) -> dict[str, float]:
    """Effective rank exp(entropy), participation ratio, components for 90 % of the variance, numerical rank (singular values over 1e-6 of the largest)."""
    total = values.sum()
    if not total:
        return {"effective_rank": 0.0, "participation_ratio": 0.0, "components_90": 0, "numerical_rank": 0}
    r = values / total
    positive = r[r > 0]
    single = np.sqrt(values)
    return {
        "effective_rank": float(math.exp(-(positive * np.log(positive)).sum())),
        "participation_ratio": float(total**2 / (values**2).sum()),
        "components_90": int(np.searchsorted(np.cumsum(r), 0.9) + 1),
        "numerical_rank": int((single > single.max() * 1e-6).sum()),
    }


def random_pairs(df: DataFrame, id_col: str, vector_col: str, n_pairs: int = 200_000, seed: int = 42) -> DataFrame:
    """(first, second, cosine) of seeded pairs of different rows; a row drawn with itself takes the next one.

    The pairs are drawn by place in identifier order and meet their vectors in
    two joins; their number is a parameter, not the table's size.
    """
    rows = with_running(df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")), ["_id"], "_n")
    n = rows.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], f"first {rows.schema['_id'].dataType.simpleString()}, second {rows.schema['_id'].dataType.simpleString()}, cosine double")
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, size=n_pairs), rng.integers(0, n, size=n_pairs)
    b = np.where(a == b, (b + 1) % n, b)
    import pandas as pd

    pairs = df.sparkSession.createDataFrame(pd.DataFrame({"a": a + 1, "b": b + 1}))
    left, right = rows.select(F.col("_n").alias("a"), F.col("_id").alias("first"), F.col("_v").alias("va")), rows.select(F.col("_n").alias("b"), F.col("_id").alias("second"), F.col("_v").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("first", "second", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def collapse_report(df: DataFrame, id_col: str, vector_col: str, unexplained: int | None = None, n_pairs: int = 200_000) -> DataFrame:
    """One row: rank measures, shares of the first components, spread of random cosines, duplicates, the six criteria and whether all hold."""
    parts = spectrum(df, vector_col).collect()  # a row for each dimension
    values = np.array([r.eigenvalue for r in parts])
    cumulative = [r.cumulative for r in parts]
    dims = dimension_stats(df, vector_col).agg(F.count_if(F.col("std") < 1e-8).alias("z"), F.min("std").alias("min"), F.median("std").alias("median")).first()
    dup = duplicate_excess(df, vector_col).first()
    spread = random_pairs(df, id_col, vector_col, n_pairs).agg(F.avg("cosine").alias("m"), F.stddev_pop("cosine").alias("s")).first()
    m = rank_measures(values)
    unexplained = dup.duplicate_excess if unexplained is None else unexplained
    top = lambda k: float(cumulative[min(k, len(cumulative)) - 1]) if cumulative else 0.0
    checks = {
        "effective_rank_ok": m["effective_rank"] >= CRITERIA["effective_rank_min"], "top1_ok": top(1) < CRITERIA["top1_max"], "top10_ok": top(10) < CRITERIA["top10_max"],
        "zero_variance_ok": dims.z <= CRITERIA["zero_variance_max"], "random_cosine_ok": (spread.s or 0.0) > CRITERIA["random_cosine_std_min"], "duplicates_ok": unexplained <= CRITERIA["unexplained_duplicates_max"],
    }
    row = {**m, "top1": top(1), "top10": top(10), "top50": top(50), "dimension_std_min": dims.min, "dimension_std_median": dims.median, "zero_variance_count": dims.z, "duplicate_excess": dup.duplicate_excess, "random_cosine_mean": spread.m, "random_cosine_std": spread.s, **checks, "passed": all(checks.values())}
    return df.sparkSession.createDataFrame([row])


# duplicates


def bit_key(vector: Column) -> Column:
    """A text that is equal for vectors of equal components only, telling -0.0 from 0.0."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), ",", "null")


def duplicate_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(key, group_size, first_id) of keys with several rows."""
    return df.select(key.alias("key"), F.col(id_col).alias("id")).groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("first_id")).filter("group_size > 1")


def numbered_groups(groups: DataFrame, size: str = "group_size", first: str = "first_id") -> DataFrame:
    """groups with group_id, their number from 1 in order of size, the largest first, then of the first member."""
    return with_running(groups, [F.desc(size), F.col(first)], "group_id")


def duplicate_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))


def duplicate_excess(df: DataFrame, vector_col: str, numeric: bool = True) -> DataFrame:
    """One row: rows, distinct vectors and the excess; by value (numeric) or by bits."""
    key = F.col(vector_col) if numeric else bit_key(F.col(vector_col))
    groups = df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_excess"))


def diagnose(df: DataFrame, id_col: str, key: Column, signatures: dict[str, Column], flags: dict[str, Column], count: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, summary) of rows with equal keys: whether their inputs' signatures are equal, and which flags any of them has. `count` names a column that says how many rows each stands for (members stay as they are)."""
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), (F.col(count) if count else F.lit(1)).cast("long").alias("_n"), *(c.alias(f"sig_{n}") for n, c in signatures.items()), *(c.alias(f"has_{n}") for n, c in flags.items()))
    groups = rows.groupBy("key").agg(
        F.sum("_n").alias("group_size"), F.min("id").alias("first_id"),
        *((F.min(f"sig_{n}").eqNullSafe(F.max(f"sig_{n}"))).alias(f"same_{n}") for n in signatures),
        *(F.max(f"has_{n}").alias(f"has_{n}") for n in flags),
    ).filter("group_size > 1")
    members = rows.drop("_n").join(groups.select("key", "group_size", "first_id"), "key")
    excess = F.col("group_size") - 1
    summary = groups.agg(
        F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(excess), F.lit(0)).alias("excess"),
        *(F.count_if(F.col(f"same_{n}")).alias(f"groups_same_{n}") for n in signatures),
        *(F.coalesce(F.sum(F.when(F.col(f"same_{n}"), excess)), F.lit(0)).alias(f"excess_same_{n}") for n in signatures),
        *(F.count_if(F.col(f"has_{n}")).alias(f"groups_with_{n}") for n in flags),
    )
    return members, groups, summary


def shared_identities(parts: DataFrame, text: str, identity: str) -> DataFrame:
    """(text, identity_count) of canonical texts that several identities have."""
    return parts.groupBy(text).agg(F.count_distinct(identity).alias("identity_count")).filter("identity_count > 1")


def global_top(pairs: DataFrame, score: str, n: int = 20, ties=()) -> DataFrame:
    return pairs.orderBy(F.desc(score), *ties).limit(n)


def monotone_violations(ranked: DataFrame, by: str, rank: str, score: str, expected: int) -> DataFrame:
    """One row of counts: rows whose rank does not follow the one before, whose score exceeds it, and queries without the expected number of rows."""
    w = Window.partitionBy(by).orderBy(rank)
    rows = ranked.withColumn("_r", F.lag(rank).over(w)).withColumn("_s", F.lag(score).over(w))
    per = rows.groupBy(by).agg(F.count_if(F.col(rank) != F.coalesce(F.col("_r"), F.lit(0)) + 1).alias("r"), F.count_if(F.col(score) > F.col("_s")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("r").alias("rank_violations"), F.sum("s").alias("score_violations"), F.count_if(F.col("n") != expected).alias("incomplete_queries"))


def stage_uniqueness(stages: DataFrame, group: str, names: list[str], count: str | None = None) -> DataFrame:
    """For each group: distinct vectors and the largest range over components at each stage, and the first stage with one vector.

    A row's stages become rows, which equal vectors leave once (each task combines
    its own first), so a large group is divided by its vectors. What is left of a
    group is combined to one minimum and one maximum for each stage and component.
    Vectors of a stage have one length and finite components; none is null.
    `count` names a column that says how many rows each stands for.
    """
    each = F.posexplode(F.array(*(F.col(n).cast("array<double>") for n in names))).alias("_stage", "_vector")
    distinct = stages.select(group, (F.col(count) if count else F.lit(1)).alias("_c"), each).groupBy(group, "_stage", "_vector").agg(F.sum("_c").alias("_n")).withColumn("_dense", array_to_vector("_vector"))
    at = lambda i: F.col("_stage") == i
    bounds = [Summarizer.metrics("min", "max").summary(F.col("_dense"), F.when(at(i), 1.0).otherwise(0.0)).alias(f"_{n}") for i, n in enumerate(names)]
    per = distinct.groupBy(group).agg(F.sum(F.when(at(0), F.col("_n"))).alias("group_size"), *(F.count_if(at(i)).alias(f"{n}_unique") for i, n in enumerate(names)), *bounds)
    span = lambda n: F.array_max(F.zip_with(vector_to_array(F.col(f"_{n}")["max"]), vector_to_array(F.col(f"_{n}")["min"]), lambda a, b: a - b))
    first = F.coalesce(*(F.when(F.col(f"{n}_unique") == 1, F.lit(n)) for n in names), F.lit("not_exact_before_output"))
    return per.select(group, "group_size", *(f"{n}_unique" for n in names), *(span(n).alias(f"{n}_range") for n in names), first.alias("first_collapsed"))
