"""Exact cosine neighbours in blocks, and how well neighbours agree on labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions.columns import label_tokens
from crucible.functions.tables import settled, with_running

LEVELS = ("1", "2", "3", "exact")
#: Bytes of a block of queries as doubles; what a task holds besides is a batch of candidates and some scores of a part of the block.
BLOCK_BYTES, SCORES = 1 << 25, 1 << 22
#: Products of a pair of blocks below which dividing more is not worth a task.
LEAST_WORK = 1 << 20
#: What blocks of a product may add to a cosine by rounding.
SLACK = 1e-9
LEAST_NORM = 1e-12


def batch_matrix(column) -> np.ndarray:
    """A batch's vectors as doubles; an error unless all have one length."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)


def exact_cosines(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of rows r of x with rows c of y, summed alike whatever the blocks."""
    return np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 65536]], y[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])


class Nearest:
    """The k nearest of each of a block's queries (unit vectors) among the candidates that pass; ties go to the smaller identifier.

    `bar` is what a cosine must reach to count from the start.
    """

    def __init__(self, k: int, ids: np.ndarray, units: np.ndarray, bar: np.ndarray | None = None):
        self.k, self.ids, self.units = k, ids, units
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()
        self.cosine, self.neighbour = np.full((len(ids), k), -np.inf), np.empty((len(ids), k), dtype=ids.dtype)

    def meet(self, ids: np.ndarray, units: np.ndarray, asks: np.ndarray | None = None) -> None:
        """Candidates against all queries, or those numbered in `asks`."""
        asks = np.arange(len(self.ids)) if asks is None else asks
        by_id = np.argsort(ids, kind="stable")
        in_order, step = ids[by_id], max(64, SCORES // max(1, len(ids)))
        for at in range(0, len(asks), step):
            own = asks[at : at + step]
            mine = self.units[own]
            s = mine @ units.T
            first, last = np.searchsorted(in_order, self.ids[own]), np.searchsorted(in_order, self.ids[own], side="right")
            for i in np.flatnonzero(last > first):
                s[i, by_id[first[i] : last[i]]] = -np.inf
            bar = self.bar[own]
            hit = (s >= (bar - SLACK)[:, None]) & (s > -np.inf)
            if hit.sum() > 2 * self.k * len(own):
                m = min(self.k, s.shape[1])
                bar = np.maximum(bar, s[np.arange(len(own)), np.argpartition(-s, m - 1, axis=1)[:, m - 1]] if m == self.k else -np.inf)
                hit &= s >= (bar - SLACK)[:, None]
            r, c = np.nonzero(hit)
            if len(r):
                self._keep(own, r, exact_cosines(mine, units, r, c), ids[c])

    def _keep(self, own, r, cosine, ids) -> None:
        some = np.unique(r)
        old_r, old_k = np.nonzero(self.cosine[own[some]] > -np.inf)
        old = own[some][old_r]
        r, cosine, ids = np.concatenate([some[old_r], r]), np.concatenate([self.cosine[old, old_k], cosine]), np.concatenate([self.neighbour[old, old_k], ids])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -cosine, r))
        r, cosine, ids = r[order], cosine[order], ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        at, place = own[r[keep]], place[keep]
        self.cosine[at, place], self.neighbour[at, place] = cosine[keep], ids[keep]
        full = own[some]
        self.bar[full] = np.maximum(self.bar[full], self.cosine[full, self.k - 1])

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        q, j = np.nonzero(self.cosine > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], kind), pa.array(self.neighbour[q, j], kind), pa.array(self.cosine[q, j])], names=["query", "neighbour", "cosine"])


def in_blocks(asking: DataFrame, asked: DataFrame, n_ask: int, n: int, dim: int, block: int | None, of_queries, meet) -> DataFrame:
    """(query, neighbour, cosine) that each block of queries finds in each part of the candidates (columns _id and more, `_v` the vector).

    asking and asked have the same columns, whose order `asked` may set within a
    part. A task holds its block of queries and reads its candidates batch by
    batch: of_queries(batch) makes a Nearest, meet(nearest, batch) adds candidates.
    A candidate is copied to n_ask / block tasks, a query to few.
    """
    block = block or max(1024, BLOCK_BYTES // (8 * max(1, dim)))
    tasks = max(1, min(3 * asking.sparkSession.sparkContext.defaultParallelism, n_ask * n // LEAST_WORK))
    q_blocks = max(1, -(-n_ask // block), round(tasks**0.5))
    c_parts = max(1, -(-tasks // q_blocks))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = asking.select("*", F.lit(0).alias("_side"), F.pmod(F.xxhash64("_id"), F.lit(q_blocks)).cast("int").alias("_q"), numbers(c_parts).alias("_c"))
    b = asked.select("*", F.lit(1).alias("_side"), numbers(q_blocks).alias("_q"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(c_parts)).cast("int").alias("_c"))
    pair = F.col("_q") * c_parts + F.col("_c")
    order = ["_pair", "_side", *(["_cell"] if "_cell" in asked.columns else [])]
    met = a.unionByName(b).withColumn("_pair", pair).drop("_q", "_c").repartitionById(q_blocks * c_parts, F.col("_pair")).sortWithinPartitions(*order)
    names, kind = met.columns, asked.schema["_id"].dataType.simpleString()

    def work(batches):
        pair = nearest = None
        held: list = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t.column("_pair").to_numpy() * 2 + t.column("_side").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if key[x] // 2 != pair:
                    if nearest is not None:
                        yield nearest.batch(batch.schema.field("_id").type)
                    pair, nearest, held = key[x] // 2, None, []
                part = batch.slice(x, y - x)
                if key[x] % 2 == 0:
                    held.append(part)
                    continue
                if nearest is None and held:
                    nearest, held = of_queries(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                if nearest is not None:
                    meet(nearest, part)
        if nearest is not None:
            yield nearest.batch(batch.schema.field("_id").type)

    return met.select(*names).mapInArrow(work, f"query {kind}, neighbour {kind}, cosine double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def compact(vector: Column, df: DataFrame) -> Column:
    """Vectors of floats as they are, others as doubles."""
    return vector if df.select(vector.alias("v")).schema["v"].dataType.simpleString() == "array<float>" else vector.cast("array<double>")


def exact_neighbours(df: DataFrame, k: int, id_col: str, vector_col: str, block: int | None = None, queries: Column | None = None) -> DataFrame:
    """(query, rank, neighbour, cosine): for each row (or those that `queries` selects) the k other rows of largest cosine.

    All pairs are compared: a task holds one block of queries (`block` rows, by
    default 32 MB) and reads a part of the candidates batch by batch, in double
    precision, and keeps k of each query. Ties go to the smaller identifier. Norms
    are at least 1e-12. Rows without vector or identifier take no part.

    The work grows with the square of the rows, what is shuffled with the square
    over the rows of a block: for some millions of rows at most. Beyond, ask with
    `queries`, or use the graph search of the subpackage llm, which is not exact.
    """
    asks = queries if queries is not None else F.lit(True)
    rows = df.select(F.col(id_col).alias("_id"), compact(F.col(vector_col), df).alias("_v"), asks.alias("_asks")).filter("_id IS NOT NULL AND _v IS NOT NULL")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_asks").alias("asks"), F.max(F.size("_v")).alias("dim")).first()
    unit = lambda batch: (m := batch_matrix(batch.column("_v"))) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), LEAST_NORM)
    ids = lambda batch: batch.column("_id").to_numpy(zero_copy_only=False)
    found = in_blocks(rows.filter("_asks").select("_id", "_v"), rows.select("_id", "_v"), size.asks, size.n, size.dim or 1, block, lambda b: Nearest(k, ids(b), unit(b)), lambda nearest, b: nearest.meet(ids(b), unit(b)))
    return best_of(found, k)


def token_rows(labels: DataFrame, id_col: str, labels_col: str, levels=LEVELS) -> DataFrame:
    """(level, id, tokens) for annotated rows at each level."""
    at = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.array_sort(label_tokens(F.col(labels_col), v)).alias("tokens")) for v in levels)))
    return labels.select(F.col(id_col).alias("id"), at.alias("x")).select("x.level", "id", "x.tokens").filter(F.size("tokens") > 0)


def match_counts(tokens: DataFrame) -> DataFrame:
    """(level, id, matches): other rows that share a token; each id occurs once at a level.

    Rows with the same tokens are one list. Rows of one token are added up; they
    cannot be counted twice. Rows of several tokens are numbered, and each token
    has a bitmap of theirs: a list's union of bitmaps counts each row once. So no
    rows are paired, whatever lists share, and what a list costs is a bit for
    each row of several tokens.
    """
    tokens = settled(tokens, "token-rows")
    lists = tokens.groupBy("level", "tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("token", F.explode("tokens"))
    alone = lists.filter(F.size("tokens") == 1).select("level", "token", F.col("n").alias("alone"))
    several = with_running(tokens.filter(F.size("tokens") > 1), ["level", "id"], "_n").select("level", F.explode("tokens").alias("token"), "_n")
    bitmaps = settled(several.groupBy("level", "token", F.bitmap_bucket_number("_n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bits")), "token-bitmaps")
    together = lists.join(bitmaps, ["level", "token"]).groupBy("level", "tokens", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    together = together.groupBy("level", "tokens").agg(F.sum(F.bitmap_count("bits")).alias("together"))
    added = lists.join(alone, ["level", "token"], "left").groupBy("level", "tokens").agg(F.sum(F.coalesce("alone", F.lit(0))).alias("alone"))
    total = added.join(together, ["level", "tokens"], "left").select("level", "tokens", (F.col("alone") + F.coalesce("together", F.lit(0)) - 1).alias("matches"))
    return tokens.join(total, ["level", "tokens"]).select("level", "id", "matches")


def no_hit(candidates: Column, matches: Column, k: int) -> Column:
    """The probability that k draws without replacement meet none of the matches."""
    one = lambda p, d: p * (candidates - matches - d) / (candidates - d)
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), one)


def retrieval_metrics(neighbours: DataFrame, labels: DataFrame, id_col: str, labels_col: str, ks=(1, 5, 10), levels=LEVELS) -> DataFrame:
    """For each level and k: precision and hit rate of neighbours over annotated queries, what random draws would give, and the lift.

    Candidates are all rows, annotated or not; a neighbour without labels never matches.
    """
    tokens = token_rows(labels, id_col, labels_col, levels)
    candidates = F.lit(float(labels.count() - 1))
    pairs = neighbours.select("query", "rank", "neighbour").join(tokens.select("level", F.col("id").alias("query"), F.col("tokens").alias("a")), "query")
    pairs = pairs.join(tokens.select("level", F.col("id").alias("neighbour"), F.col("tokens").alias("b")), ["level", "neighbour"], "left")
    hits = pairs.select("level", "query", "rank", F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)).cast("int").alias("hit"))
    by_k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    own = hits.select("*", by_k).filter("rank <= k").groupBy("level", "k", "query").agg(F.sum("hit").alias("n"), F.max("hit").alias("any"))
    found = own.groupBy("level", "k").agg(F.sum("n").alias("n"), F.sum("any").alias("any"))
    m = F.col("matches").cast("double")
    chance = match_counts(tokens).groupBy("level").agg(
        F.count(F.lit(1)).alias("annotated_query_count"), F.avg(m / candidates).alias("random_precision"),
        *(F.avg(1.0 - no_hit(candidates, m, k)).alias(f"_r{k}") for k in ks),
    )
    chance = chance.select("level", "annotated_query_count", "random_precision", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_r{k}").alias("random_hit_rate")) for k in ks))).alias("x")).select("*", "x.k", "x.random_hit_rate").drop("x")
    n = F.col("annotated_query_count")
    out = chance.join(found, ["level", "k"], "left").withColumn("precision", F.coalesce("n", F.lit(0)) / (n * F.col("k")))
    return out.select("level", "k", "annotated_query_count", "precision", (F.coalesce("any", F.lit(0)) / n).alias("hit_rate"), "random_precision", "random_hit_rate", F.when(F.col("random_precision") != 0, F.col("precision") / F.col("random_precision")).alias("lift"))


def compare_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tables of retrieval_metrics side by side: precision and hit rate of both and their differences, by level and k."""
    a = first.select("level", "k", F.col("precision").alias("first_precision"), F.col("hit_rate").alias("first_hit_rate"))
    b = second.select("level", "k", F.col("precision").alias("second_precision"), F.col("hit_rate").alias("second_hit_rate"))
    both = a.join(b, ["level", "k"])
    return both.withColumn("precision_delta", F.col("second_precision") - F.col("first_precision")).withColumn("hit_rate_delta", F.col("second_hit_rate") - F.col("first_hit_rate"))


def paired_top1(first: DataFrame, second: DataFrame, labels: DataFrame, id_col: str, labels_col: str, levels=LEVELS) -> DataFrame:
    """Two neighbour tables compared on the queries' nearest: mean difference (second - first) with a normal 95 % interval, wins, losses, ties."""
    tokens = token_rows(labels, id_col, labels_col, levels)

    def agree(neighbours: DataFrame, name: str) -> DataFrame:
        top = neighbours.filter("rank = 1").select(F.col("query").alias("id"), "neighbour")
        other = tokens.select("level", F.col("id").alias("neighbour"), F.col("tokens").alias("b"))
        return tokens.join(top, "id").join(other, ["level", "neighbour"], "left").select("level", "id", F.coalesce(F.arrays_overlap("tokens", "b"), F.lit(False)).cast("double").alias(name))

    d = agree(first, "x").join(agree(second, "y"), ["level", "id"]).withColumn("d", F.col("y") - F.col("x"))
    error = 1.96 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    return d.groupBy("level").agg(
        F.count(F.lit(1)).alias("annotated_query_count"), F.avg("x").alias("first_precision"), F.avg("y").alias("second_precision"), F.avg("d").alias("delta"),
        (F.avg("d") - error).alias("low"), (F.avg("d") + error).alias("high"),
        F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), F.count_if(F.col("d") == 0).alias("unchanged"),
    )


def evaluation_mode(ids: DataFrame, train: DataFrame, validation: DataFrame) -> str:
    """"transductive" if training and validation cover all ids (column id), "holdout" if some are left; an error if they hold others."""
    known = train.select("id").unionByName(validation.select("id")).distinct()
    if known.join(ids, "id", "left_anti").head(1):
        raise ValueError("the split holds identifiers that the table lacks")
    return "holdout" if ids.join(known, "id", "left_anti").head(1) else "transductive"
