"""Exact cosine neighbours through pivots: only cells that can hold a nearer vector are compared.

Angles between vectors obey the triangle inequality. Vectors are dealt to the
cell of their nearest pivot, and of each cell the smallest and the largest angle
to its pivot are known. A vector first meets its own cell; the k-th best cosine
there is a lower bound of the k-th best of all. From its angle to another pivot
follows how near a member of that cell can be at best, and cells that stay below
the bound are not compared. How many do depends on the vectors: few where they
lie in clusters, nearly all where they lie evenly in many dimensions.

Pivots start from rows of the smallest hash and move to the mean direction of
their cells in a few rounds. They are at most MOST_PIVOTS, so what the driver
and the workers hold of them is bounded; cells are divided into blocks, and two
blocks and their products are what a task holds.

Beyond its own cell a vector is not sent to each cell that it asks: blocks of
queries read all cells one after another, and a task compares a cell with those
queries of its block that ask it. So what is shuffled grows with the number of
blocks, not with that of cells that are asked; a query's bound rises as it reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.tables import settled
from crucible.operators.similarity import LEAST_NORM, SLACK, Nearest, best_of, in_blocks

#: Vectors of a cell, about; pivots at most; rounds in which they move; vectors of a block.
CELL, MOST_PIVOTS, ROUNDS, BLOCK = 1024, 4096, 2, 4096
#: Vectors of a smaller norm than LEAST_NORM have a cell of their own.
SHORT = -1


def _matrix(column) -> np.ndarray:
    """A batch's vectors, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(m, axis=1)
    return m / np.maximum(norm, LEAST_NORM)[:, None], norm < LEAST_NORM


def _vectors(m: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def find_pivots(rows: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n directions (at most as many as rows) from rows (_id, _v): start rows, moved to the means of their cells."""
    start = rows.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(n).collect()  # n rows at most
    pivots, _ = _unit(np.array([r["_v"] for r in start], dtype=np.float64))

    def sums(batches, pivots):
        total, count = np.zeros(pivots.shape), np.zeros(len(pivots), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                u, _ = _unit(_matrix(batch.column(0)))
                cell = (u @ pivots.T).argmax(axis=1)
                np.add.at(total, cell, u)
                count += np.bincount(cell, minlength=len(pivots))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), _vectors(total[some])], names=["cell", "total"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf.cell[:1], "total": [np.sum(np.stack(pdf.total.to_numpy()), axis=0)]})

    for _ in range(rounds if len(pivots) > 1 else 0):
        found = rows.select("_v").mapInArrow(lambda b, p=pivots: sums(b, p), "cell long, total array<double>").groupBy("cell").applyInPandas(add, "cell long, total array<double>")
        pivots = pivots.copy()
        for r in found.collect():  # a row for each pivot at most
            mean, short = _unit(np.array([r.total]))
            if not short[0]:
                pivots[r.cell] = mean[0]
    return pivots


def _compare(k: int):
    """The k best candidates in b for each query in a; equal cosines by identifier. Cosines are summed alike whatever the blocks."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series(dtype=a._id.dtype), "neighbour": pd.Series(dtype=a._id.dtype), "cosine": pd.Series(dtype="float64")})
        nearest = Nearest(k, a._id.to_numpy(), np.stack(a._u.to_numpy()))
        nearest.meet(b._with.to_numpy(), np.stack(b._w.to_numpy()))
        q, j = np.nonzero(nearest.cosine > -np.inf)
        return pd.DataFrame({"query": nearest.ids[q], "neighbour": nearest.neighbour[q, j], "cosine": nearest.cosine[q, j]})

    return work


def reach(angle: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The largest cosine that a member of a cell (angles lo to hi to its pivot) can have to vectors at `angle` to that pivot."""
    gap = np.maximum(0.0, np.maximum(angle - hi, lo - angle))
    return np.cos(np.minimum(gap, np.pi)) + SLACK


def pivot_neighbours(df: DataFrame, k: int, id_col: str, vector_col: str, cell: int = CELL, block: int | None = None, queries: Column | None = None) -> DataFrame:
    """(query, rank, neighbour, cosine): for each row (or those that `queries` selects) the k other rows of largest cosine.

    Ties go to the smaller identifier. Norms are at least 1e-12, so a zero vector
    has cosine 0 to all. Rows without vector or identifier take no part;
    identifiers must be unique and vectors of one length. An empty table gives no
    rows. Zero vectors that ask meet every cell.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), (queries if queries is not None else F.lit(True)).alias("_asks")).filter("_id IS NOT NULL AND _v IS NOT NULL")
    kind, result = rows.schema["_id"].dataType.simpleString(), "query {0}, neighbour {0}, cosine double"
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "query {0}, rank int, neighbour {0}, cosine double".format(kind))
    pivots = find_pivots(rows, max(1, min(MOST_PIVOTS, n // cell)))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, short = _unit(_matrix(batch.column(1)))
            angle = _angles(u, pivots)
            at = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _vectors(u), batch.column(2), pa.array(np.where(short, SHORT, at).astype(np.int32)), pa.array(angle[np.arange(len(u)), at])], names=["_id", "_u", "_asks", "_cell", "_angle"])

    placed = settled(rows.mapInArrow(place, f"_id {kind}, _u array<double>, _asks boolean, _cell int, _angle double"), "neighbour-cells")
    # A row for each pivot: how many vectors a cell has, and between which angles.
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("lo"), F.max("_angle").alias("hi")).toPandas()
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)  # of empty cells: never asked
    some = cells[cells._cell != SHORT]
    lo[some._cell], hi[some._cell] = some.lo, some.hi
    has_short = bool((cells._cell == SHORT).any())
    c_parts = df.sparkSession.createDataFrame([(int(c), -(-int(x) // (block or BLOCK))) for c, x in zip(cells._cell, cells.n, strict=True)], "_cell int, _cn int")

    def met(asks: DataFrame) -> DataFrame:
        """asks (_id, _u, _cell) against all vectors of the cell, in blocks."""
        per = asks.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int").alias("_qn"))  # a row for each pivot
        sizes = F.broadcast(c_parts.join(per, "_cell"))
        numbers = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        own = lambda m: F.pmod(F.xxhash64("_id"), F.col(m)).cast("int")
        a = asks.join(sizes, "_cell").select("_id", "_u", "_cell", own("_qn").alias("_q"), numbers("_cn").alias("_c"))
        b = placed.join(sizes, "_cell").select(F.col("_id").alias("_with"), F.col("_u").alias("_w"), F.col("_cell").alias("_of"), own("_cn").alias("_part"), numbers("_qn").alias("_for"))
        return a.groupBy("_cell", "_q", "_c").cogroup(b.groupBy("_of", "_for", "_part")).applyInPandas(_compare(k), result.format(kind))

    asking = placed.filter("_asks").select("_id", "_u", "_cell")
    at_home = best_of(met(asking), k)
    if len(cells) == 1:
        return at_home
    at_home = settled(at_home, "neighbour-home")
    bars = at_home.filter(F.col("rank") == k).select(F.col("query").alias("_id"), F.col("cosine").alias("_bar"))

    class Asking(Nearest):
        def __init__(self, batch):
            bar = batch.column("_bar").to_numpy(zero_copy_only=False).astype(np.float64)
            super().__init__(k, batch.column("_id").to_numpy(zero_copy_only=False), _matrix(batch.column("_u")), np.where(np.isnan(bar), -np.inf, bar))
            self.home = batch.column("_cell").to_numpy()
            self.cell = self.angle = None

        def of(self, cell: int) -> np.ndarray:
            """Which queries ask a cell: not their own, and only if a member can reach the bar. Short vectors have no angle, so they ask all and all ask their cell."""
            apart = self.home != cell
            if cell == SHORT:
                return np.flatnonzero(apart)
            if cell != self.cell:
                self.cell, self.angle = cell, np.arccos(np.clip(self.units @ pivots[cell], -1.0, 1.0))
            return np.flatnonzero(apart & ((self.home == SHORT) | ~(reach(self.angle, lo[cell], hi[cell]) < self.bar)))

    def meet(nearest, batch):
        cell, ids, u = batch.column("_cell").to_numpy(), batch.column("_id").to_numpy(zero_copy_only=False), _matrix(batch.column("_u"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            asks = nearest.of(int(cell[x]))
            if len(asks):
                nearest.meet(ids[x:y], u[x:y], asks)

    with_bar = settled(asking.join(bars.hint("merge"), "_id", "left"), "neighbour-asks")  # a row for each query, whatever it asks
    others = placed.select("_id", "_u", "_cell", F.lit(None).cast("double").alias("_bar"))
    found = in_blocks(with_bar, others, with_bar.count(), n, pivots.shape[1], block, Asking, meet)
    return best_of(at_home.drop("rank").unionByName(found), k)
