"""Nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by identifier. In a shard, equal vectors are one
node. Nodes join the graph in batches: a greedy beam search from the entry node
proposes neighbours, and robust pruning keeps the nearest, drops what is nearer
to it (relaxed by alpha) than to the node, and goes on: diverse edges stay. Edges
are also put in backwards, and full lists are pruned again. Queries beam-search
every shard and the best of all shards count. Searches of a batch advance
together, so each step is a few array operations.

Inner product becomes Euclidean distance through one more coordinate,
sqrt(M^2 - |v|^2), with M the largest norm of the shard; a query has 0 there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import stage, table

DEGREE = 32
BEAM_BUILD, BEAM_QUERY = 64, 160
ALPHA = 1.2
#: Shards: at least so many; more where one would hold more vectors than this.
SHARDS, SHARD_ROWS = 6, 25_000
#: Queries that are searched at once.
QUERY_BLOCK = 4096


def beam_search(vectors: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, lanes: int = 256):
    """For each query: the nearest `beam` nodes found (-1 where fewer) and squared distances, nearest first.

    Each step expands, in all lanes, the nearest node of the beam not yet
    expanded; a lane is done when its whole beam is expanded.
    """
    n = len(vectors)
    out_ids, out_dist = np.full((len(queries), beam), -1, dtype=np.int64), np.full((len(queries), beam), np.inf, dtype=np.float32)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    for at in range(0, len(queries), lanes):
        q = queries[at : at + lanes]
        m = len(q)
        seen = np.zeros((m, n + 1), dtype=bool)
        seen[:, n] = True  # the missing edge
        ids, dist = np.full((m, beam), n, dtype=np.int64), np.full((m, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        qn = np.einsum("ij,ij->i", q, q)
        ids[:, 0], dist[:, 0], open_[:, 0] = entry, norms[entry] + qn - 2 * (q @ vectors[entry]), True
        seen[:, entry] = True
        lane = np.arange(m)
        while len(lane):
            some = open_[lane]
            live = some.any(axis=1)
            lane, some = lane[live], some[live]
            if not len(lane):
                break
            pick = some.argmax(axis=1)  # the beam is sorted
            open_[lane, pick] = False
            near = edges[ids[lane, pick]]
            near = np.where(seen[lane[:, None], near], n, near)
            seen[lane[:, None], near] = True
            safe = np.minimum(near, n - 1)
            d = norms[safe] + qn[lane][:, None] - 2 * np.einsum("ijk,ik->ij", vectors[safe], q[lane])
            d = np.where(near < n, d, np.inf).astype(np.float32)
            all_d = np.concatenate([dist[lane], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[lane] = np.take_along_axis(all_d, order, axis=1)
            ids[lane] = np.take_along_axis(np.concatenate([ids[lane], near], axis=1), order, axis=1)
            fresh = np.concatenate([open_[lane], near < n], axis=1)
            open_[lane] = np.take_along_axis(fresh, order, axis=1) & (ids[lane] < n)
        ids[ids == n] = -1
        out_ids[at : at + m], out_dist[at : at + m] = ids, dist
    return out_ids, out_dist


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1: none): up to `degree` edges, each not nearer (times alpha) to an earlier one than to the point; -1 fills up."""
    n, out = len(vectors), np.full((len(points), degree), -1, dtype=np.int64)
    for at in range(0, len(points), 256):
        p, c = points[at : at + 256], np.sort(candidates[at : at + 256], axis=1)
        c = np.where((c == p[:, None]) | np.concatenate([np.zeros((len(p), 1), bool), c[:, 1:] == c[:, :-1]], axis=1), -1, c)
        v = vectors[np.maximum(c, 0)]
        d = np.where(c >= 0, ((v - vectors[p][:, None]) ** 2).sum(axis=2), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
        v = np.take_along_axis(v, order[:, :, None], axis=1)
        between = np.einsum("ijk,ilk->ijl", v, v)
        sq = np.einsum("ijk,ijk->ij", v, v)
        between = sq[:, :, None] + sq[:, None, :] - 2 * between
        alive, rows, filled = d < np.inf, np.arange(len(p)), np.zeros(len(p), dtype=np.int64)
        for _ in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            r = rows[has]
            k = alive[r].argmax(axis=1)
            out[at + r, filled[r]] = c[r, k]
            filled[r] += 1
            alive[r] &= alpha * alpha * between[r, k] > d[r]
            alive[r, k] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA, seed: int = 42):
    """(edges, entry): edges[i] are the neighbours of node i; len(vectors) stands for none. Every node can be reached from the entry."""
    n = len(vectors)
    edges = np.full((n, degree), n, dtype=np.int64)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]) if n else order
    for relax in (alpha,):
        done = 1
        while done < n:
            step = min(max(1, done), 512, n - done)
            new = order[done : done + step]
            found, _ = beam_search(vectors, edges, entry, vectors[new], beam)
            # Nodes of one batch do not see each other in the graph: they are candidates for each other.
            inner = ((vectors[new][:, None, :] - vectors[new][None, :, :]) ** 2).sum(axis=2) if step <= 64 else np.maximum(0, -2 * vectors[new] @ vectors[new].T + (vectors[new] ** 2).sum(1)[:, None] + (vectors[new] ** 2).sum(1)[None, :])
            near = new[np.argsort(inner, axis=1)[:, : min(step, 16)]]
            kept = robust_prune(vectors, new, np.concatenate([found, near], axis=1), degree, relax)
            edges[new] = np.where(kept >= 0, kept, n)
            back_to, back_from = kept.ravel(), np.repeat(new, degree)
            ok = back_to >= 0
            back_to, back_from = back_to[ok], back_from[ok]
            by = np.argsort(back_to, kind="stable")
            back_to, back_from = back_to[by], back_from[by]
            targets, begin = np.unique(back_to, return_index=True)
            count = np.diff(np.append(begin, len(back_to)))
            wide = int(count.max()) if len(count) else 0
            extra = np.full((len(targets), wide), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(targets)), count), np.arange(len(back_to)) - np.repeat(begin, count)] = back_from
            own = edges[targets]
            room = (own == n).sum(axis=1) >= count
            for i in np.flatnonzero(room).tolist():
                t = targets[i]
                fresh = np.setdiff1d(extra[i, : count[i]], own[i])  # nodes of one batch may have chosen each other
                free = np.flatnonzero(edges[t] == n)[: len(fresh)]
                edges[t, free] = fresh
            full = np.flatnonzero(~room)
            if len(full):
                kept = robust_prune(vectors, targets[full], np.concatenate([np.where(own[full] == n, -1, own[full]), extra[full]], axis=1), degree, relax)
                edges[targets[full]] = np.where(kept >= 0, kept, n)
            done += step
    return reachable(vectors, edges, entry, beam), entry


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    """Which nodes a walk from the entry can come to."""
    n = len(edges)
    seen = np.zeros(n + 1, dtype=bool)
    seen[[entry, n]] = True
    wave = np.array([entry])
    while len(wave):
        wave = np.unique(edges[wave])
        wave = wave[~seen[wave]]
        seen[wave] = True
    return seen[:n]


def reachable(vectors: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """The edges with some more, so that every node can be reached: pruning may have taken a node's last edge from elsewhere.

    Each lost node gets an edge from a near node that can be reached, the one
    with the fewest such edges of those that its search finds.
    """
    n, degree = len(vectors), edges.shape[1]
    if not n:
        return edges
    more: dict[int, list[int]] = {}
    while True:
        lost = np.flatnonzero(~reached(edges, entry))
        if not len(lost):
            return edges
        found, _ = beam_search(vectors, edges, entry, vectors[lost], min(beam, 16))
        for x, near in zip(lost.tolist(), found.tolist(), strict=True):
            host = min((h for h in near if h >= 0), key=lambda h: len(more.get(h, ())))
            more.setdefault(host, []).append(x)
        wide = max(map(len, more.values()))
        extra = np.full((n, wide), n, dtype=np.int64)
        for h, some in more.items():
            extra[h, : len(some)] = some
        edges = np.concatenate([edges[:, :degree], extra], axis=1)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (_id, _v) with an identifier whose vector is not null, finite in all components, not zero, and as long as most of these (of equally many the longer), as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).alias("_id"), v.alias("_v"))
    usual = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("_v") == (usual.d if usual else 0))


def packed(rows: DataFrame) -> DataFrame:
    """(_id, vector): the vectors as the bytes of their doubles."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(x, dtype=np.float64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["_id", "vector"])

    return rows.select("_id", "_v").mapInArrow(pack, f"_id {rows.schema['_id'].dataType.simpleString()}, vector binary")


def build_index(rows: DataFrame, shards: int, **params) -> DataFrame:
    """(shard, node, ids, vector, edges, entry) from rows (_id, _v): a row for each distinct vector of a shard; vector and edges are the bytes of doubles and of ints."""
    schema = "shard int, node int, ids array<long>, vector binary, edges binary, entry int"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        distinct, where = np.unique(np.stack([np.frombuffer(x, dtype=np.float64) for x in pdf.vector]), axis=0, return_inverse=True)
        where = where.ravel()
        by = np.argsort(where, kind="stable")
        ids = np.split(pdf._id.to_numpy()[by], np.cumsum(np.bincount(where))[:-1])
        sq = (distinct**2).sum(axis=1)
        lifted = np.concatenate([distinct, np.sqrt(np.maximum(0, sq.max() - sq))[:, None]], axis=1).astype(np.float32)
        edges, entry = build_graph(lifted, **params)
        return pd.DataFrame({"shard": int(pdf.shard.iloc[0]), "node": np.arange(len(distinct), dtype=np.int32), "ids": ids, "vector": [x.tobytes() for x in distinct], "edges": [x.tobytes() for x in edges.astype(np.int32)], "entry": np.int32(entry)})

    dealt = packed(rows).withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    # By range with a given number: each shard is a task of its own.
    return dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(build, schema)


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int = 20, beam: int = BEAM_QUERY) -> DataFrame:
    """(query_id, vec_id, score) with at most k rows of each shard for each query (_id, _v) but the query itself.

    A shard's graph comes to one task, which builds it once; the queries of the
    shard follow behind it and are searched block by block.
    """

    def search(batches):
        shard, nodes, graph, asked, held = None, [], None, [], 0

        def built():
            table = pa.Table.from_batches(nodes).sort_by("node")
            vectors = np.stack([np.frombuffer(x, dtype=np.float64) for x in table.column("vector").to_pylist()])
            edges = np.stack([np.frombuffer(x, dtype=np.int32) for x in table.column("edges").to_pylist()]).astype(np.int64)
            sq = (vectors**2).sum(axis=1)
            lifted = np.concatenate([vectors, np.sqrt(np.maximum(0, sq.max() - sq))[:, None]], axis=1).astype(np.float32)
            return vectors, lifted, edges, int(table.column("entry")[0].as_py()), sq.max(), table.column("ids").to_pylist()

        def answers():
            vectors, lifted, edges, entry, largest, ids = graph
            own = [i for b in asked for i in b.column("node").to_pylist()]
            q = np.stack([np.frombuffer(x, dtype=np.float64) for b in asked for x in b.column("vector").to_pylist()])
            unit = np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True) * np.sqrt(largest), np.zeros((len(q), 1))], axis=1).astype(np.float32)
            found, _ = beam_search(lifted, edges, entry, unit, beam)
            out = []
            for i, me in enumerate(own):
                near = found[i][found[i] >= 0]
                # Each row is summed by itself in one order, so equal vectors have equal scores in all shards.
                score = (vectors[near] * q[i]).sum(axis=1)
                got: list[tuple[float, int]] = []
                for node, s in zip(near.tolist(), score.tolist(), strict=True):
                    got += [(-s, x) for x in ids[node][: k + 1] if x != me][:k]
                got.sort()
                out += [(me, x, -s) for s, x in got[:k]]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            number, is_query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(is_query) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if number[a] != shard:
                    if held:
                        yield answers()
                    shard, nodes, graph, asked, held = number[a], [], None, [], 0
                if not is_query[a]:
                    nodes.append(batch.slice(a, b - a))
                elif nodes or graph:
                    if graph is None:
                        graph, nodes = built(), []
                    asked.append(batch.slice(a, b - a))
                    held += b - a
                    if held >= QUERY_BLOCK:
                        yield answers()
                        asked, held = [], 0
        if held:
            yield answers()

    none = lambda kind: F.lit(None).cast(kind)
    graphs = index.select("shard", F.lit(0).alias("asks"), F.col("node").cast("long").alias("node"), "ids", "vector", "edges", "entry")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), F.col("_id").cast("long").alias("node"), none("array<long>").alias("ids"), "vector", none("binary").alias("edges"), none("int").alias("entry"))
    # By range with a given number: each shard is a task of its own.
    met = graphs.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "asks")
    return met.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS, beam: int = BEAM_QUERY, **params) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row that is_query selects, among all other rows.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an identifier. Ties go to the smaller identifier.
    Rows repeated with one identifier count once for each vector of theirs.
    Vectors of another length than most take no part either. Other columns are
    not read; without rows there are no results. A shard holds about shard_rows
    vectors at most; its graph is read once, and all queries pass it.
    """
    rows = stage(valid_vectors(df, id_col, vector_col).dropDuplicates(["_id", "_v"]), "ann-rows")
    asked = rows.filter(is_query(F.col("_id")))
    shards = max(shards, -(-rows.count() // shard_rows))
    index = stage(build_index(rows, shards, **params), "ann-index")
    found = search_index(index, packed(asked), shards, k, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_pruned_graph(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
