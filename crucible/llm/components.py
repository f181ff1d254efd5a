"""Connected components by alternating large-star and small-star steps, each a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import discard, stage

#: A node with more than one in so many edges is a hub; there are at most twice as many hubs.
MOST_HUBS = 1024
#: Edges from which hubs are looked for.
MANY_EDGES = 100_000


def _with_fact(edges: DataFrame, facts: DataFrame, hubs: list) -> DataFrame:
    """edges joined with facts on u; the hubs' facts, few rows, go to the edges, so no task gets all edges of a hub."""
    if not hubs:
        return edges.join(facts, "u")
    hub = F.col("u").isin(hubs)
    return edges.filter(~hub).join(facts.filter(~hub), "u").unionByName(edges.filter(hub).join(F.broadcast(facts.filter(hub)), "u"))


def connected_components(links: DataFrame, most_rounds: int = 60, many_edges: int = MANY_EDGES) -> DataFrame:
    """(node, label) for each node of links (src, dst): label is the component's smallest node.

    Large-star joins each node's larger neighbours to its smallest neighbour;
    small-star does so for the smaller ones and itself. Both keep components and
    end in stars. Each round is a pass over the links, of which a round never
    makes more; rounds grow with the logarithm of a component's size. Of fewer
    than many_edges edges a task may get all: there a step is a window, which takes
    one shuffle and no broadcast through the driver.
    """
    of_u = Window.partitionBy("u")

    def hubs_of(edges: DataFrame, n: int) -> list:
        return [r.u for r in edges.groupBy("u").count().filter(F.col("count") * MOST_HUBS > n).select("u").limit(2 * MOST_HUBS).collect()]

    edges, was = stage(links.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc-0"), None
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for i in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if n < many_edges:
            large = both.withColumn("m", F.least(F.min("v").over(of_u), "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            met = large.withColumn("m", F.min("v").over(of_u))
        else:
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = stage(_with_fact(both.filter("v > u"), least, hubs_of(both, n)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"cc-{i}-large")
            met = _with_fact(large, large.groupBy("u").agg(F.min("v").alias("m")), hubs_of(large, n))
        small = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = stage(small, f"cc-{i + 1}")
        now = after.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        if n >= many_edges:
            discard(large)
        edges, n = after, now[0]
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
