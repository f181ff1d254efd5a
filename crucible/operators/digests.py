"""A tree of digests over a table's rows: whether two tables hold the same rows, and where they differ.

A row's digest is the SHA-256 of its columns as a JSON object, columns in order
of name. Rows fall to leaves by the first digits of their digests, so a leaf's
rows are the same whatever the order, the files or the partitions of the table.
A leaf's digest is that of its distinct row digests and their numbers in order, a
node's that of its children, up to the root at level 0. Equal rows are counted
first and digests spread evenly, so with enough digits no leaf is large, however
often a row occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.tables import settled

#: Distinct rows of a leaf, about; digits at most (16 leaves for each more).
LEAF, MOST_DEPTH = 2048, 7


def depth_for(rows: int) -> int:
    """Digits that leave some LEAF rows to a leaf."""
    depth = 0
    while rows > LEAF * 16**depth and depth < MOST_DEPTH:
        depth += 1
    return depth


def row_digest(columns: list[str]) -> Column:
    """Nulls are written, so a null is another value than an absent one."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def row_digests(df: DataFrame) -> DataFrame:
    """(digest, n): the distinct rows and how often they occur."""
    return df.select(row_digest(df.columns).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


def digest_tree(df: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, prefix, row_count, digest) of every node; the root has level 0 and an empty prefix. An empty table has no nodes."""
    return _tree(row_digests(df), depth_for(df.count()) if depth is None else depth)


def _tree(digests: DataFrame, depth: int) -> DataFrame:
    joined = lambda x: F.sha2(F.array_join(F.sort_array(F.collect_list(x)), ","), 256).alias("digest")
    leaves = digests.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(F.sum("n").alias("row_count"), joined(F.concat_ws(":", "digest", F.col("n").cast("string"))))
    levels = [settled(leaves, "digest-leaves")]
    for level in range(depth - 1, -1, -1):
        below = levels[-1]
        levels.append(below.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(F.sum("row_count").alias("row_count"), joined(F.concat_ws("=", "prefix", "digest"))))
    return reduce(DataFrame.unionByName, (x.select(F.lit(depth - i).alias("level"), "prefix", "row_count", "digest") for i, x in enumerate(levels)))


def differing_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, prefix, a_rows, b_rows) of nodes of two trees of one depth whose digests differ or that only one has. No rows: the tables are equal."""
    left, right = (x.select("level", "prefix", F.col("row_count").alias(f"{n}_rows"), F.col("digest").alias(f"_{n}")) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, ["level", "prefix"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("level", "prefix", F.coalesce("a_rows", F.lit(0)).alias("a_rows"), F.coalesce("b_rows", F.lit(0)).alias("b_rows"))


def changed_rows(a: DataFrame, b: DataFrame, depth: int | None = None) -> DataFrame:
    """(side, times, the columns): rows that one table of the same columns has more often than the other, by so many times.

    Trees are compared first; only rows of differing leaves are compared with each other.
    """
    depth = depth_for(max(a.count(), b.count())) if depth is None else depth
    own = {side: settled(row_digests(df.select(*a.columns)), f"digests-{side}") for side, df in (("a", a), ("b", b))}
    leaves = settled(differing_nodes(*(_tree(x, depth) for x in own.values())).filter(F.col("level") == depth).select("prefix"), "differing-leaves")
    there = {side: x.withColumn("prefix", F.substring("digest", 1, depth)).join(leaves, "prefix", "left_semi").select("digest", F.col("n").alias(f"n_{side}")) for side, x in own.items()}
    more = F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))
    found = settled(there["a"].join(there["b"], "digest", "full").select("digest", more.alias("more")).filter("more <> 0"), "differing-rows")
    sides = []
    for side, df, wanted in (("a", a, "more > 0"), ("b", b, "more < 0")):
        rows = df.select(*a.columns).withColumn("_digest", row_digest(a.columns)).dropDuplicates(["_digest"])
        sides.append(rows.join(found.filter(wanted), F.col("_digest") == F.col("digest")).select(F.lit(side).alias("side"), F.abs("more").alias("times"), *(rows[c] for c in a.columns)))
    return sides[0].unionByName(sides[1])
