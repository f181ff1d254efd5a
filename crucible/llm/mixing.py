"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in the order of a keyed hash, form a permuted stream of
words. The stream is cut into blocks of `block_words`. A source's target fixes
its quota of words and so of blocks (the last may be part of a block; beyond the
stream's end a second pass begins). A tree splits the block quotas of all
sources among the output shards: at each node the left half draws its share from
the quotas by the multivariate hypergeometric law. The blocks of a source are
permuted, and each shard draws its own range of that permutation, so shards are
disjoint. A document goes to the shard that draws the block in which it begins,
and a shard's documents are shuffled locally, by another keyed hash.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import WORD, spread_join, stage, table, unused

#: The weights by a source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, total_share: float = TOTAL_SHARE, most_times: float = MOST_TIMES) -> dict[str | None, float]:
    """Target words of each source: by weight, at most `most_times` its size, the excess shared out again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, out, active = total_share * sum(size.values()), {}, [s for s, _ in order]
    while active:
        whole = sum(weight[s] for s in active)
        above = [s for s in active if left * weight[s] / whole > most_times * size[s]]
        if not above:
            out |= {s: left * weight[s] / whole for s in active}
            break
        for s in above:
            out[s] = float(most_times * size[s])
        left -= sum(out[s] for s in above)
        active = [s for s in active if s not in out]
    return out


#: numpy draws from fewer than this many.
LARGE = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The number of good ones among n drawn without replacement.

    Beyond numpy's range the law is inverted: from its mode outward the ratios
    of neighbouring probabilities give all that are within 40 standard
    deviations, beyond which none is large enough to change the sum.
    """
    if not good + bad or n <= 0:
        return 0
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    whole = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = min(most, max(least, (n + 1) * (good + 1) // (whole + 2)))
    wide = 40 * int(np.sqrt(n / whole * good * (bad / whole) * ((whole - n) / max(1, whole - 1)))) + 64
    below, above = max(least, mode - wide), min(most, mode + wide)
    k = np.arange(below, above, dtype=np.float64)  # the ratio of the probabilities of k + 1 and k
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    upto = np.cumsum(np.exp(log - log[mode - below]))
    return below + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def splitting_tree(quotas: list[int], shards: int, seed: int = 42) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); the columns add up to the quotas, the rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(colors: np.ndarray, n: int) -> np.ndarray:
        """One colour after the other, each from what is left of all."""
        got, rest = np.zeros_like(colors), int(colors.sum())
        for i, c in enumerate(colors.tolist()):
            rest -= c
            if n <= 0:
                break
            got[i] = hypergeometric(rng, c, rest, n)
            n -= int(got[i])
        return got

    def split(lo: int, hi: int, colors: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = colors
            return
        mid, whole = (lo + hi) // 2, int(colors.sum())
        left = draw(colors, (whole * (mid - lo) + (hi - lo) // 2) // (hi - lo))
        split(lo, mid, left)
        split(mid, hi, colors - left)

    split(0, shards, np.array(quotas, dtype=np.int64))
    return out


def permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, c) so that block b of n stands at place (a b + c) mod n: a has no factor in common with n."""
    if n < 2:
        return 1, 0
    while True:
        a = int(rng.integers(1, 1 << 20))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n))


#: Parts of a shard in which its rows are numbered, as a power of two.
PART_BITS = 6
#: Sources, at most: their table comes to the driver. It is broadcast if they are few.
MOST_SOURCES, FEW_SOURCES = 2_000_000, 4096


@dataclass
class Mix:
    rows: DataFrame
    """id, source, size, source_size, target, quota, first, second (words taken in each pass), draws, key."""
    quotas: dict[str | None, int]
    tree: np.ndarray
    shards: int
    seed: int

    def placed(self, *carry: str) -> DataFrame:
        """The columns of `carry`, and pass, block, shard, taken, part, place: a row for each pass that takes words of a document. place numbers a shard's rows from 0 in its local shuffle; part grows with it."""
        drawn = self.rows.select(*carry, "key", F.explode("draws").alias("_d")).select(*carry, "key", "_d.*").withColumn("_o", F.xxhash64("key", "pass", "shard", F.lit(self.seed + 1)))
        drawn = stage(drawn.withColumn("part", F.shiftrightunsigned("_o", 64 - PART_BITS).cast("int")), "mix-drawn")
        cells = drawn.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("_n"))  # shards * 2 ** PART_BITS rows at most
        cells = cells.withColumn("_begin", F.sum("_n").over(Window.partitionBy("shard").orderBy("part")) - F.col("_n")).drop("_n")
        place = F.col("_begin") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("_o", "key")) - 1
        return drawn.join(F.broadcast(cells), ["shard", "part"]).withColumn("place", place).drop("_o", "_begin", "key")


def mix_sources(docs: DataFrame, shards: int = 16, block_words: int = 4096, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), few_sources: int = FEW_SOURCES) -> Mix:
    """What the mix takes from each document, and for which shard.

    `draws` lists (pass, block, shard, taken): in each pass that takes words of a
    document, the block of its source's stream in which it begins, the shard that
    draws this block, and the words taken, from the document's first on. A
    source's words add up to its target, rounded down to whole words; a document
    gives at most twice its size. The order comes from a hash of id, size and
    text, so reruns agree, and repeated rows may change places without changing
    the result. Null texts and empty ones have size 0 and give nothing; a null
    source is a source, and comes last. Columns other than the three and `carry`
    are not read; an empty table gives no rows. The table of sources comes to the
    driver, as the targets and draws do: it has a row for each named source, of
    which there may be MOST_SOURCES.
    """
    spark = docs.sparkSession
    base = docs.select(
        *(F.col(c).alias(f"_c_{c}") for c in carry),
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.col(id_col), F.lit(seed), F.col(text_col)).alias("_key"),
    )
    base = stage(base, "mix-rows")
    by = base.groupBy("_source", "_none").agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(by) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by.sort(key=lambda r: (r._none, r._source))
    name = [None if r._none else r._source for r in by]
    size = {s: r.w for s, r in zip(name, by, strict=True)}
    target = targets(list(size.items()))
    quota = {s: min(int(np.floor(t + 1e-9)), MOST_TIMES * size[s]) for s, t in target.items()}
    blocks = [-(-quota[s] // block_words) for s in name]
    tree = splitting_tree(blocks, shards, seed)
    upto, rng = tree.cumsum(axis=0), np.random.default_rng(seed)
    named = spark.createDataFrame(
        [(i, r._source, r._none, r.n, r.w, float(target[s]), quota[s], max(1, blocks[i]), *permutation(blocks[i], rng), upto[:, i].tolist()) for i, (s, r) in enumerate(zip(name, by, strict=True))],
        "_s int, _source string, _none boolean, _rows long, source_size long, target double, quota long, _blocks long, _a long, _c long, _upto array<long>",
    )
    # Buckets of some 250 rows: sums over buckets give each bucket's place in its source's stream.
    most = max([r.n for r in by], default=1)
    buckets = 1 << max(4, min(20, int(most / 250).bit_length()))
    if len(by) <= few_sources:
        joined = base.join(F.broadcast(named.drop("_rows")), ["_source", "_none"])
    else:
        joined = spread_join(base, named, ["_source", "_none"], "_rows", F.col("_key"))
    placed = joined.withColumn("_bucket", F.shiftrightunsigned(F.col("_key"), 64 - buckets.bit_length() + 1).cast("int"))
    bucket = Window.partitionBy("_s", "_bucket")
    sums = placed.groupBy("_s", "_bucket").agg(F.sum("_size").alias("_w"))
    begins = sums.select("_s", "_bucket", (F.sum("_w").over(Window.partitionBy("_s").orderBy("_bucket")) - F.col("_w")).alias("_begin"))
    inner = F.sum("_size").over(bucket.orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    streamed = placed.withColumn("_inner", inner).join(begins, ["_s", "_bucket"]).withColumn("_at", F.col("_begin") + F.col("_inner"))
    zero = F.lit(0).cast("long")
    first = F.greatest(zero, F.least(F.col("_size"), F.col("quota") - F.col("_at")))
    second = F.greatest(zero, F.least(F.col("_size"), F.col("quota") - F.col("source_size") - F.col("_at")))

    def draw(turn: int, start, taken):
        block = F.floor(start / F.lit(block_words).cast("long"))
        place = F.pmod(F.col("_a") * block + F.col("_c"), F.col("_blocks"))
        one = F.struct(F.lit(turn).alias("pass"), block.alias("block"), F.size(F.filter(F.col("_upto"), lambda u: u <= place)).alias("shard"), taken.alias("taken"))
        return F.when(taken > 0, F.array(one)).otherwise(F.array().cast("array<struct<pass:int,block:bigint,shard:int,taken:bigint>>"))

    rows = streamed.select(
        *(F.col(f"_c_{c}").alias(c) for c in carry),
        F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_source")).alias("source"), F.col("_size").alias("size"), "source_size", "target", "quota",
        first.alias("first"), second.alias("second"), F.col("_key").alias("key"),
        F.concat(draw(1, F.col("_at"), first), draw(2, F.col("_at") + F.col("source_size"), second)).alias("draws"),
    )
    return Mix(rows, quota, tree, shards, seed)


def op1_splitting_tree_mix(spark, sf_dir):
    """`shards` and `places` have an entry for each pass that takes words of the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.monotonically_increasing_id().alias("_row"))
    mix = mix_sources(docs, carry=("_row",))
    rows = stage(mix.rows, "mix-taken")
    mix.rows = rows
    where = mix.placed("_row").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "place"))).alias("_w"))  # two at most
    none = F.array()
    return rows.join(where, "_row", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), "source",
        F.coalesce(F.col("_w.shard"), none.cast("array<int>")).alias("shards"), F.coalesce(F.col("_w.place"), none.cast("array<long>")).alias("places"),
    )


def cut_words(text: str, upto: int) -> str:
    """The text up to the end of its first so many words."""
    end = 0
    for _, m in zip(range(upto), re.finditer(WORD, text), strict=False):
        end = m.end()
    return text[:end]


def mixed_documents(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """Rows of docs as the mix takes them: one for each pass that takes words of a document, with all its columns, shard by shard in the order of the local shuffles.

    A document in which a source's quota ends gives its first words; `n_chars`,
    if there is such a column, follows its text. Documents without words, of
    which the mix takes nothing, and those beyond the quotas give no row. Other
    columns go along unchanged, whatever their names. docs must be a table scan
    or a staged table: rows are numbered by their place in it.
    """
    row, size, taken, shard, part, place = (unused(docs, f"_mix_{n}") for n in ("row", "size", "taken", "shard", "part", "place"))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    mix = mix_sources(rows, text_col=text_col, carry=(row,), **params)
    turns = mix.placed(row, "size").select(row, *(F.col(a).alias(b) for a, b in (("size", size), ("taken", taken), ("shard", shard), ("part", part), ("place", place))))
    order = (shard, part, place)
    out = rows.join(turns, row)
    whole, cut_off = out.filter(F.col(taken) == F.col(size)).select(*docs.columns, *order), out.filter(F.col(taken) < F.col(size)).select(*docs.columns, *order, taken)
    at, chars = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for batch in batches:
            texts = [cut_words(t, n) for t, n in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array([len(t) for t in texts], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    both = whole.unionByName(cut_off.mapInArrow(cut, whole.schema))
    return both.repartition(shard, part).sortWithinPartitions(*order).select(*docs.columns)
