"""Spelling variants: words one edit apart, by a rare-first prefix filter of positional bigrams.

A word of L characters has L - 1 positional bigrams (bigram, place). One
inserted, deleted or replaced character spoils at most two of them on either
side; all others match, in the same order, at places that differ by at most the
difference of the lengths. Bigrams are ordered by the number of words that have
them, the rare first, and equal ones by place, so matching ones stand in the
same order in both words. Hence the first matching one is among the three rarest
of either word, and only these are joined.

Position limits make the join one of equal keys (bigram, length, place): words of
equal length match at the same place, a longer word at the same place or the next
one. What meets must have nearly the same letters (parity of letters in 64 bits,
which one edit changes in two bits at most) and is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import discard, stage, table

#: Maximal runs of Latin letters, after lower-casing of A-Z.
RUN = re.compile("[a-zÀ-ÿ]+")
RAREST = 3
#: Distinct words that a worker counts before it hands on what it has, and words of a key that stand in one part, about.
FLUSH, PART = 300_000, 1024


def occurrences(doc_id, text: str | None, every: int = 97) -> Counter:
    """The words of a text with their numbers; in runs whose crc32 with the identifier is divisible by `every` a character is left out."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words of at least `least_length` characters that occur at least `least_n` times in all texts."""

    def count(batches):
        have: Counter = Counter()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    have.update(occurrences(i, text))
                    if len(have) > FLUSH:
                        yield rows(have)
                        have = Counter()
        yield rows(have)

    def rows(have):
        some = {w: n for w, n in have.items() if len(w) >= least_length}
        return pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def letters(word: str) -> int:
    """The parity of each letter, in 64 bits."""
    m = 0
    for c in word.encode("utf-32-le")[::4] if word.isascii() else map(ord, word):
        m ^= 1 << (c & 63)
    return m - (1 << 64) if m >> 63 else m


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, n_a, b, n_b), once: the pairs of distinct words (column word, no repeats, with n) that differ by one inserted, deleted or replaced character.

    Words must have three characters or more for the filter to lose nothing. A
    key of many words is divided into parts of some `part` words, each of which
    hears all that asks, so no task holds a whole key.
    """
    spark = words.sparkSession
    grams = F.expr("array_distinct(transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2)))")
    # Bigrams of 90 letters: 8100 rows at most, however many words there are.
    often = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("m")).orderBy("m", "gram").collect()
    rank = spark.sparkContext.broadcast({r.gram: i for i, r in enumerate(often)})

    def keys(batches):
        of = rank.value
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch, out = big.slice(at, 2048), [[] for _ in range(7)]
                for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    size, mask = len(w), letters(w)
                    for g, p in sorted((of[w[i : i + 2]], i) for i in range(size - 1))[:RAREST]:
                        for asks, length, place in ((False, size, p), (True, size, p), (True, size + 1, p), (True, size + 1, p + 1)):
                            for col, v in zip(out, (asks, g, length, place, w, n, mask), strict=True):
                                col.append(v)
                types = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["asks", "gram", "length", "place", "word", "n", "mask"])

    key = ["gram", "length", "place"]
    placed = stage(words.mapInArrow(keys, "asks boolean, gram int, length int, place int, word string, n long, mask long"), "spelling-keys")
    held, asking = placed.filter("NOT asks").drop("asks"), placed.filter("asks").drop("asks")
    crowded = held.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > part).select(*key, F.ceil(F.col("m") / part).cast("int").alias("parts"))
    crowded = stage(crowded, "spelling-crowded")
    parts = F.coalesce("parts", F.lit(1))
    b = held.join(crowded, key, "left").select(*key, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), *(F.col(x).alias(f"{x}_b") for x in ("word", "n", "mask")))
    a = asking.join(crowded, key, "left").select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *(F.col(x).alias(f"{x}_a") for x in ("word", "n", "mask")))
    alike = (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & ((F.char_length("word_a") < F.col("length")) | (F.col("word_a") < F.col("word_b")))
    met = a.join(b, [*key, "part"]).filter(alike).filter(F.levenshtein("word_a", "word_b", 1) == 1)
    return met.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b")).distinct()


def last_forms(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root): where following (word, form) ends; a form's n is at least twice its word's, so the way has an end. Each round doubles the steps."""
    hops = stage(forms.select("word", F.col("form").alias("root")), "spelling-0")
    for i in range(most_rounds):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-{i + 1}")
        discard(hops)
        hops = after
        if not hops.filter("moved").limit(1).count():
            return hops.drop("moved")
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def spelling_forms(words: DataFrame, times: int = 2, part: int = PART) -> DataFrame:
    """One row for each of `words` (word, n; no repeats): word, form, root, n, n_near, form_n.

    The form is the near word of the largest n (of equals the first in the order
    of code points) if that is at least `times` the word's n, else null; the root
    is where following the forms ends, the word itself if it has none. An empty
    table gives no rows.
    """
    words = stage(words.select("word", "n"), "spelling-words")
    pairs = stage(near_pairs(words, part), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    near = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), "b")).alias("best"), F.first("n_a").alias("n_a"))
    taken = -F.col("best.n") >= times * F.col("n_a")
    near = stage(near.select(F.col("a").alias("word"), "n_near", F.when(taken, F.col("best.b")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")), "spelling-near")
    roots = last_forms(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spelling_forms of the words of all whole texts.

    A null text has no words and a null identifier counts as empty; repeated rows
    count again; other columns are not read; an empty table gives no rows.
    """
    return spelling_forms(word_counts(docs, id_col, text_col))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
