"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, joined on prefix n-grams.

A document's n-grams are 64-bit hashes of word sequences, ordered by how many
documents have them, the rare first (equal ones by hash). Sets of similarity s
share an n-gram among the first n - ceil(s n) + 1 of either, so only these are
joined. At the first n-gram that two sets share, the pair must pass

* the length filter: the smaller has at least s times the members of the larger;
* the positional filter: what stands behind the places is enough to share;
* the suffix filter: the members before the places differ, and those behind them
  differ at least by the numbers that each of eight classes has of them;
* the parity bitmap: two bitmaps never differ in more bits than the sets in members.

A pair that passes is compared once, by its whole sets, whatever the number of
n-grams at which it met. The order needs frequencies, not exact ones: they are
counted over all texts in a table of fixed width whose cells n-grams share, so
what the workers get is a byte for each cell, whatever the corpus.

Documents of equal sets are one class, compared once. Most links show up between
neighbours of a fixed random order, so classes meet in three turns: each one of a
key and the next few, those further on whose groups are still apart, and at last
all whose groups are apart, where a key's largest group only listens. So a group
of copies costs no square of its size.
No number of candidates is capped, and keys are divided into parts of bounded size.

N-grams of different words count as equal if their 64-bit hashes agree: for two
sets of a million members each the odds of one such pair are below 1 in 10^7.
Equal sets are found by 128 bits of a digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import ascii_lower_words, discard, spread_join, stage, table
from crucible.llm.components import connected_components

#: Cells of the table of frequencies by bits of the hash: 2^20 to 2^26, one for some 64 bytes of text.
LEAST_BITS, MOST_BITS, BYTES_A_CELL = 20, 26, 64
#: Cells whose counts travel together.
SEGMENT = 4096
#: Bits of a set's bitmap; classes of members in the suffix filter.
BITS, KINDS = 512, 8
#: Rows of a key in one part, about; how far apart neighbours are that meet in the first and in the second turn.
PART, REACH = 2048, (6, 32)
#: Texts that are worked on together.
SLICE = 128

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words whose every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the distinct n-grams; of fewer words the whole sequence is one; none without words."""
    words = ascii_lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64) * _B
    for i in range(k):  # order matters: each step mixes what came before
        out = mixed(out * _A + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def least_common(n_a, n_b, percent: int):
    """Members that two sets must share at least: 100 shared >= percent (n_a + n_b - shared)."""
    return -((-percent * (n_a + n_b)) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1 if n else 0


def frequencies(base: DataFrame, size: int, bits: int) -> np.ndarray:
    """A byte for each of 2^bits cells: how many documents have the n-grams of the cell, in quarters of powers of two."""
    segment = min(SEGMENT, 1 << bits)

    def count(batches):
        cells = np.zeros(1 << bits, dtype=np.uint32)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                some = [gram_set(t, size) for t in big.column(0).slice(at, SLICE).to_pylist()]
                where, n = np.unique(np.concatenate(some) >> np.uint64(64 - bits), return_counts=True)
                cells[where] += n.astype(np.uint32)
        cells = cells.reshape(-1, segment)
        for k in np.flatnonzero(cells.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(cells[k, 0]) & 15], pa.int32()), pa.array([cells[k].astype(np.int64).tobytes()], pa.binary())], names=["segment", "salt", "cells"])

    def add(batches):
        """Rows come sorted: the sum of each segment."""
        now, total = None, None
        for batch in batches:
            for key, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != now and total is not None:
                    yield out(now, total)
                total = np.frombuffer(cells.as_py(), dtype=np.int64) + (total if key == now else 0)
                now = key
        if total is not None:
            yield out(now, total)

    out = lambda k, total: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "cells"])
    counted = base.select("text").mapInArrow(count, "segment int, salt int, cells binary")
    # Twice: no task sums a segment's rows of all partitions.
    once = counted.repartition("segment", "salt").sortWithinPartitions("segment").select("segment", "cells").mapInArrow(add, "segment int, cells binary")
    whole = once.repartition("segment").sortWithinPartitions("segment").mapInArrow(add, "segment int, cells binary")

    def steps(batches):
        for batch in batches:
            for k, cells in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(cells.as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()), pa.array([np.minimum(255, np.floor(4 * np.log2(np.maximum(x, 1)))).astype(np.uint8).tobytes()], pa.binary())], names=["segment", "step"])

    table = np.zeros((1 << bits) // segment * segment, dtype=np.uint8).reshape(-1, segment)
    for r in whole.mapInArrow(steps, "segment int, step binary").toLocalIterator():  # 2^bits bytes in all
        table[r.segment] = np.frombuffer(r.step, dtype=np.uint8)
    return table.reshape(-1)


def prefix_of(s: np.ndarray, steps: np.ndarray, percent: int):
    """Of a sorted set: the first n-grams in rare-first order, and packed in a word for each the numbers (modulo 256) of the members behind it by kind."""
    step = steps[(s >> np.uint64(64 - (len(steps).bit_length() - 1))).astype(np.int64)]
    order = np.argsort(step, kind="stable")  # s is sorted: equal steps stay in the order of the hash
    p = prefix_size(len(s), percent)
    first = s[order[:p]]
    kind = np.zeros((p, KINDS), dtype=np.int64)
    kind[np.arange(p), (first & np.uint64(KINDS - 1)).astype(np.int64)] = 1
    behind = np.bincount((s & np.uint64(KINDS - 1)).astype(np.int64), minlength=KINDS) - kind.cumsum(axis=0)
    return first, (behind & 255).astype(np.uint8)


def parity(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s >> np.uint64(8) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def may_link(percent: int, n_a, pos_a, behind_a, bits_a, n_b, pos_b, behind_b, bits_b) -> np.ndarray:
    """Arrays that fit each other (behind and bits with an axis more): False for pairs that can be no link by the n-gram at which they meet, should it be the first that they share."""
    need = least_common(n_a, n_b, percent)
    differ = n_a + n_b - 2 * need - pos_a - pos_b
    ok = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (np.minimum(n_a - pos_a, n_b - pos_b) >= need) & (differ >= 0)
    for test in (_suffix_distance, _bit_distance):
        at = np.nonzero(ok)
        if len(at[0]):
            x, y = (behind_a, behind_b) if test is _suffix_distance else (bits_a, bits_b)
            room = differ if test is _suffix_distance else differ + pos_a + pos_b
            ok[at] = test(np.broadcast_to(x, (*ok.shape, x.shape[-1]))[at], np.broadcast_to(y, (*ok.shape, y.shape[-1]))[at]) <= room[at]
    return ok


def _suffix_distance(x, y):
    d = x - y  # of bytes: modulo 256
    return np.minimum(d, np.uint8(0) - d).sum(axis=-1, dtype=np.int64)


def _bit_distance(x, y):
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


NUMBERS = ("row", "n", "pos", "label")


class _Rows:
    """Rows of a batch as arrays: the leading columns and NUMBERS as longs, behind and bits."""

    def __init__(self, batch, leading: int):
        k = leading + len(NUMBERS)
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(k)]
        self.lead = np.stack(cols[:leading])
        self.row, self.n, self.pos, self.label = cols[leading:]
        self.behind = batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, KINDS)
        self.bits = np.frombuffer(b"".join(batch.column(k + 1).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)

    def take(self, at):
        out = object.__new__(_Rows)
        out.lead = self.lead[:, at]
        for x in (*NUMBERS, "behind", "bits"):
            setattr(out, x, getattr(self, x)[at])
        return out

    def joined(self, other):
        out = object.__new__(_Rows)
        out.lead = np.concatenate([self.lead, other.lead], axis=1)
        for x in (*NUMBERS, "behind", "bits"):
            setattr(out, x, np.concatenate([getattr(self, x), getattr(other, x)]))
        return out

    def about(self):
        return self.n, self.pos, self.behind, self.bits


def _pairs(a: np.ndarray, b: np.ndarray):
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(p[0].copy()), pa.array(p[1].copy())], names=["src", "dst"])


def _neighbours(percent: int, first: int, last: int):
    """Pairs of other labels `first` to `last` places apart in a part of a key: (key, part, NUMBERS, behind, bits) in a fixed random order within key and part."""

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _Rows(batch, 2)
            begin, t = (0, fresh) if held is None else (len(held.row), held.joined(fresh))
            found = [np.empty((2, 0), dtype=np.int64)]
            for d in range(first, min(last, len(t.row) - 1) + 1):
                j = np.arange(max(d, begin), len(t.row))  # pairs whose later row is new
                j = j[(t.lead[:, j] == t.lead[:, j - d]).all(axis=0) & (t.label[j] != t.label[j - d])]
                x, y = t.take(j - d), t.take(j)
                ok = may_link(percent, *x.about(), *y.about())
                found.append(np.stack([x.row[ok], y.row[ok]]))
            yield _pairs(*np.concatenate(found, axis=1))
            held = t.take(slice(-last, None))

    return work


def _questions(percent: int):
    """All pairs of rows that ask and rows of their part, which come first: (key, part, asks, main, NUMBERS, behind, bits)."""

    def work(batches):
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _Rows(batch, 4)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(t.lead[:3], axis=1) != 0).any(axis=0)) + 1, [len(t.row)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if cell != (t.lead[0, a], t.lead[1, a]):
                    cell, held = (t.lead[0, a], t.lead[1, a]), []
                some = t.take(slice(a, b))
                if not t.lead[2, a]:
                    held.append(some)
                    continue
                for own in held:
                    for k in range(0, b - a, 64):
                        q = some.take(slice(k, k + 64))
                        # Two rows that both ask meet twice; one question is enough.
                        fresh = (q.label[:, None] != own.label[None]) & ((own.label == own.lead[3])[None] | (q.row[:, None] < own.row[None]))
                        ok = fresh & may_link(percent, *(x[:, None] for x in q.about()), *(x[None] for x in own.about()))
                        i, j = np.nonzero(ok)
                        if len(i):
                            yield _pairs(q.row[i], own.row[j])

    return work


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, part: int = PART, reach: tuple[int, int] = REACH, bits: int | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    n_shingles is the number of distinct n-grams of `size` words; two rows link if
    their sets' similarity is at least `percent` hundredths; component_id is the
    smallest identifier that links reach. Null, empty and blank texts have no
    n-grams and no links, so component_id is their own identifier; a null one is
    taken as component_id only if the component has no other. Repeated rows are
    rows like any other, texts are read whole, other columns are not read, and an
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if bits is None:
        volume = base.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first().b or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(volume // BYTES_A_CELL).bit_length()))
    steps = docs.sparkSession.sparkContext.broadcast(frequencies(base, size, bits))
    id_type = base.schema["id"].dataType.simpleString()

    def sets(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                batch, out = big.slice(at, SLICE), [[] for _ in range(6)]
                for t in batch.column(1).to_pylist():
                    s = gram_set(t, size)
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
                    first, behind = prefix_of(s, steps.value, percent)
                    for col, v in zip(out, (len(s), *d, first.tobytes(), behind.tobytes(), parity(s)), strict=True):
                        col.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["id", "n", "d0", "d1", "first", "behind", "bits"])

    rows = stage(base.mapInArrow(sets, f"id {id_type}, n long, d0 long, d1 long, first binary, behind binary, bits binary"), "jaccard-sets")
    heads = rows.filter("n > 0").groupBy("d0", "d1").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.first(F.struct("n", "first", "behind", "bits")).alias("s"))
    classes = stage(heads.select("d0", "d1", "id", "m", "s.*").withColumn("row", F.monotonically_increasing_id()), "jaccard-classes")

    def explode(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                row, n, first, behind = (big.column(i).slice(at, SLICE) for i in range(4))
                p = np.array([len(x) // 8 for x in first.to_pylist()], dtype=np.int64)
                pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                key, back = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.int64) for x in (first, behind))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(row.to_numpy(), p)), pa.array(np.repeat(n.to_numpy(), p)), pa.array(pos), pa.array(back)], names=["key", "row", "n", "pos", "behind"])

    grams = classes.select("row", "n", "first", "behind").mapInArrow(explode, "key long, row long, n long, pos long, behind long")
    shared = stage(grams.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "jaccard-keys")
    met = stage(spread_join(grams, shared, ["key"], "m", F.col("row")), "jaccard-prefixes")
    discard(shared)

    def apart(turn: int, labels: DataFrame | None) -> DataFrame:
        """The rows of keys whose rows have several labels, with their part of the key and the key's most frequent label (main)."""
        some = met.withColumn("label", F.col("row"))
        if labels is not None:
            some = met.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        if turn < 2:
            keys = some.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("main"), F.max("label").alias("other")).filter("main < other")
            if turn:
                keys = keys.filter(F.col("m") > reach[0] + 1)  # in smaller keys all have met
        else:
            by_label = some.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
            keys = by_label.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label"))["label"].alias("main"))
            keys = keys.filter((F.col("labels") > 1) & (F.col("m") > reach[1] + 1))
        keys = stage(keys.select("key", "m", "main", F.ceil(F.col("m") / part).alias("parts")), "jaccard-apart")
        out = spread_join(some, keys, ["key"], "m", F.col("row")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts")))
        return out.join(classes.select("row", "bits"), "row")

    def proposed(turn: int, labels: DataFrame | None) -> DataFrame:
        if turn < 2:
            ordered = apart(turn, labels).select("key", "part", *NUMBERS, "behind", "bits", F.xxhash64("row").alias("o")).repartition("key", "part").sortWithinPartitions("key", "part", "o")
            return ordered.drop("o").mapInArrow(_neighbours(percent, *((1, reach[0]), (reach[0] + 1, reach[1]))[turn]), "src long, dst long")
        there = stage(apart(turn, labels), "jaccard-there")
        names = ["key", "part", "asks", "main", *NUMBERS, "behind", "bits"]
        asking = there.filter("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        all_of = there.withColumn("asks", F.lit(0)).select(names).unionByName(asking.withColumn("asks", F.lit(1)).select(names))
        return all_of.repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(_questions(percent), "src long, dst long")

    def whole(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                some = [gram_set(t, size) for t in big.column(0).slice(at, SLICE).to_pylist()]
                d = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in some])
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([s.tobytes() for s in some], pa.binary())], names=["d0", "d1", "s"])

    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = done = labels = None
    for turn in range(3):
        pairs = proposed(turn, labels).distinct()
        pairs = stage(pairs if done is None else pairs.join(done, ["src", "dst"], "left_anti"), "jaccard-pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        asked = pairs.select(F.col("src").alias("row")).unionByName(pairs.select(F.col("dst").alias("row"))).distinct()
        # A class's text is one of those of its smallest identifier whose set has the class's digest.
        wanted = stage(classes.join(asked, "row", "left_semi").select("row", F.col("id").alias("wanted"), "d0", "d1"), "jaccard-wanted")
        texts = base.join(wanted.select("wanted").distinct(), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
        full = stage(texts.mapInArrow(whole, "d0 long, d1 long, s binary").join(wanted, ["d0", "d1"]).groupBy("row").agg(F.first("s").alias("s")), "jaccard-whole")
        left, right = full.select(F.col("row").alias("src"), F.col("s").alias("a")), full.select(F.col("row").alias("dst"), F.col("s").alias("b"))
        found = stage(pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long"), "jaccard-links")
        discard(full)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links)

    of = classes.select("row", "d0", "d1", "m", F.col("id").alias("component_id"))
    if labels is not None:
        linked = of.select("row", "component_id").join(labels.withColumnRenamed("node", "row"), "row")
        smallest = linked.groupBy("label").agg(F.min("component_id").alias("least"))
        moved = linked.join(smallest, "label").select("row", "least")
        of = of.join(moved, "row", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    of = of.select("d0", "d1", "m", "component_id")
    full_rows, no_rows = rows.filter("n > 0").select("id", "n", "d0", "d1"), rows.filter("n = 0")
    out = spread_join(full_rows, of, ["d0", "d1"], "m", F.col("id")).select("id", "n", "component_id").unionByName(no_rows.select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op11_rare_first_jaccard(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s
    FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * k >= 90 * (u.n + v.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
