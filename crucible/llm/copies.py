"""Near copies by exact similarity of shingle sets, for the pipeline.

A SimHash within 3 bits is no test of a similarity of 0.8: at that similarity
two fingerprints differ in some 10 of 64 bits. So fingerprints propose and shingles
decide. SimHash over anchor points comes first: what it links and whole sets confirm
is one group, and what they refute is not asked again. An exact prefix join takes the
pairs that are still apart then, and loses none:

* Shingles are ordered by the number of texts that have them, the rare first.
  Two sets of similarity s share one of their first n - ceil(s n) + 1 shingles.
  Shingles of one text take places in that order but are not joined.
* Each set has a bitmap of the parity of its shingles by place. Two bitmaps
  never differ in more bits than the sets differ in shingles, so a pair whose
  bitmaps differ in too many is no link, without its sets being read.
* All other pairs are compared by their whole sets, unless links already join them.

Most links that SimHash leaves show up between neighbours in a random order, so
the join takes three turns: the next row at each key, the next REACH rows, and at
last all pairs whose groups are still apart. In the last turn only rows outside a
key's largest group ask, and a key's rows are dealt to parts that each hear every
question. A turn that has nothing to ask is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import arrow_rows, ascii_lower_words, spread_join, stage
from crucible.llm.components import connected_components
from crucible.llm.simhash import link_fingerprints, majority

#: Texts that are packed together.
PACK = 512
#: A shingle that so many texts of a pack have goes as a bitmap of the pack.
DENSE = 12
#: Shingles of a bucket, about; buckets are numbered by so many bits of the hash.
BUCKET_SHINGLES, LEAST_BITS, MOST_BITS = 1 << 22, 10, 22
#: Bits of a set's bitmap.
BITS = 1024
#: Rows of a key that stand in one part, about, and the neighbours that meet before all do.
PART, REACH = 2048, 15


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles; a text that is shorter than a shingle is one shingle."""
    words = ascii_lower_words(text)
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))


def parity(tokens: np.ndarray) -> bytes:
    """The bitmap of a set: bit i is 1 if an odd number of its members fall on i."""
    return np.packbits((np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _grouped(batches, column: int):
    """Rows come sorted by the column: all batches of one value together."""
    tail, last = [], None
    for batch in batches:
        value = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if tail and value[a] != last:
                yield pa.Table.from_batches(tail)
                tail = []
            last = value[a]
            tail.append(batch.slice(a, b - a))
    if tail:
        yield pa.Table.from_batches(tail)


def _deal(shingle: int, bits: int):
    """Of each PACK texts a row of kind 0 (rows, numbers of shingles, digests and bitmaps) and, by bucket, rows of kind 1 (places of texts, shingles) and 2 (bitmaps of places, shingles)."""
    low_shift = np.uint64(64 - bits - 32)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                row = part.column(0).to_numpy(zero_copy_only=False)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                tokens = [np.unique(s >> low_shift) for s in sets]
                about = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() + majority(s).to_bytes(8, "little") + parity(t) for s, t in zip(sets, tokens, strict=True))
                sizes = np.array([len(t) for t in tokens], dtype=np.int32)
                every, doc = np.concatenate(tokens), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                order = np.argsort(every, kind="stable")
                every, doc = every[order], doc[order]
                run = np.flatnonzero(np.concatenate([[True], np.diff(every) != 0]))
                length = np.diff(np.append(run, len(every)))
                dense = np.flatnonzero(length >= DENSE)
                sparse = np.repeat(length < DENSE, length)
                pack = int(row[0])
                out = [(pack % (1 << bits), 0, row.tobytes(), sizes.tobytes(), about)]
                token, own = every[sparse], doc[sparse]
                if len(token):
                    bucket, low = (token >> np.uint64(32)).astype(np.int64), token.astype(np.uint32)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
                    out += [(int(bucket[a]), 1, own[a:b].tobytes(), low[a:b].tobytes(), b"") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for i in dense.tolist():
                    marks = np.zeros(PACK, dtype=np.uint8)
                    marks[doc[run[i] : run[i] + length[i]]] = 1
                    out.append((int(every[run[i]]) >> 32, 2, np.packbits(marks).tobytes(), np.uint32(every[run[i]] & np.uint64(0xFFFFFFFF)).tobytes(), b""))
                bucket, kind, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array([pack] * len(out), pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], names=["bucket", "kind", "pack", "a", "b", "c"])

    return work


def _count(batches):
    """Of each bucket the shingles of several texts, with their number, back by pack; rows of kind 0 go through."""
    for t in _grouped(batches, 0):
        kind, pack = t.column(1).to_numpy(), t.column(2).to_numpy()
        a, b, c = (t.column(i).to_pylist() for i in (3, 4, 5))
        out = [(int(pack[i]), 0, a[i], b[i], c[i]) for i in np.flatnonzero(kind == 0).tolist()]
        some, whole = np.flatnonzero(kind == 1).tolist(), np.flatnonzero(kind == 2).tolist()
        if some or whole:
            high = int(t.column(0)[0].as_py()) << 32
            size = [len(b[i]) // 4 for i in some]
            low = np.frombuffer(b"".join([b[i] for i in some] + [b[i] for i in whole]), dtype=np.uint32)
            marks = np.frombuffer(b"".join([a[i] for i in whole]), dtype=np.uint8).reshape(len(whole), PACK // 8)
            weight = np.ones(len(low), dtype=np.int64)
            weight[len(low) - len(whole) :] = np.bitwise_count(marks).sum(axis=1)
            order = np.argsort(low, kind="stable")
            run = np.flatnonzero(np.concatenate([[True], np.diff(low[order]) != 0]))
            n = np.empty(len(low), dtype=np.int64)
            n[order] = np.repeat(np.add.reduceat(weight[order], run), np.diff(np.append(run, len(low))))
            token = low.astype(np.int64) | high
            begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tolist()
            for j, i in enumerate(some):
                x = begin[j] + np.flatnonzero(n[begin[j] : begin[j + 1]] > 1)
                if len(x):
                    out.append((int(pack[i]), 1, np.frombuffer(a[i], dtype=np.uint16)[x - begin[j]].tobytes(), token[x].tobytes(), n[x].tobytes()))
            for j, i in enumerate(whole, begin[-1]):
                out.append((int(pack[i]), 2, a[i], token[j].tobytes(), n[j].tobytes()))
        for k in range(0, len(out), 4096):
            p, *rest = zip(*out[k : k + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rest[1:])], names=["pack", "kind", "a", "b", "c"])


#: What kind 0 holds of each text: digest, fingerprint, bitmap.
ABOUT = np.dtype([("d0", "<i8"), ("d1", "<i8"), ("fp", "<i8"), ("bits", f"V{BITS // 8}")])


def _heads(batches):
    for batch in batches:
        for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            about = np.frombuffer(c, dtype=ABOUT)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, dtype=np.int64)), *(pa.array(about[x].copy()) for x in ("d0", "d1", "fp"))], names=["row", "d0", "d1", "fp"])


def _prefixes(similarity: float):
    """The shingles of several texts among the first n - ceil(similarity n) + 1 of each row."""

    def work(batches):
        for t in _grouped(batches, 0):
            kind, (a, b, c) = t.column(1).to_pylist(), (t.column(i).to_pylist() for i in (2, 3, 4))
            head, some, whole = kind.index(0), [i for i, k in enumerate(kind) if k == 1], [i for i, k in enumerate(kind) if k == 2]
            if not some and not whole:
                continue
            row, size = np.frombuffer(a[head], dtype=np.int64), np.frombuffer(b[head], dtype=np.int32).astype(np.int64)
            about = np.frombuffer(c[head], dtype=ABOUT)
            doc = np.frombuffer(b"".join([a[i] for i in some]), dtype=np.uint16).astype(np.int64)
            token, n = (np.frombuffer(b"".join([x[i] for i in some]), dtype=np.int64) for x in (b, c))
            if whole:
                marks = np.unpackbits(np.frombuffer(b"".join([a[i] for i in whole]), dtype=np.uint8).reshape(len(whole), -1), axis=1)
                which, of = np.nonzero(marks)
                token_w, n_w = (np.frombuffer(b"".join([x[i] for i in whole]), dtype=np.int64) for x in (b, c))
                doc, token, n = np.concatenate([doc, of]), np.concatenate([token, token_w[which]]), np.concatenate([n, n_w[which]])
            order = np.lexsort((token, n, doc))
            doc, token, n = doc[order], token[order], n[order]
            have = np.bincount(doc, minlength=len(row))
            pos = np.arange(len(doc)) - (np.cumsum(have) - have)[doc] + (size - have)[doc]
            keep = pos < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[doc]
            doc, token, pos, n = doc[keep], token[keep], pos[keep], n[keep]
            for k in range(0, len(doc), 8192):
                d = doc[k : k + 8192]
                bits = pa.array(about["bits"][d].tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(token[k : k + 8192]), pa.array(row[d]), pa.array(size[d]), pa.array(pos[k : k + 8192]), bits], names=["key", "row", "n", "pos", "bits"])

    return work


def _columns(batch, names: int):
    """The first columns as longs, and the bitmaps of the last one."""
    raw = b"".join(batch.column(names).to_pylist())
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(names)]), np.frombuffer(raw, dtype=np.uint64).reshape(batch.num_rows, BITS // 64)


class Filter:
    """Which pairs can be links: by label, by what their places leave to share, and by bitmap."""

    def __init__(self, similarity: float):
        self.need, self.differ = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def __call__(self, n_a, pos_a, label_a, bits_a, n_b, pos_b, label_b, bits_b) -> np.ndarray:
        """Arrays that fit each other; sets whose first common shingle stands at `pos` share at most the smaller n - pos."""
        both = n_a + n_b
        ok = (label_a != label_b) & (np.minimum(n_a - pos_a, n_b - pos_b) >= self.need * both - 1e-9)
        i = np.nonzero(ok)
        if len(i[0]):
            far = np.bitwise_count(np.broadcast_to(bits_a, (*ok.shape, bits_a.shape[-1]))[i] ^ np.broadcast_to(bits_b, (*ok.shape, bits_b.shape[-1]))[i]).sum(axis=-1, dtype=np.int64)
            ok[i] = far <= self.differ * both[i] + 1e-9
        return ok


def _pairs(found: list[np.ndarray]):
    p = np.sort(np.concatenate(found, axis=1), axis=0)
    p = np.unique(p, axis=1) if p.shape[1] else p
    return pa.RecordBatch.from_arrays([pa.array(p[0].copy()), pa.array(p[1].copy())], names=["src", "dst"])


def _neighbours(filter_: Filter, first: int, last: int):
    """Pairs `first` to `last` places apart in one part of one key: rows (key, part, row, n, pos, label, bits) come sorted by key, part and a random order."""

    def work(batches):
        t = bits = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, more = _columns(batch, 6)
            fresh = 0 if t is None else t.shape[1]
            t, bits = (u, more) if t is None else (np.concatenate([t, u], axis=1), np.concatenate([bits, more]))
            found = []
            for d in range(first, min(last, t.shape[1] - 1) + 1):
                j = np.arange(max(d, fresh), t.shape[1])  # pairs whose later row is new
                j = j[(t[:2, j] == t[:2, j - d]).all(axis=0)]
                if len(j):
                    i = j - d
                    ok = filter_(t[3, i], t[4, i], t[5, i], bits[i], t[3, j], t[4, j], t[5, j], bits[j])
                    found.append(t[2][np.stack([i[ok], j[ok]])])
            if found:
                yield _pairs(found)
            t, bits = t[:, -last:], bits[-last:]

    return work


def _questions(filter_: Filter):
    """All pairs of rows that ask (asks = 1) and rows of their part (asks = 0), which come first: (key, part, asks, row, n, pos, label, main, bits)."""

    def work(batches):
        held: list = []  # the rows of the part
        cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, bits = _columns(batch, 8)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(t[:3], axis=1) != 0).any(axis=0)) + 1, [t.shape[1]]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if cell != (t[0, a], t[1, a]):
                    cell, held = (t[0, a], t[1, a]), []
                if not t[2, a]:
                    held.append((t[:, a:b], bits[a:b]))
                    continue
                _, _, _, row, n, pos, label, main = np.concatenate([x for x, _ in held], axis=1)
                own = np.concatenate([x for _, x in held])
                for k in range(a, b, 64):
                    q = slice(k, min(k + 64, b))
                    ok = filter_(t[4, q, None], t[5, q, None], t[6, q, None], bits[q, None], n[None], pos[None], label[None], own[None])
                    # Two rows that both ask meet twice.
                    i, j = np.nonzero(ok & ((label == main)[None] | (t[3, q, None] < row[None])))
                    if len(i):
                        yield _pairs([np.stack([t[3, q][i], row[j]])])

    return work


def near_copies(docs: DataFrame, row_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, part: int = PART, reach: int = REACH) -> DataFrame:
    """(row, label): label is the smallest row of the group that links reach; a link is a Jaccard similarity of the sets of `shingle` words of at least `similarity`.

    Every link is found, or a path of links in its place. Null and empty texts
    have the empty shingle, so they are copies of each other. Rows of equal sets
    are one node. row_col must be a unique long; other columns are not read; an
    empty table gives no rows. Texts are read whole.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("_text"))
    size = base.agg(F.sum(F.octet_length("_text")).alias("b")).first().b or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // (6 * BUCKET_SHINGLES)).bit_length()))
    filter_ = Filter(similarity)

    dealt = base.mapInArrow(_deal(shingle, bits), "bucket int, kind int, pack long, a binary, b binary, c binary").repartition("bucket").sortWithinPartitions("bucket")
    with arrow_rows(spark, 2 * PACK):
        counted = stage(dealt.mapInArrow(_count, "pack long, kind int, a binary, b binary, c binary"), "copies-shingles")
    with arrow_rows(spark, 32):
        rows = stage(counted.filter("kind = 0").select("a", "c").mapInArrow(_heads, "row long, d0 long, d1 long, fp long"), "copies")
    nodes = stage(rows.groupBy("d0", "d1").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "copies-nodes")
    first = counted.repartition("pack").sortWithinPartitions("pack").mapInArrow(_prefixes(similarity), "key long, row long, n long, pos long, bits binary")
    with arrow_rows(spark, 2 * PACK):
        first = stage(first.join(nodes.select(F.col("node").alias("row")), "row", "left_semi"), "copies-prefixes")

    # A text that shares no shingle of its prefix is no copy, whatever its fingerprint.
    able = stage(nodes.select(F.col("node").alias("row"), "fp").join(first.select("row").distinct(), "row"), "copies-able")
    heads = stage(able.groupBy("fp").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")), "copies-heads")

    def by_simhash():
        """The first rows of fingerprints that SimHash links, and the rows of a fingerprint with its first one."""
        equal = spread_join(able, heads, ["fp"], "n", F.col("row")).filter("row <> head").select(F.col("head").alias("src"), F.col("row").alias("dst"))
        of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_row"))
        near = link_fingerprints(heads).join(of("src"), "src").join(of("dst"), "dst")
        return equal.unionByName(near.select(F.least("src_row", "dst_row").alias("src"), F.greatest("src_row", "dst_row").alias("dst")))

    def shingles(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, shingle).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["row", "s"])

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def apart(turn, labels):
        """The rows of keys whose rows have several labels, with these, a label of the key (in the last turn the most frequent one) and the row's part of the key; None if there are no such keys."""
        if labels is None:
            some = first.withColumn("label", F.col("row"))
        else:
            some = first.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        if turn < 2:
            keys = some.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("main"), F.max("label").alias("hi")).filter("main < hi")
        else:
            by_label = some.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
            keys = by_label.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label"))["label"].alias("main"))
            keys = keys.filter((F.col("labels") > 1) & (F.col("m") > reach + 1))  # all pairs of smaller keys have met
        keys = stage(keys.select("key", "m", "main", F.ceil(F.col("m") / part).alias("parts")), "copies-keys")
        if keys.isEmpty():
            return None
        return spread_join(some, keys, ["key"], "m", F.col("row")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts")))

    def joined(turn, labels):
        rows_of = apart(turn, labels)
        if rows_of is None:
            return None
        if turn < 2:
            ordered = rows_of.select("key", "part", "row", "n", "pos", "label", "bits", F.xxhash64("row").alias("o")).repartition("key", "part").sortWithinPartitions("key", "part", "o")
            return ordered.drop("o").mapInArrow(_neighbours(filter_, *((1, 1), (2, reach))[turn]), "src long, dst long")
        rows_of = stage(rows_of, "copies-apart")
        names = ["key", "part", "asks", "row", "n", "pos", "label", "main", "bits"]
        asking = rows_of.filter("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = rows_of.withColumn("asks", F.lit(0)).select(names).unionByName(asking.withColumn("asks", F.lit(1)).select(names))
        return met.repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(_questions(filter_), "src long, dst long")

    done = labels = None
    for turn in ("simhash", 0, 1, 2):
        pairs = by_simhash() if turn == "simhash" else joined(turn, labels)
        if pairs is None:
            continue
        pairs = stage(pairs.distinct() if done is None else pairs.distinct().join(done, ["src", "dst"], "left_anti"), "copies-pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        asked = pairs.select(F.col("src").alias("row")).unionByName(pairs.select(F.col("dst").alias("row"))).distinct()
        with arrow_rows(spark, PACK):
            sets = stage(base.join(asked, "row", "left_semi").mapInArrow(shingles, "row long, s binary"), "copies-sets")
        left, right = sets.select(F.col("row").alias("src"), F.col("s").alias("a")), sets.select(F.col("row").alias("dst"), F.col("s").alias("b"))
        with arrow_rows(spark, 128):
            found = stage(pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(check, "src long, dst long"), "copies-links")
        if not found.isEmpty():
            # The groups so far go on as stars, so their links are not walked again.
            labels = connected_components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("src"), F.col("label").alias("dst"))))
    of_node = nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = of_node.select("d0", "d1", "n", "label")
    return spread_join(rows, of_node, ["d0", "d1"], "n", F.col("row")).select("row", "label")
