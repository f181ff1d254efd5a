"""Removal of repeated passages by difference-cover suffix sorting, distributed by content anchors.

1. Anchors. In each string of LENGTH bytes the k-gram of smallest hash is its
   anchor. Equal strings have equal anchors at equal places, so neighbouring
   strings with one anchor make a context, and contexts are dealt out by their
   anchor's hash: equal strings meet, wherever they stand.
2. Equal contexts are combined, first in each batch of the scan, then after the
   shuffle: the first keeps its place and each later one is removed as a whole.
   An anchor with one context is settled.
3. The contexts of the other anchors are fetched from their texts and
   suffix-sorted by the difference-cover algorithm: the triples at places 1 and 2
   modulo 3 are sorted and named, the names are sorted by recursion, the
   remaining suffixes are merged in, and adjacent suffixes are compared on their
   first LENGTH bytes. In each run of equals all but the first string go.
   An anchor with more than HOT contexts is first divided by longer keys, made
   of the bytes that a narrower range of its strings has in common.
4. The removed stretches meet their text again, which gives the digests.

Only hashes and places of contexts are shuffled for the whole corpus, some 1/35
of the positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import stage, table

LENGTH = 100
GRAM = 32
#: Contexts of an anchor beyond which its key is made longer.
HOT = 512
#: Ranges of string starts that share a key, after the first.
RANGES = (18, 1)
#: Parts of the rows of one string that stands in many contexts.
PARTS = 32
#: Bytes of contexts that are sorted at once, and of texts that are scanned at once.
SORTED_BYTES, SCANNED_BYTES = 1 << 21, 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def difference_cover_sort(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (integers from 1; fewer than 2**21 of them differ)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    base = int(s.max()) + 1
    t = np.concatenate([s.astype(np.int64), np.zeros(3, dtype=np.int64)])
    # With a place n of zeros where n % 3 == 1, every place 0 modulo 3 is followed by a sampled one.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    order = np.argsort(triple)
    change = np.concatenate([[1], (np.diff(triple[order]) != 0).astype(np.int64)])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(change)
    if change.sum() < len(sample):
        order = difference_cover_sort(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    wide = len(sample) + 2
    zeros = np.arange(0, n, 3)
    key = t[zeros] * wide + rank[zeros + 1]
    by = np.argsort(key)
    zeros, key = zeros[by], key[by]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(t[first] * wide + rank[first + 1], key)
    two = lambda i: (t[i] * base + t[i + 1]) * wide + rank[i + 2]
    before += np.searchsorted(two(second), two(zeros))
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(zeros))
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[at], out[rest] = zeros, sorted_sample
    return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For contexts in order of place: the offsets of each at which a string of that length starts that an earlier place has too."""
    size = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.frombuffer(b"\0".join(contexts) + b"\0" * length, dtype=np.uint8)
    s = text[: begin[-1] + size[-1]].astype(np.int64) + 1
    s[begin[1:] - 1] = 257  # between contexts
    starts = np.zeros(len(s), dtype=bool)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        starts[b : b + n - length + 1] = True
    order = difference_cover_sort(s)
    order = order[starts[order]]
    views = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order), dtype=bool)
    for k in range(1, len(order), 65_536):
        some = order[k - 1 : k + 65_536]
        rows = views[some]
        same[k : k + 65_536] = (rows[1:] == rows[:-1]).all(axis=1)
    run = np.flatnonzero(~same)
    first = np.minimum.reduceat(order, run) if len(order) else order
    repeated = np.sort(order[order != np.repeat(first, np.diff(np.append(run, len(order))))])
    cut = np.searchsorted(repeated, begin)
    return [repeated[a:b] - begin[i] for i, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(repeated)), strict=True))]


def stretches(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The bytes [from, to) that strings from sorted starts cover, joined where starts follow one another."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def _window_hash(x: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each window of so many bytes (a power of two): joined from halves."""
    h, mul, n = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), int(_MUL), 1
    while n < width:
        h = h[:-n] * np.uint64(mul) + h[n:]
        mul, n = mul * mul & 0xFFFFFFFFFFFFFFFF, 2 * n
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    m, n = x, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if width > n else m


def contexts_of(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Of each string in the pieces that share an anchor next to each other: (piece, first start, starts, anchor - first start, anchor hash)."""
    width = length - gram + 1
    size = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    x = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    if len(x) < length:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, np.empty(0, dtype=np.uint64)
    h = _window_hash(x, gram)
    place = np.arange(len(h), dtype=np.uint64)
    # The smaller hash wins, then the place further left.
    anchor = (_window_min((h & ~np.uint64(0xFFFFFF)) | place, width) & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), size)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= (begin + size)[piece]
    starts = np.flatnonzero(valid)
    a, p = anchor[starts], piece[starts]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 0)]) if len(starts) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first = starts[at]
    return p[at], first - begin[p[at]], count, a[at] - first, h[a[at]]


def _scan(batches):
    """Rows (key, ctx, doc, row, loc, n): a context that is the first of its kind in its batch, or (ctx null) a stretch to remove.

    loc is the first start; n holds the number of starts and the anchor's place: starts * 128 + place.
    """

    def flush(pieces, owner):
        doc, row, off = (np.array(c, dtype=np.int64) for c in zip(*owner, strict=True))
        p, first, count, rel, key = contexts_of(pieces)
        if not len(p):
            return None
        h64 = xxhash.xxh3_64_intdigest
        views = [memoryview(x) for x in pieces]
        ctx = np.array([h64(views[i][f : f + c + LENGTH - 1]) for i, f, c in zip(p.tolist(), first.tolist(), count.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
        key, doc, row, loc, n = key.view(np.int64), doc[p], row[p], first + off[p], count * 128 + rel
        order = np.lexsort((loc, row, doc, ctx, key))
        again = np.concatenate([[False], (np.diff(key[order]) == 0) & (np.diff(ctx[order]) == 0)])
        repeats = np.zeros(len(order), dtype=bool)
        repeats[order] = again
        # A stretch goes its own way: any key does, and its own row spreads them.
        key = np.where(repeats, row * 0x5851F42D4C957F2D + loc, key)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx, mask=repeats), pa.array(doc), pa.array(row), pa.array(loc), pa.array(n)], names=["key", "ctx", "doc", "row", "loc", "n"])

    pieces, owner, held = [], [], 0
    with np.errstate(over="ignore"):
        for batch in batches:
            for doc, row, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for off in range(0, max(1, len(raw) - LENGTH + 1), SCANNED_BYTES):
                    piece = raw[off : off + SCANNED_BYTES + LENGTH - 1]
                    if len(piece) < LENGTH:
                        continue
                    pieces.append(piece)
                    owner.append((doc.as_py(), row.as_py(), off))
                    held += len(piece)
                    if held >= SCANNED_BYTES:
                        if (out := flush(pieces, owner)) is not None:
                            yield out
                        pieces, owner, held = [], [], 0
        if pieces and (out := flush(pieces, owner)) is not None:
            yield out


def _combine(batches):
    """Of rows sorted by key, ctx and place: the first of each context of an anchor with several, as it is, and (key null) the later equal ones, which go."""
    names = ["key", "ctx", "doc", "row", "loc", "n"]
    before = None  # the last row's key and context
    held = None  # the last first-of-its-context, and whether its key had one before: another may follow

    def out(parts):
        """parts: (columns, use, whether they go)."""
        gone = np.concatenate([np.full(len(use), g) for _, use, g in parts])
        cols = {k: np.concatenate([c[k][use] for c, use, _ in parts]) for k in names}
        return pa.RecordBatch.from_arrays([pa.array(cols["key"], mask=gone), *(pa.array(cols[k]) for k in names[2:])], names=["key", *names[2:]])

    for batch in batches:
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        c = {k: batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        parts = [(c, np.flatnonzero(null), True)]
        if not null.all():
            c = {k: v[~null] for k, v in c.items()}
            key, ctx = c["key"], c["ctx"]
            same_key = np.concatenate([[before is not None and key[0] == before[0]], key[1:] == key[:-1]])
            same = same_key & np.concatenate([[before is not None and ctx[0] == before[1]], ctx[1:] == ctx[:-1]])
            before = key[-1], ctx[-1]
            parts.append((c, np.flatnonzero(same), True))
            heads = np.flatnonzero(~same)
            if len(heads):
                follows = same_key[heads]
                if held is not None and (held[1] or follows[0]):
                    parts.append((held[0], np.zeros(1, dtype=np.int64), False))
                parts.append((c, heads[:-1][follows[:-1] | follows[1:]], False))
                held = {k: v[heads[-1:]].copy() for k, v in c.items()}, bool(follows[-1])
        yield out(parts)
    if held is not None and held[1]:
        yield out([(held[0], np.zeros(1, dtype=np.int64), False)])


def divide(ctx: bytes, rel: int, width: int) -> list[tuple[int, int, bytes, int]]:
    """A context in parts of at most `width` starts: (key, offset, bytes, place of the anchor).

    Starts count back from the anchor, so that equal strings of two contexts
    fall in one range; the key is the hash of what all strings of a range hold.
    """
    out, least = [], rel - (len(ctx) - LENGTH)
    for j in range(least // width, rel // width + 1):
        lo, hi = max(least, j * width), min(rel, (j + 1) * width - 1)
        core = ctx[rel - j * width : rel - (j + 1) * width + 1 + LENGTH]
        key = xxhash.xxh64_intdigest(core, j + 1)
        out.append((key - (1 << 64) if key >> 63 else key, rel - hi, ctx[rel - hi : rel - lo + LENGTH], hi))
    return out


def _fetch(width):
    """(key, doc, row, loc, ctx, rel): the bytes of contexts from their texts, divided if a width is given."""

    def work(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch, cols = big.slice(at, 256), [[] for _ in range(6)]
                for doc, row, text, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    for x in items:
                        loc, n = x["loc"], x["n"]
                        ctx = raw[loc : loc + (n >> 7) + LENGTH - 1]
                        for k, o, part, rel in divide(ctx, n & 127, width) if width else [(x["key"], 0, ctx, n & 127)]:
                            for c, v in zip(cols, (k, doc, row, loc + o, part, rel), strict=True):
                                c.append(v)
                yield _contexts(cols)

    return work


def _contexts(cols):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "doc", "row", "loc", "ctx", "rel"])


def _divide_again(width):
    def work(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for _, doc, row, loc, ctx, rel in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for k, o, part, r in divide(ctx, rel, width):
                    for c, v in zip(cols, (k, doc, row, loc + o, part, r), strict=True):
                        c.append(v)
            yield _contexts(cols)

    return work


def _sort(batches):
    """(row, from, to) of what repeats, from contexts sorted by key; anchors are sorted together up to SORTED_BYTES."""

    def run(held):
        held.sort(key=lambda c: c[:3])
        rows, begin, end = [], [], []
        for (_, row, loc, _), starts in zip(held, repeated_starts([c[3] for c in held]), strict=True):
            for a, b in stretches(starts):
                rows.append(row)
                begin.append(loc + a)
                end.append(loc + b)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, begin, end)], names=["row", "from", "to"])

    held, bytes_held, last = [], 0, None
    for batch in batches:
        for key, doc, row, loc, ctx in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bytes_held >= SORTED_BYTES and key != last:
                yield run(held)
                held, bytes_held = [], 0
            held.append((doc, row, loc, ctx))
            bytes_held += len(ctx)
            last = key
    if held:
        yield run(held)


def _cut(batches):
    """Each text without what is removed: (id, n_bytes, spans, kept)."""
    for big in batches:
        for at in range(0, big.num_rows, 256):
            batch, cols = big.slice(at, 256), [[], [], []]
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, spans = (text or "").encode("utf-8", "surrogatepass"), []
                for x in sorted((x["from"], x["to"]) for x in some or []):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append([*x])
                edges = [0, *(e for x in spans for e in x), len(raw)]
                cols[0].append(len(raw))
                cols[1].append([{"from": a, "to": b} for a, b in spans])
                cols[2].append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            pair = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pair), pa.array(cols[2], pa.binary())], names=[batch.schema.names[0], "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, spans (the removed [from, to) in bytes, in order and apart), kept (the other bytes).

    Every byte goes that a string of LENGTH bytes covers which also starts
    earlier: at a smaller identifier, or earlier in the same text. Null
    identifiers come after all others; rows repeated with one identifier come
    in the order of the input, each a document of its own. Null texts count as
    empty; texts shorter than LENGTH lose nothing. Other columns are not read;
    an empty table gives no rows. docs must be a table scan or a checkpoint:
    rows are numbered by their place in it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    last = F.lit((1 << 63) - 1)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), last).alias("doc"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("row"))
    found = base.select("doc", "row", "_text").mapInArrow(_scan, "key long, ctx long, doc long, row long, loc long, n long")
    met = found.repartition("key").sortWithinPartitions("key", "ctx", "doc", "row", "loc")
    met = stage(met.mapInArrow(_combine, "key long, doc long, row long, loc long, n long"), "suffix-contexts")
    later = met.filter("key IS NULL").select("row", F.col("loc").alias("from"), (F.col("loc") + F.shiftright("n", 7) + (LENGTH - 1)).alias("to"))
    open_ = met.filter("key IS NOT NULL")
    crowded = stage(open_.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "suffix-crowded")

    def fetched(rows, width):
        of_text = rows.groupBy("row").agg(F.collect_list(F.struct("key", "loc", "n")).alias("items"))
        return of_text.join(base, "row").select("doc", "row", "_text", "items").mapInArrow(_fetch(width), CONTEXTS)

    def sort(contexts):
        together = contexts.select("key", "doc", "row", "loc", "ctx").repartition("key").sortWithinPartitions("key")
        return together.mapInArrow(_sort, "row long, from long, to long")

    gone = later.unionByName(sort(fetched(open_.join(crowded, "key", "left_anti"), None)))
    if crowded.head(1):
        parts = stage(fetched(open_.join(crowded, "key", "left_semi"), RANGES[0]), "suffix-divided")
        still = stage(parts.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "suffix-crowded")
        gone = gone.unionByName(sort(parts.join(still, "key", "left_anti")))
        # Parts of one start are equal if their keys are: the first of each stays.
        single = parts.join(still, "key", "left_semi").select("key", "doc", "row", "loc", "ctx", "rel").mapInArrow(_divide_again(RANGES[1]), CONTEXTS)
        single = single.select("key", F.sha2("ctx", 256).alias("sha"), F.struct("doc", "row", "loc").alias("place"))
        # A string may stand in most texts: its rows are dealt out, its first place goes to each part.
        single = single.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS)).cast("int"))
        first = single.groupBy("key", "sha").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        first = first.select("key", "sha", "first", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        repeats = single.join(first, ["key", "sha", "part"]).filter("place <> first")
        gone = gone.unionByName(repeats.select("place.row", F.col("place.loc").alias("from"), (F.col("place.loc") + LENGTH).alias("to")))
    of_row = gone.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    whole = base.join(of_row, "row", "left").select(F.col("_id").alias(id_col), "_text", "gone")
    return whole.mapInArrow(_cut, f"`{id_col}` {id_type}, n_bytes long, spans array<struct<from:bigint,to:bigint>>, kept binary")


CONTEXTS = "key long, doc long, row long, loc long, ctx binary, rel int"


def op7_difference_cover(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hex digits each; h holds a text's, every place i begins a string of 200 digits.
OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS g FROM d, LATERAL (SELECT unnest(range(greatest(0, length(h) // 2 - 99))) AS i)),
f AS (SELECT g, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, s.i, CASE WHEN s.i > lag(s.i) OVER w + 100 THEN 1 ELSE 0 END AS fresh FROM s JOIN f USING (g) WHERE struct_pack(doc_id := doc_id, i := s.i) > first WINDOW w AS (PARTITION BY doc_id ORDER BY s.i)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY 1, 2),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM spans),
kept AS (
  SELECT p.doc_id, string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (a - upto) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS b, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans
  FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(b, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
