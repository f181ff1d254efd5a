"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most one
bit in one of their halves. The words of the perfect Hamming code of 31 bits are
the anchors of a half (its top bit is left out, which only brings fingerprints
closer together): every word is within the covering radius 1 of an anchor. Each
distinct fingerprint goes, for either half, to every anchor within radius plus
threshold, 1 + 1 = 2: its own anchor, and those two bits away, 16 or 32 in all.
Fingerprints within one bit of each other in a half meet at the own anchor of
either. At an anchor all are compared on their whole 64 bits, and only a
spanning forest of its links goes on to the connected components.

An anchor with more than `hot` fingerprints is divided by the four bytes of the
other half: a linked pair agrees in one of these four, since at most 3 bits
differ. So no cap is needed, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import ascii_lower_words, spread_join, stage, table
from crucible.llm.components import connected_components

THRESHOLD = 3
HOT = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority of the XXH64 (seed 42) of the word shingles, repeats included, in each bit; 0 for no words."""
    words = ascii_lower_words(text)
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(g, 42) for g in grams], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are those that over half the hashes have set."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 8192):  # bounded memory for long texts
        counts += np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    one = docs.select(id_col, text_col)
    return one.mapInArrow(work, f"`{id_col}` {one.schema[id_col].dataType.simpleString()}, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of words of 31 bits under the Hamming code: the XOR of the (1-based) places of the set bits; 0 for a code word."""
    out = np.zeros(x.shape, dtype=np.int64)
    for i in range(31):
        out ^= np.where((x >> i) & 1, i + 1, 0)
    return out


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code words within two bits of each word of 31 bits: (row, anchor).

    Flipping places a and b gives a code word if a ^ b is the syndrome s (b = 0:
    no second flip). So each place a pairs with a ^ s, and every pair comes twice.
    """
    s = syndrome(x)
    rows, found = [np.arange(len(x))], [x ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)]
    for a in range(1, 32):
        b = a ^ s
        use = (s > 0) & (a < b)
        rows.append(np.flatnonzero(use))
        found.append((x ^ (1 << (a - 1)) ^ (1 << np.maximum(b - 1, 0)))[use])
    return np.concatenate(rows), np.concatenate(found)


def spanning_links(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (smaller, larger). Whole waves of a component are compared with what is left."""
    fps = np.sort(fps)
    left, links = fps, []
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            hit = np.zeros(len(left), dtype=np.int64) - 1
            for k in range(0, len(wave), 256):
                for at in range(0, len(left), 8192):  # bounded memory for large anchors
                    own = slice(at, at + 8192)
                    near = np.bitwise_count((left[own, None] ^ wave[None, k : k + 256]).view(np.uint64)) <= threshold
                    got = near.any(axis=1) & (hit[own] < 0)
                    hit[own][got] = k + near[got].argmax(axis=1)
            found = hit >= 0
            links += zip(np.minimum(wave[hit[found]], left[found]).tolist(), np.maximum(wave[hit[found]], left[found]).tolist(), strict=True)
            wave, left = left[found], left[~found]
    return links


def link_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst): links that connect all distinct fingerprints (column fp, no repeats) that differ in at most 3 bits."""

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for half in (0, 1):
                rows, anchor = anchors((fp >> (32 * half)) & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(anchor << 1 | half, pa.int64()), pa.array(fp[rows], pa.int64())], names=["anchor", "fp"])

    placed = stage(fps.select("fp").mapInArrow(replicate, "anchor long, fp long"), "simhash-anchors")
    sizes = stage(placed.groupBy(F.col("anchor").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    calm = placed.join(sizes.filter(F.col("n") <= hot).select(F.col("key").alias("anchor")), "anchor").select(F.col("anchor").alias("key"), F.lit(-1).alias("sub"), "fp")
    crowded = placed.join(sizes.filter(F.col("n") > hot).select(F.col("key").alias("anchor")), "anchor")
    other = F.when(F.col("anchor").bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bytes_of = F.array(*(F.struct((F.lit(i * 256) + F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255))).cast("int").alias("sub")) for i in range(4)))
    crowded = crowded.select(F.col("anchor").alias("key"), F.explode(bytes_of).alias("b"), "fp").select("key", "b.sub", "fp")

    def compare(batches):
        """Rows come sorted by key: whole anchors, cut where the key changes."""
        tail = None
        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            tail = t if tail is None else np.concatenate([tail, t], axis=1)
            change = np.flatnonzero((np.diff(tail[0]) != 0) | (np.diff(tail[1]) != 0)) + 1
            if len(change):
                yield links_of(tail[:, : change[-1]], change[:-1])
                tail = tail[:, change[-1] :]
        if tail is not None:
            yield links_of(tail, np.empty(0, dtype=np.int64))

    def links_of(t, cuts):
        # Most anchors hold two: those are compared at once.
        begin = np.concatenate([[0], cuts, [t.shape[1]]]).astype(np.int64)
        size = np.diff(begin)
        two = begin[:-1][size == 2]
        a, b = t[2][two], t[2][two + 1] if len(two) else t[2][two]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD
        out = [*zip(np.minimum(a, b)[near].tolist(), np.maximum(a, b)[near].tolist(), strict=True)]
        for k in np.flatnonzero(size > 2).tolist():
            out += spanning_links(t[2][begin[k] : begin[k + 1]])
        out = sorted(set(out))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])

    together = calm.unionByName(crowded).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return together.mapInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id, the smallest identifier that links reach.

    Null and empty texts have fingerprint 0, which links like any other. Equal
    fingerprints are one node. Null identifiers are not taken as component_id
    unless the component has no other. Repeated rows give repeated results;
    other columns are not read; an empty table gives no rows.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = stage(rows.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    links = stage(link_fingerprints(nodes), "simhash-links")
    # label: the smallest fingerprint of the component, for linked ones only.
    labels = connected_components(links)
    linked = nodes.join(labels, nodes.fp == labels.node).select("fp", "first", "label")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    moved = linked.join(smallest, "label").select("fp", "component_id")
    of = nodes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    return spread_join(rows, of, ["fp"], "n", F.col(id_col)).select(id_col, "fp", "component_id")


def op8_anchor_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
