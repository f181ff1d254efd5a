"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves each pre-token
that is a vocabulary entry as a whole. Tier two: the others are merged with a
heap of candidate pairs over a doubly linked list of bytes. Pre-tokens repeat,
so a batch resolves only those that a bounded table does not hold, each once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crucible.llm.common import table

#: Pre-tokens in a generation of those that a worker keeps between batches: some 250 bytes each, and there are two generations.
KEPT = 150_000
#: Bits of an id in a pair's number.
ID_BITS = 20
#: Longer pre-tokens are not kept.
KEPT_BYTES = 64

#: Stands for a byte that is no vocabulary entry.
NO_BYTE = (1 << ID_BITS) - 1

#: A displacement from here on is a place.
DIRECT = np.uint64(1 << 62)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class MinimalPerfectHash:
    """Maps n keys one-to-one onto 0..n-1 by hash and displace: buckets, largest first, each find a displacement that sends their keys to free places."""

    def __init__(self, words: list[bytes]):
        n = self.n = max(1, len(words))
        self.buckets = max(1, n // 4)
        h = _hashes(words)
        if len(np.unique(h)) != len(words):
            raise ValueError("two keys share a 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.shift = np.zeros(self.buckets, dtype=np.uint64)
        taken = np.zeros(n, dtype=bool)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(-counts, kind="stable").tolist():
            size = int(counts[b])
            if size < 2:
                break
            mine, d = h[order[starts[b] : starts[b] + size]][None, :], 0
            while True:
                at = self._place(mine, tries + np.uint64(d))
                fits = ~taken[at].any(axis=1)
                if fits.any():
                    apart = np.sort(at[fits], axis=1)
                    good = (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                    if good.any():
                        k = int(np.flatnonzero(fits)[np.flatnonzero(good)[0]])
                        break
                d += len(tries)
            taken[at[k]] = True
            self.shift[b] = d + k
        # A bucket of one key names its place: no search for the last free ones.
        alone = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~taken)[: len(alone)]
        self.shift[alone] = DIRECT + free.astype(np.uint64)

    def _place(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h + (d + np.uint64(1)) * _M1) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """A place in 0..n-1 for any words; the caller compares the key that lives there."""
        h = _hashes(words)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d >= DIRECT, (d & (DIRECT - np.uint64(1))).astype(np.int64), self._place(h, d))


class TwoTierBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        words = sorted(ranks)
        self.mph = MinimalPerfectHash(words)
        place = self.mph(words)
        self.word_at: list[bytes | None] = [None] * self.mph.n
        self.id_at = np.zeros(self.mph.n, dtype=np.int64)
        for w, p in zip(words, place.tolist(), strict=True):
            self.word_at[p], self.id_at[p] = w, ranks[w]
        self.packed_at = [np.int32(i).tobytes() for i in self.id_at.tolist()]
        if max(ranks.values(), default=0) >= NO_BYTE:
            raise ValueError(f"ids must be below {NO_BYTE}")
        self.byte_ids = [ranks.get(bytes([b]), NO_BYTE) for b in range(256)]
        self.partial = NO_BYTE in self.byte_ids
        #: The rank of two neighbours joined, by their ids.
        self.pair = {ranks[a] << ID_BITS | ranks[b]: r for w, r in ranks.items() for k in range(1, len(w)) if (a := w[:k]) in ranks and (b := w[k:]) in ranks}
        of = {i: w for w, i in ranks.items()}
        self.bytes_table = Strings([of.get(i, b"") for i in range(max(of, default=-1) + 1)])
        self.decimal_table = Strings([b"%d," % i for i in range(max(of, default=-1) + 1)])
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Pre-tokens that the young generation did not hold, and those of them that the old one did not hold either.
        self.asked = self.resolved = 0

    @classmethod
    def from_file(cls, path: str, pattern: str) -> TwoTierBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token that is no vocabulary entry: repeatedly join the pair of lowest rank, the leftmost of equals.

        A heap's entry is a pair's rank and the place where it begins; it is
        out of date if the pair at that place has another rank by now.
        """
        pair, push, pop, n = self.pair.get, heapq.heappush, heapq.heappop, len(word)
        byte = self.byte_ids
        ids = [byte[x] for x in word]
        rank = [pair(a << ID_BITS | b, -1) for a, b in pairwise(ids)]
        bits = 12 if n < 1 << 12 else 40  # small numbers are quicker
        place = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, r = x & place, x >> bits
            if rank[i] != r:
                continue
            j = right[i]
            right[i] = k = right[j]
            ids[i], ids[j], rank[j] = r, -1, -1
            if k < n:
                left[k] = i
                rank[i] = q = pair(r << ID_BITS | ids[k], -1)
                if q >= 0:
                    push(heap, q << bits | i)
            else:
                rank[i] = -1
            if (h := left[i]) >= 0:
                rank[h] = q = pair(ids[h] << ID_BITS | r, -1)
                if q >= 0:
                    push(heap, q << bits | h)
        if self.partial and NO_BYTE in ids:
            raise ValueError("a byte of a text is no vocabulary entry")
        return [x for x in ids if x >= 0]

    def resolve(self, pre_tokens: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens, as 4 bytes each."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pre_tokens]
        out: dict[str, bytes] = {}
        if raw:
            places = self.mph(raw).tolist()
            pack, word_at, id_at, merge = np.int32, self.word_at, self.packed_at, self.merge
            for p, w, at in zip(pre_tokens, raw, places, strict=True):
                out[p] = id_at[at] if word_at[at] == w else np.array(merge(w), dtype=pack).tobytes()
        return out

    def encode_batch(self, texts: list[str | None], most: int = KEPT) -> list[np.ndarray]:
        """The ids of each text. The pre-tokens that the worker does not hold are resolved together.

        What was resolved is kept in two generations of some `most`: when the
        young one is full it becomes the old one, from which pre-tokens that
        occur again return.
        """
        if len(self.kept) > most:
            self.old, self.kept = self.kept, {}
        kept, old, join, find = self.kept, self.old, b"".join, self.pattern.findall
        split = [find(text or "") for text in texts]
        got = [list(map(kept.get, pre)) for pre in split]
        open_ = [i for i, ids in enumerate(got) if None in ids]
        missing = {p for i in open_ for p, ids in zip(split[i], got[i], strict=True) if ids is None}
        if missing:
            self.asked += len(missing)
            fresh = [p for p in missing if p not in old]
            self.resolved += len(fresh)
            kept.update([(p, old[p]) for p in missing if p in old])
            kept.update(self.resolve(fresh))
            look = kept.__getitem__
            for i in open_:
                got[i] = map(look, split[i])
        out = [np.frombuffer(join(ids), dtype=np.int32) for ids in got]
        for p in missing:
            if len(p) > KEPT_BYTES:
                del kept[p]
        return out

    def decode(self, ids) -> bytes:
        return bytes(self.bytes_table(np.asarray(ids, dtype=np.int64))[0])


class Strings:
    """Byte strings by number, laid end to end: a call joins those of many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.all = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def __call__(self, numbers: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The joined bytes, and where each string ends in them."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[numbers] - (ends - size), size)
        at += np.arange(len(at))
        return memoryview(self.all[at]), ends


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> TwoTierBpe:
    """Once a worker: the vocabulary has a fixed size."""
    return TwoTierBpe.from_file(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return path, pattern


#: Rows of a batch that are encoded before they are handed on.
ROWS = 256


def lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, dtype=np.int32)])))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "token_ids", kept_tokens: int = KEPT) -> DataFrame:
    """docs with the ids of each whole text as `ids_col` (array of int), which replaces a column of that name.

    Null and empty texts have no ids. Each match of the pattern is encoded
    separately and special tokens have no meaning. Rows are independent: there
    is no shuffle, and repeated rows give repeated results. The vocabulary
    file must lie at the same path on every machine. `kept_tokens` bounds what
    a worker keeps, not the result.
    """
    path, pattern = _vocabulary(path, pattern)
    kept = [c for c in docs.columns if c != ids_col]
    at = docs.columns.index(text_col)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    order = [docs.columns.index(c) for c in kept]

    def encode(batches):
        bpe = load(path, pattern)
        for big in batches:
            for k in range(0, big.num_rows, ROWS):
                batch = big.slice(k, ROWS)
                ids = bpe.encode_batch(batch.column(at).to_pylist(), kept_tokens)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in order), lists(ids)], names=[*kept, ids_col])

    return docs.mapInArrow(encode, schema)


def _pieces(strings: Strings, flat: np.ndarray, last: np.ndarray):
    """The joined strings of the numbers, and where those of each row lie; last holds each row's end among the numbers."""
    joined, ends = strings(flat)
    at = np.concatenate([[0], ends])[last].tolist()
    return joined, list(zip(at, at[1:], strict=False))


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with the decoded bytes as `bytes_col`, which replaces a column of that name; null ids decode to no bytes."""
    path, pattern = _vocabulary(path, pattern)
    kept = [c for c in encoded.columns if c != bytes_col]
    at, order = encoded.columns.index(ids_col), [encoded.columns.index(c) for c in kept]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(bytes_col, T.BinaryType())])

    def decode(batches):
        bpe = load(path, pattern)
        for big in batches:
            for k in range(0, big.num_rows, ROWS):
                batch = big.slice(k, ROWS)
                column = batch.column(at)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                raw, cuts = _pieces(bpe.bytes_table, column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in order), pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary())], names=[*kept, bytes_col])

    return encoded.mapInArrow(decode, schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept_tokens: int = KEPT) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode_documents and decode_documents in one pass, for those who need only digests.

    The first digest is of the decimal ids joined by commas, the second of the
    bytes that the ids decode to. Rows and texts are treated as there.
    """
    path, pattern = _vocabulary(path, pattern)
    one = docs.select(id_col, text_col)

    def work(batches):
        bpe = load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for big in batches:
            for k in range(0, big.num_rows, ROWS):
                batch = big.slice(k, ROWS)
                ids = bpe.encode_batch(batch.column(1).to_pylist(), kept_tokens)
                size = np.array([len(x) for x in ids])
                flat, last = np.concatenate([*ids, np.empty(0, dtype=np.int32)]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                raw, cuts = _pieces(bpe.bytes_table, flat, last)
                text, commas = _pieces(bpe.decimal_table, flat, last)
                cols = [
                    pa.array(size, pa.int64()),
                    pa.array([sha(text[a : max(a, b - 1)]) for a, b in commas], pa.string()),  # without the last comma
                    pa.array([sha(raw[a:b]) for a, b in cuts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return one.mapInArrow(work, f"`{id_col}` {one.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_two_tier_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), kept_tokens=4 * KEPT)
