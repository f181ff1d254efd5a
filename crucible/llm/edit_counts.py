"""Token counts that follow edits.

A document is a segment tree over its pre-tokens: leaves hold some dozens of
pre-tokens with their characters and token counts, inner nodes the sums. An edit
re-encodes the pre-tokens that it touches and their boundary context: it starts
at the last boundary that no changed character can have influenced, and ends
where a new boundary meets an old one behind the edit. Then the pattern, which
only looks forward, would find the old pre-tokens again. Subtree sums on the
changed leaves' paths are updated.

Trees can be kept: build_trees makes a table of them, edit_trees takes a stored
table and edits and gives the table that follows, without reading the pattern
over texts or encoding what no edit touches.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.bpe import TwoTierBpe, _vocabulary, load
from crucible.llm.common import table

#: Pre-tokens in a generation of those whose counts a worker keeps.
KEPT = 400_000
#: Pre-tokens in a leaf when a tree is built; a leaf with FULL times as many makes the tree be built again.
LEAF, FULL = 32, 8
#: Characters that a match can look at from its start without taking them, as in 're.
REACH = 3
#: Characters behind an edit that are tried first for a common boundary.
AHEAD = 64


class Counts:
    """Token counts of pre-tokens, kept in two generations."""

    def __init__(self, bpe: TwoTierBpe):
        self.bpe, self.kept, self.old = bpe, {}, {}

    def prepare(self, distinct: set[str]) -> None:
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        missing = distinct.difference(self.kept)
        if missing:
            old = self.old
            self.kept.update([(p, old[p]) for p in missing if p in old])
            self.kept.update([(p, len(ids) >> 2) for p, ids in self.bpe.resolve([p for p in missing if p not in old]).items()])

    def of(self, pre: list[str]) -> list[int]:
        return list(map(self.kept.__getitem__, pre))


class CountTree:
    """Sums over leaves in a heap-shaped tree: node i has children 2i and 2i + 1. A leaf is a list of pre-tokens and a list of their counts."""

    def __init__(self, counts: Counts, text: str, pre: list[str] | None = None):
        self.counts, self.find, self.reencoded = counts, counts.bpe.pattern.findall, 0
        if pre is None:
            pre = self.find(text)
            counts.prepare(set(pre))
        self.reencoded = len(pre)
        self._build(pre, counts.of(pre))

    def _build(self, pre: list[str], n: list[int]) -> None:
        self.leaves = [(pre[i : i + LEAF], n[i : i + LEAF]) for i in range(0, len(pre), LEAF)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        empty = [0] * (self.base - len(self.leaves))
        self.chars = self._up([sum(map(len, p)) for p, _ in self.leaves] + empty)
        self.tokens = self._up([sum(x) for _, x in self.leaves] + empty)

    @classmethod
    def kept(cls, counts: Counts, text: str, sizes: list[int], tokens: list[int]) -> CountTree:
        """The tree of a text whose pre-tokens have these sizes in characters and these counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counts, tree.find, tree.reencoded = counts, counts.bpe.pattern.findall, 0
        ends = list(accumulate(sizes))
        tree._build([text[e - n : e] for e, n in zip(ends, sizes, strict=True)], list(tokens))
        return tree

    def state(self) -> tuple[list[int], list[int]]:
        """The sizes and counts of the pre-tokens, as kept() takes them."""
        return [len(p) for one, _ in self.leaves for p in one], [n for _, one in self.leaves for n in one]

    def apply(self, edits) -> None:
        for e in edits or []:
            self.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")

    def _up(self, level: list[int]) -> list[int]:
        """The tree over a row of leaf sums."""
        levels = [level]
        while len(level) > 1:
            level = list(map(add, level[::2], level[1::2]))
            levels.append(level)
        out = [0]
        for x in reversed(levels):
            out += x
        return out

    def _pull(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(["".join(p) for p, _ in self.leaves])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at, and the character where the leaf begins; the last leaf for the end."""
        i, begin = 1, 0
        while i < self.base:
            i *= 2
            if at >= begin + self.chars[i]:
                begin += self.chars[i]
                i += 1
        leaf = min(i - self.base, len(self.leaves) - 1)
        while i - self.base > leaf:  # behind the last leaf
            i -= 1
            begin -= self.chars[i]
        return leaf, begin

    def _boundary(self, at: int) -> tuple[int, int, int]:
        """The last boundary at or before a character: its leaf, its place there, its character."""
        leaf, pos = self._find(at)
        for k, p in enumerate(self.leaves[leaf][0]):
            if pos + len(p) > at:
                return leaf, k, pos
            pos += len(p)
        return leaf, len(self.leaves[leaf][0]), pos

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace `length` characters from `start` by `new`; both are cut to the text."""
        start = max(0, min(start, self.n_chars))
        end = min(self.n_chars, start + max(0, length))
        leaf, k, begin = self._boundary(max(0, start - REACH))
        # Old pre-tokens from there on, as far as needed.
        old, pos, at = [], begin, (leaf, k)

        def more(upto: int) -> bool:
            """Take old pre-tokens until they reach a character; False where the text ends."""
            nonlocal pos, at
            i, j = at
            while pos < upto:
                if j < len(self.leaves[i][0]):
                    old.append(self.leaves[i][0][j])
                    pos += len(old[-1])
                    j += 1
                elif i + 1 < len(self.leaves):
                    i, j = i + 1, 0
                else:
                    at = i, j
                    return False
            at = i, j
            return True

        shift, ahead = len(new) - (end - start), AHEAD
        while True:
            going_on = more(end + ahead) and pos < self.n_chars
            was = "".join(old)
            now = was[: start - begin] + new + was[end - begin :]
            bounds, p, fresh, meet = set(), begin, [], None
            for x in old:
                p += len(x)
                bounds.add(p)
            p = begin
            for m in self.find(now):
                p += len(m)
                if going_on and p + REACH + 1 > begin + len(now):
                    break  # what is not yet seen could change it
                fresh.append(m)
                if p >= start + len(new) and p - shift >= end and p - shift in bounds:
                    meet = p - shift
                    break
            if meet is not None or not going_on:
                break
            ahead *= 2
        if meet is None:
            meet = self.n_chars
        self._splice(leaf, k, meet, fresh)

    def _splice(self, leaf: int, k: int, upto: int, fresh: list[str]) -> None:
        """Put fresh in place of the pre-tokens from place k of a leaf to the character upto."""
        self.counts.prepare(set(fresh))
        self.reencoded += len(fresh)
        n = self.counts.of(fresh)
        last, begin = self._find(upto)
        keep, held = 0, self.leaves[last][0]
        while keep < len(held) and begin < upto:
            begin += len(held[keep])
            keep += 1
        rest = (held[keep:], self.leaves[last][1][keep:])
        if last < leaf:
            last, rest = leaf, ([], [])
        p, c = self.leaves[leaf]
        mine = rest if last == leaf else ([], [])
        self.leaves[leaf] = (p[:k] + fresh + mine[0], c[:k] + n + mine[1])
        for i in range(leaf + 1, last + 1):
            self.leaves[i] = rest if i == last else ([], [])
        if max(len(self.leaves[leaf][0]), len(self.leaves[last][0])) > FULL * LEAF:
            self._build([x for one, _ in self.leaves for x in one], [x for _, one in self.leaves for x in one])
            return
        for i in range(leaf, last + 1):
            node = self.base + i
            self.chars[node], self.tokens[node] = sum(map(len, self.leaves[i][0])), sum(self.leaves[i][1])
        lo, hi = (self.base + leaf) // 2, (self.base + last) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._pull(i)
            lo, hi = lo // 2, hi // 2


@lru_cache(maxsize=4)
def counts_of(path: str, pattern: str) -> Counts:
    """Once a worker."""
    return Counts(load(path, pattern))


EDITS = "array<struct<start:int,length:int,text:string>>"


def count_with_edits(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, n_edits, n_tokens_edited, n_pre_tokens, n_reencoded, edited_text (null without with_text).

    `edits_col` lists edits (start, length, text) in characters, applied one
    after the other, each to what the earlier ones left; places beyond the text
    are cut to it. n_reencoded is the number of pre-tokens that all edits
    encoded again. Null and empty texts have no tokens but can be edited; null
    edits are none. Rows are independent, so repeated rows give repeated
    results; other columns are not read.
    """
    path, pattern = _vocabulary(path, pattern)

    def work(batches):
        counts = counts_of(path, pattern)
        find = counts.bpe.pattern.findall
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch, cols = big.slice(at, 256), [[] for _ in range(6)]
                split = [find(t or "") for t in batch.column(1).to_pylist()]
                counts.prepare(set().union(*split))
                kept = counts.kept
                for pre, edits in zip(split, batch.column(2).to_pylist(), strict=True):
                    if counts.kept is not kept:  # a new generation began within the batch
                        counts.prepare(set(pre))
                    tree = CountTree(counts, "", pre)
                    before, tree.reencoded = tree.n_tokens, 0
                    tree.apply(edits)
                    for c, v in zip(cols, (before, len(edits or []), tree.n_tokens, len(pre), tree.reencoded, tree.text if with_text else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=names)

    one = docs.select(F.col(id_col), F.col(text_col), F.col(edits_col).cast(EDITS))
    names = [id_col, "n_tokens", "n_edits", "n_tokens_edited", "n_pre_tokens", "n_reencoded", "edited_text"]
    return one.mapInArrow(work, f"`{id_col}` {one.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:6]) + ", edited_text string")


TREE = "text string, sizes array<int>, counts array<int>, n_tokens long"


def _trees(batch, column, rows, id_col, more=()):
    """A batch of a table of trees: rows of (text, sizes, counts, n_tokens) and of what else belongs to each."""
    text, sizes, tokens, n, *rest = zip(*rows, strict=True)
    ints = lambda x: pa.array(x, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column(column), pa.array(text, pa.string()), ints(sizes), ints(tokens), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], names=[id_col, "text", "sizes", "counts", "n_tokens", *more])


def build_trees(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sizes, counts, n_tokens): the leaves of each document's tree, one after the other, to be stored. A null text is an empty one."""
    path, pattern = _vocabulary(path, pattern)

    def work(batches):
        counts = counts_of(path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                trees = [CountTree(counts, t or "") for t in batch.column(1).to_pylist()]
                yield _trees(batch, 0, [(t.text, *t.state(), t.n_tokens) for t in trees], id_col)

    one = docs.select(id_col, text_col)
    return one.mapInArrow(work, f"`{id_col}` {one.schema[0].dataType.simpleString()}, {TREE}")


def edit_trees(trees: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """The table of trees after edits (id, edits), with n_reencoded: the pre-tokens that a document's edits encoded again.

    Documents without edits keep their trees; edits of documents without a tree
    are left out, as are those without identifier. Identifiers must occur once in either table.
    """
    path, pattern = _vocabulary(path, pattern)

    def work(batches):
        counts = counts_of(path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch, rows = big.slice(at, 256), []
                for text, sizes, tokens, todo in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    tree = CountTree.kept(counts, text or "", sizes or [], tokens or [])
                    tree.apply(todo)
                    rows.append((tree.text, *tree.state(), tree.n_tokens, tree.reencoded))
                if rows:
                    yield _trees(batch, 0, rows, id_col, ("n_reencoded",))

    asked = edits.select(id_col, F.col(edits_col).cast(EDITS).alias("_edits"))
    both = trees.select(id_col, "text", "sizes", "counts").join(asked, id_col, "left")
    return both.mapInArrow(work, f"`{id_col}` {trees.schema[id_col].dataType.simpleString()}, {TREE}, n_reencoded long")


def sample_edits(text):
    """Three edits that the query applies to every text: an insertion at a quarter, a replacement in the middle, a deletion near the end."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    one = lambda start, length, new: F.struct(F.floor(start).cast("int").alias("start"), F.lit(length).alias("length"), F.lit(new).alias("text"))
    return F.array(one(n / 4, 0, " it's re-edited 42 times"), one(n / 2, 20, "Ünïcode ’re"), one(n * 3 / 4, 12, ""))


def op2_edit_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_with_edits(docs.withColumn("edits", sample_edits(F.col("text"))), with_text=False).drop("edited_text")
