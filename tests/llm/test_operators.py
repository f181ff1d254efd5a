"""Every operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty tables and odd columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crucible.llm import ann, bpe, components, copies, edit_counts, exact_dedup, hmm, mixing, sharding, simhash, suffix_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, source string, shard int, keep_id string, _id string, row int, fp string"
VOCAB = [a + b for a in ("ka", "lo", "mi", "ré", "Tu") for b in ("n", "sh", "ta", "x", "öl", "b")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with nulls, empties, white space, copies that differ in case, repeated rows, a very long text, and columns whose names clash."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 40, 120])) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", "  \t\n", None
    for i in range(20, 30):
        texts[i] = texts[12].upper() if i % 2 else texts[12]
    for i in range(30, 36):  # near copies
        w = texts[13 + i % 2] = prose(random.Random(99), 300)
        texts[i] = w.replace(VOCAB[i % 3], "CHANGED", 1)
    texts[40] = prose(rng, 4000)
    texts[41] = "É" * 50 + "ÀB"
    passage = prose(random.Random(5), 40)
    for i in (44, 45, 46):
        texts[i] = prose(rng, 30) + passage + prose(rng, 30)
    rows = [(i, t, None if i % 7 == 6 else f"s{i % 3}", 1, "x", "y", 2, "z") for i, t in enumerate(texts)]
    rows += [rows[12], rows[40], (None, texts[12], None, 1, "x", "y", 2, "z"), (None, "only me", "s0", 1, "x", "y", 2, "z"), (None, None, None, 1, "x", "y", 2, "z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus(), KIND).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# 5


@pytest.mark.parametrize("most_hot", [1, 8, 1024])
def test_exact_dedup(docs, most_hot):
    """Without hot texts, with some, and with all hot that have copies."""
    got = exact_dedup.content_sort_dedup(docs, salts=4, most_hot=most_hot).collect()
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[(t or "").translate(AZ)].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == sum(map(len, groups.values()))
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)  # one row stays, also of repeated rows and null identifiers


def test_exact_dedup_smallest_and_empty(docs, empty):
    got = exact_dedup.content_sort_dedup(docs, keep="smallest").filter("kept").collect()
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[(t or "").translate(AZ)].append(i)
    assert {r.keep_id for r in got} == {min((i for i in g if i is not None), default=None) for g in groups.values()}
    assert exact_dedup.content_sort_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.content_sort_dedup(docs, keep="any")


def test_exact_dedup_of_texts_with_long_common_prefixes(spark):
    """Identifiers are no numbers; texts differ behind the splitter key; most rows are copies of one text."""
    long = "x" * 5000
    rows = [(f"k{i:03}", [long, long + "A", long + "a", long + "b"][i % 4]) for i in range(80)] + [(f"m{i:03}", "HOT") for i in range(300)] + [(None, "hot")] * 3
    got = exact_dedup.content_sort_dedup(spark.createDataFrame(rows, "doc_id string, text string"), salts=8).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[hashlib.sha256(t.translate(AZ).encode()).hexdigest()].append(i)
    assert len(got) == len(rows) and {r.text_sha256 for r in got} == set(by)
    for r in got:
        assert (r.keep_id, r.group_size) == (max(i for i in by[r.text_sha256] if i), len(by[r.text_sha256]))
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.content_sort_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4


@pytest.mark.parametrize("many", [False, True])
def test_sharding(spark, docs, many):
    if many:  # one text has most rows
        docs = docs.select("doc_id", "text").unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text")))
    out = sharding.shard_by_slots(docs, shards=4, slots=64)
    rows = out.rows.collect()
    want = Counter((i, len((t or "").encode()) + 1 if t is not None else 1, zlib.crc32((t or "").encode())) for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert out.slot_map.current[r.vslot] == r.shard
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    texts = defaultdict(set)
    for r in rows:
        texts[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"hot")
    assert all(len(s) == 1 for c, s in texts.items() if c != hot and want and c != zlib.crc32((corpus()[40][1]).encode()))
    assert not many or len(texts[hot]) > 1
    stored = {(r.version, r.vslot): r.shard for r in out.stored_map.collect()}
    assert stored == {(v, s): x for v, m in enumerate(out.slot_map.versions) for s, x in enumerate(m)}


def test_rebalancing_edits():
    rng = random.Random(2)
    sizes = [rng.randrange(0, 100) for _ in range(256)]
    m = sharding.SlotMap.fresh(256, 8)
    edits = m.rebalance(sizes)
    assert edits and all(m.versions[0][s] == a and m.versions[1][s] == b for s, a, b in edits)
    load = Counter()
    for s, shard in enumerate(m.current):
        load[shard] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 5  # no single slot fits into what is left
    assert m.rebalance(sizes) == []
    grown = m.grow(sizes)
    assert grown and all(b == 8 for _, _, b in grown) and m.shards == 9
    load = Counter()
    for s, shard in enumerate(m.current):
        load[shard] += sizes[s]
    assert load[8] <= sum(sizes) / 9 and load[8] > 0.9 * sum(sizes) / 9


def test_stored_map_is_read_and_edited(spark, docs, tmp_path):
    """Four runs on one map: the first stores it, the second finds nothing to edit, the third has other bytes, the fourth one shard more."""
    path, rng = f"file://{tmp_path}/map", random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(400)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string").repartition(3, "doc_id")
    run = lambda r, n=4: sharding.shard_by_slots(frame(r), shards=n, slots=64, map_path=path)
    load = lambda out: Counter({s: sum(r["size"] for r in out.rows.collect() if r.shard == s) for s in range(out.slot_map.shards)})
    one = run(rows)
    assert one.edits and len(one.slot_map.versions) == 2
    two = run(rows)
    assert two.slot_map == one.slot_map and not two.edits
    three = run([(i, t if i % 7 else t * 5) for i, t in rows])
    moved = {s for s, _, _ in three.edits}
    assert moved and len(three.slot_map.versions) == 3 and three.slot_map.versions[:2] == one.slot_map.versions
    assert {s for s in range(64) if three.slot_map.versions[1][s] != three.slot_map.versions[2][s]} == moved
    assert max(load(three).values()) - min(load(three).values()) < 0.02 * sum(load(three).values())
    four = run(rows, 5)
    assert four.slot_map.shards == 5 and len(four.slot_map.versions) > 3 and set(load(four)) == set(range(5)) and min(load(four).values()) > 0
    assert sharding.SlotMap.stored(spark, path) == four.slot_map
    with pytest.raises(ValueError):
        run(rows, 8)


def test_law_of_bytes(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 60))) for i in range(3000)]
    out = sharding.shard_by_slots(spark.createDataFrame(rows, "doc_id long, text string"), shards=8)
    load = Counter()
    for r in out.rows.collect():
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8


def test_sharding_empty(empty):
    assert sharding.shard_by_slots(empty).rows.count() == 0


# 1


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return target
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= target[s]


def test_mixing(docs):
    run = lambda **k: sorted(mixing.mix_sources(docs, shards=5, block_words=64, **k).rows.collect(), key=repr)
    rows = run()
    assert rows == run() == run(few_sources=0)
    size = defaultdict(int)
    for (_, t, s, *_x) in corpus():
        size[s] += len(WORDS.findall(t or ""))
    want, taken = brute_targets(dict(size)), Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        n = r.first + r.second
        assert n <= 2 * r["size"] and n == sum(x["taken"] for x in r.draws)
        assert all(0 < x["taken"] <= r["size"] and 0 <= x["shard"] < 5 for x in r.draws)
        taken[r.source] += n
    assert all(0 <= want[s] - taken[s] < 1 for s in want)


def test_mixing_follows_the_tree(spark, monkeypatch):
    """Texts of one word in blocks of four: each shard gets as many blocks of each source as the tree says, disjoint, and not the stream's next ones."""
    rows = [(i, "word", f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.col("doc_id"))
    m = mixing.mix_sources(df, shards=5, block_words=4, carry=("n",))
    blocks = defaultdict(set)
    for r in m.rows.select("source", F.explode("draws").alias("d")).select("source", "d.*").collect():
        blocks[r.source, r.block].add(r.shard)
    assert all(len(s) == 1 for s in blocks.values())
    for i, s in enumerate(m.quotas):
        assert len([b for x, b in blocks if x == s]) == -(-m.quotas[s] // 4)
        assert [sum(blocks[s, b] == {k} for x, b in blocks if x == s) for k in range(5)] == m.tree[:, i].tolist()
        order = [next(iter(blocks[s, b])) for b in sorted(b for x, b in blocks if x == s)]
        assert order != sorted(order)
    places = defaultdict(list)
    for r in m.placed("n").collect():
        places[r.shard].append((r.place, r.part, r.n))
    for some in places.values():
        some.sort()
        assert [p for p, _, _ in some] == list(range(len(some))) and [q for _, q, _ in some] == sorted(q for _, q, _ in some)
        assert [d for _, _, d in some] != sorted(d for _, _, d in some)
    before = {k: sorted(d for _, _, d in v) for k, v in places.items()}
    out = lambda: [r.doc_id for r in mixing.mixed_documents(df, shards=5, block_words=4).collect()]
    order = out()
    assert Counter(order) == Counter(d for v in before.values() for d in v) and order == out()

    def all_first(quotas, shards, seed=42):
        t = np.zeros((shards, len(quotas)), dtype=np.int64)
        t[0] = quotas
        return t

    monkeypatch.setattr(mixing, "splitting_tree", all_first)
    assert {r.shard for r in mixing.mix_sources(df, shards=5, block_words=4, carry=("n",)).placed("n").collect()} == {0}
    assert out() != order


def test_hypergeometric_beyond_the_sampler(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(mixing, "LARGE", 0)
    for good, bad, n in ((60, 20, 40), (5, 500, 30), (7, 0, 3), (0, 7, 3), (3, 9, 12), (400, 400, 1)):
        got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)
        mean, whole = n * good / (good + bad), good + bad
        var = mean * bad / whole * (whole - n) / max(1, whole - 1)
        assert abs(got.mean() - mean) <= 5 * np.sqrt(var / 4000) + 1e-9 and abs(got.var() - var) <= 0.15 * var + 1e-9
    far = [mixing.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 5 * 10**9) for _ in range(30)]
    assert len(set(far)) == 30 and abs(np.mean(far) - 3 * 10**9) < 5 * 25_000 / np.sqrt(30)


def test_permutation_is_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 97, 1000):
        a, c = mixing.permutation(n, rng)
        assert sorted((a * b + c) % n for b in range(n)) == list(range(n))


def test_splitting_tree_is_exact_and_fair():
    t = mixing.splitting_tree([100, 0, 37, 5], 8, seed=1)
    assert t.sum(axis=0).tolist() == [100, 0, 37, 5] and np.ptp(t.sum(axis=1)) <= 1
    mean = np.mean([mixing.splitting_tree([60, 20], 4, seed=s) for s in range(200)], axis=0)
    assert np.allclose(mean, [[15, 5]] * 4, atol=0.5)
    assert mixing.splitting_tree([], 3).shape == (3, 0)
    big = mixing.splitting_tree([3_000_000_000, 2_000_000_000], 4)
    assert big.sum(axis=0).tolist() == [3_000_000_000, 2_000_000_000]


def test_mixed_documents(docs, empty):
    more = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("s")).withColumn("taken", F.lit(1)).withColumn("_mix_row", F.lit("r")).withColumn("shard", F.lit(9))
    out = mixing.mixed_documents(more)
    assert out.columns == more.columns
    words = defaultdict(int)
    source = {}
    for r in out.collect():
        words[r.source] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    size = defaultdict(int)
    for (_, t, s, *_x) in corpus():
        size[s] += len(WORDS.findall(t or ""))
    assert all(0 <= want - words[s] < 1 for s, want in brute_targets(dict(size)).items()) and not source
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mix_sources(empty).rows.count() == 0


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, " ", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.first + r.second) for r in mixing.mix_sources(df).rows.collect()] == [(0.0, 0)] * 3


# 10


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.load(path, P.PATTERN)


def test_bpe_equals_library(docs, empty, tokenizer):
    library, _ = tokenizer
    for r in bpe.decode_documents(bpe.encode_documents(docs)).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r["row"] == 2
    want = Counter()
    for i, t in rows_of(docs):
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == want
    assert bpe.digests(empty).count() == 0


def test_bpe_on_odd_texts(tokenizer):
    library, own = tokenizer
    rng = random.Random(3)
    pieces = ["a", "b", "é", "漢", "🙂", " ", "  ", "\n", "'s", "'", "12", "!?", "<|endoftext|>", "‍", "ab" * 40, "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["x" * 50_000, "ab" * 30_000, " " * 10_000 + "a"]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_generations(monkeypatch, tokenizer):
    library, own = tokenizer
    monkeypatch.setattr(bpe, "KEPT", 10)
    for i in range(30):
        texts = [prose(random.Random(i % 4), 20), "new" * i]
        assert [x.tolist() for x in own.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_minimal_perfect_hash():
    words = [f"w{i}".encode() for i in range(3000)]
    h = bpe.MinimalPerfectHash(words)
    assert sorted(h(words).tolist()) == list(range(3000))
    assert ((h([b"other", b""]) >= 0) & (h([b"other", b""]) < 3000)).all()


# 2


def test_trees_are_kept_between_runs(spark, docs, tmp_path, tokenizer):
    """Two rounds of edits on stored trees: counts as of the edited texts, and only what the edits touch is encoded again."""
    library, own = tokenizer
    texts = {i: prose(random.Random(i), 30 * i) for i in range(12)} | {50: "", 51: "it's a test 's  '", 52: prose(random.Random(52), 5000)}
    df = spark.createDataFrame([*texts.items(), (60, None)], "doc_id long, text string")
    texts[60] = ""
    edit_counts.build_trees(df).write.parquet(str(tmp_path / "0"))
    rng = random.Random(9)
    for turn in range(2):
        todo = {i: [(rng.randrange(len(t) + 2), rng.choice([0, 3, 20]), rng.choice(["", "new words here", " 're", "12"])) for _ in range(2)] for i, t in texts.items() if i % 3 != turn}
        edits = spark.createDataFrame([*todo.items(), (999, [(0, 0, "nothing")])], "doc_id long, edits array<struct<start:int,length:int,text:string>>")
        trees = spark.read.parquet(str(tmp_path / str(turn)))
        edit_counts.edit_trees(trees, edits).write.parquet(str(tmp_path / str(turn + 1)))
        for i, some in todo.items():
            for at, n, new in some:
                at = min(at, len(texts[i]))
                texts[i] = texts[i][:at] + new + texts[i][at + n :]
        got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        assert {i: (r.text, r.n_tokens, sum(r.counts)) for i, r in got.items()} == {i: (t, *[len(library.encode_ordinary(t))] * 2) for i, t in texts.items()}
        assert all([t[e - n : e] for e, n in zip(itertools.accumulate(r.sizes), r.sizes, strict=True)] == own.pattern.findall(t) for i, t in texts.items() for r in [got[i]])
        assert all(got[i].n_reencoded <= 40 for i in todo) and all(not r.n_reencoded for i, r in got.items() if i not in todo)


def test_edit_counts_equal_recounts(tokenizer):
    library, own = tokenizer
    rng = random.Random(5)
    pieces = ["a", "b", "the", " ", "  ", "\n", "'", "re", "s", "1", "22", "é", "漢", ".", "!?", "'s", " '", "\t"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 20, 200, 1500])))
        tree = edit_counts.CountTree(edit_counts.Counts(own), text)
        for _ in range(rng.randrange(1, 6)):
            at, n, new = rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 5, 50, 400]), "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 5, 300])))
            tree.edit(at, n, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + n :]
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode_ordinary(text))


def test_an_edit_reencodes_little(tokenizer):
    tree = edit_counts.CountTree(edit_counts.Counts(tokenizer[1]), "hello world " * 20_000)
    tree.reencoded = 0
    tree.edit(100_000, 5, "xx")
    assert 0 < tree.reencoded < 100


def test_edit_counts_with_small_generations(monkeypatch, tokenizer):
    library, own = tokenizer
    monkeypatch.setattr(edit_counts, "KEPT", 5)
    counts = edit_counts.Counts(own)
    for i in range(20):
        tree = edit_counts.CountTree(counts, prose(random.Random(i % 3), 30))
        tree.edit(10, 3, f"neu{i} words")
        assert tree.n_tokens == len(library.encode_ordinary(tree.text))


def test_edit_counts_in_spark(docs, empty, tokenizer):
    library, _ = tokenizer
    edited = docs.withColumn("edits", F.when(F.col("doc_id") % 5 != 0, edit_counts.sample_edits(F.col("text"))))
    for r in edit_counts.count_with_edits(edited).collect():
        assert r.n_tokens_edited == len(library.encode_ordinary(r.edited_text))
        assert r.n_edits == (0 if r.doc_id is None or r.doc_id % 5 == 0 else 3)
    before = Counter((r.doc_id, r.n_tokens) for r in edit_counts.count_with_edits(edited).collect())
    assert before == Counter((i, len(library.encode_ordinary(t or ""))) for i, t in rows_of(docs))
    assert edit_counts.count_with_edits(empty.withColumn("edits", F.lit(None).cast(edit_counts.EDITS))).count() == 0


# 8


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate(AZ))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    want = [(i, brute_fingerprint(t)) for i, t in rows_of(docs)]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(want)
    fps = sorted({f for _, f in want})
    of = brute_components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    first = {}
    for i, f in want:
        if i is not None:
            first[of[f]] = min(first.get(of[f], i), i)
    for r in got:
        assert r.component_id == first.get(of[r.fp % (1 << 64)])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [4, 512])
def test_links_lose_nothing(spark, hot):
    """Random fingerprints around centres, also where anchors are crowded and divided."""
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(40):
            x = c
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(map(signed, fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(r.src, r.dst) for r in simhash.link_fingerprints(df, hot).collect()]
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    assert all(near(a, b) for a, b in links)
    assert brute_components(links, fps) == brute_components([(a, b) for a in fps for b in fps if a < b and near(a, b)], fps)


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 31, 300)
    rows, found = simhash.anchors(x)
    assert (simhash.syndrome(found) == 0).all()
    near = defaultdict(set)
    for r, a in zip(rows.tolist(), found.tolist(), strict=True):
        assert (int(x[r]) ^ a).bit_count() <= 2
        near[r].add(a)
    assert all(len(s) in (1, 16) for s in near.values())
    for bit in range(31):
        r2, f2 = simhash.anchors(x ^ (1 << bit))
        other = defaultdict(set)
        for r, a in zip(r2.tolist(), f2.tolist(), strict=True):
            other[r].add(a)
        assert all(near[r] & other[r] for r in range(300))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 800), (800, 900)], "src long, dst long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 800: 800, 900: 800}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_components_with_hubs(spark):
    """Stars whose centres are the smallest, the largest and a middle node, and chains between them."""
    rng = random.Random(4)
    pairs = [(1, 10 + i) for i in range(400)] + [(9000, 1000 + i) for i in range(400)] + [(2000, x) for x in rng.sample(range(1900, 2100), 150)] + [(i, i + 1) for i in range(5000, 5040)] + [(1, 5000), (7000, 7001)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long").repartition(4), many_edges=0).collect()}
    assert got == brute_components([(a, b) for a, b in pairs if a != b], {x for p in pairs for x in p if p[0] != p[1]})


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(AZ))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


def test_near_copies_against_all_pairs(spark, tmp_path):
    rng, rows = random.Random(11), []
    for g in range(12):
        base = [rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(rng.choice([60, 200, 500]))]
        rows.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 60))):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append(" ".join(w))
    rows += [None, "", "short text", "other text"]
    df = spark.createDataFrame(list(enumerate(rows)), "row long, text string")
    got = {r.row: r.label for r in copies.near_copies(df, "row").collect()}
    sets = [shingles(t) for t in rows]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jac(a, b) >= 0.8]
    want = brute_components(pairs, range(len(rows)))
    assert all(got[i] == got[want[i]] or i == want[i] for i in range(len(rows)))
    assert {i: got[i] for i in range(len(rows))} == want


def groups_of_pairs(spark, rows, **params):
    """What near_copies gives and what all pairs give."""
    df = spark.createDataFrame(list(enumerate(rows)), "row long, text string")
    got = {r.row: r.label for r in copies.near_copies(df, "row", **params).collect()}
    sets = [shingles(t) for t in rows]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return got, brute_components([(a, b) for a in range(len(rows)) for b in range(a) if jac(a, b) >= 0.8], range(len(rows)))


def test_near_copies_in_template_families(spark):
    """Documents of one template, J some 0.76 to each other, and among them pairs that differ in their tails, J 0.80 to 0.85."""
    rng, rows = random.Random(3), []
    fresh = lambda n: [f"w{rng.random()}" for _ in range(n)]
    template = fresh(265)
    for i in range(150):
        own = template + fresh(37)
        rows.append(" ".join(own))
        if i % 3 == 0:
            cut = rng.randrange(24, 30)
            rows.append(" ".join(own[:-cut] + fresh(cut)))
    got, want = groups_of_pairs(spark, rows)
    assert 40 < len(rows) - len(set(want.values())) < len(rows) - 1
    assert got == want


def test_near_copies_in_one_large_group(spark):
    """Many copies of one text that differ in few words, of which the exact check joins some only, and a chain of copies."""
    rng = random.Random(4)
    base, rows = [f"w{rng.random()}" for _ in range(120)], []
    for i in range(2300):
        w = list(base)
        for k in rng.sample(range(0, 120, 6), 2 + (i % 9 == 0)):
            w[k] = f"e{rng.random() if i % 2 else rng.randrange(3)}"
        rows.append(" ".join(w))
    chain = [f"c{k}" for k in range(260)]
    rows += [" ".join(chain[k : k + 200]) for k in range(0, 60, 15)]
    got, want = groups_of_pairs(spark, rows)
    assert 1 < len(set(want.values())) < len(rows) - 100
    assert got == want


def test_near_copies_when_keys_are_divided(spark):
    """Keys of many small parts: two families that few pairs join, rows without a partner, and shingles that most texts of a pack have."""
    rng, rows = random.Random(6), []
    base = [f"w{rng.random()}" for _ in range(150)]
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(0, 75, 5) if i % 2 else range(75, 150, 5), rng.randrange(2, 7)):
            w[k] = f"e{rng.random()}"
        rows.append(" ".join(w))
    got, want = groups_of_pairs(spark, rows, part=16, reach=2)
    assert 2 < len(set(want.values())) < 200
    assert got == want


def test_simhash_leaves_the_join_less_to_ask(spark, monkeypatch):
    """What SimHash links and whole sets confirm is not asked by the prefix join; without SimHash the join asks it, and the groups are the same."""
    rng, rows = random.Random(8), []
    for _ in range(30):
        base = [f"w{rng.random()}" for _ in range(1000)]
        for k in range(2):
            w = list(base)
            w[rng.randrange(1000)] = f"e{rng.random()}"
            rows.append(" ".join(w))
    staged, first = [], copies.stage
    monkeypatch.setattr(copies, "stage", lambda df, name: (staged.append((name, first(df, name))), staged[-1][1])[1])

    def asked_by_join():
        staged.clear()
        got, want = groups_of_pairs(spark, rows)
        assert got == want and len(set(want.values())) == 30
        asked = {(r.src, r.dst) for name, df in staged if name == "copies-pairs" for r in df.collect()}
        proposed = {(r.src, r.dst) for r in next(df for name, df in staged if name == "copies-pairs").collect()}
        return len(asked), len(asked - proposed)

    every, left = asked_by_join()
    assert every == 30 and 0 < left < 15
    monkeypatch.setattr(copies, "link_fingerprints", lambda fps: fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0))
    assert asked_by_join()[1] < every and sum(name == "copies-pairs" for name, _ in staged) >= 2


def test_jobs_of_components_and_near_copies(spark):
    """The driver's memory goes to plans and jobs: few edges take few of them, and turns without questions none."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long"))
    of_path = jobs() - before
    text = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate([*text, text[3] + " end", text[5].upper()])), "row long, text string")
    before = jobs()
    assert sum(r.row != r.label for r in copies.near_copies(df, "row").collect()) == 2
    assert of_path <= 65 and jobs() - before <= 110


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(7)
    filter_ = copies.Filter(0.8)
    for n in (1, 9, 40, 300, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 42, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 42, 1 + n // 9, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            bits = [np.frombuffer(copies.parity(x), dtype=np.uint64)[None] for x in (a, b)]
            one = lambda x: np.array([x])
            may = filter_(one(len(a)), one(0), one(1), bits[0], one(len(b)), one(0), one(2), bits[1])[0]
            assert may or both < 0.8 * (len(a) + len(b) - both)


def test_near_copies_with_a_repeated_majority(spark):
    """One shingle makes most of each text; what else they say differs, but for two."""
    rng = random.Random(5)
    rows = ["- " * 200 + " ".join(f"w{rng.random()}" for _ in range(120)) for _ in range(20)]
    rows += [rows[7] + " more", rows[9].upper()]
    got, want = groups_of_pairs(spark, rows)
    assert got == want == {**{i: i for i in range(20)}, 20: 7, 21: 9}


# 7


def brute_removal(rows):
    """rows in order of place: the bytes that strings of 100 bytes cover which occurred before."""
    seen, out = set(), []
    for raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        out.append(gone)
    return out


def check_removal(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = Counter()
    for (i, t), gone in zip(order, brute_removal([(t or "").encode() for _, t in order]), strict=True):
        raw = (t or "").encode()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()).hexdigest()] += 1
    have = Counter((i, n, sum(x["to"] - x["from"] for x in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in got)
    assert have == want


@pytest.mark.parametrize(("hot", "scanned"), [(512, 1 << 22), (3, 2000)])
def test_removal_of_repeats(docs, empty, monkeypatch, hot, scanned):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SCANNED_BYTES", scanned)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", scanned)
    check_removal(suffix_dedup.remove_repeats(docs).collect(), rows_of(docs))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [512, 5, 1])
def test_removal_around_common_passages(spark, tmp_path, monkeypatch, hot):
    """A line and a passage of 90 to 130 bytes in most texts, with other text around: anchors with many contexts, divided once and twice."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng, rows = random.Random(13), []
    line, passage = "a common line that stands in most of the texts", "".join(rng.choice("abcdefgh ") for _ in range(130))
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(0, 4)):
            parts.append(rng.choice([line, passage, passage[:99], passage[5:115], passage[:110], "z" * rng.randrange(90, 260), "ab" * 70]))
            parts.append(" ".join(word() for _ in range(rng.randrange(0, 6))))
        rows.append((i * 7 % 60, "\n".join(parts)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    check_removal(suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect(), rows)


def test_difference_cover_sort():
    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.randrange(1, rng.choice([2, 3, 5, 27]) + 1) for _ in range(rng.randrange(1, 70))])
        assert suffix_dedup.difference_cover_sort(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# 3


def test_hidden_markov(docs, empty):
    got = hmm.score_documents(docs, rounds=1).collect()
    rows, train = rows_of(docs), Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*WORDS.findall((t or "").translate(AZ)), "\0end"]
    for i, t in rows:
        if not held(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = defaultdict(list)
    for i, t in rows:
        w = tokens(t)
        want[i].append((len(w), sum(train[x] > 0 for x in w), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    have = defaultdict(list)
    for r in got:
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.score < 0
        have[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    assert hmm.score_documents(empty).count() == 0


def small_params(rng, k=3, c=6):
    x = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1])
    return hmm.Params(x(k), x(k, k), x(k, c))


def test_forward_equals_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    p = small_params(rng)
    texts = [rng.integers(0, 6, n).astype(np.int16) for n in (1, 2, 5, 4)]
    for t, got in zip(texts, hmm.log10_likelihood(texts, p, lanes=3), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(t)):
            q = p.start[path[0]] * p.emit[path[0], t[0]]
            for a, b, o in zip(path, path[1:], t[1:], strict=False):
                q *= p.move[a, b] * p.emit[b, o]
            total += q
        assert abs(got - math.log10(total)) < 1e-9


def test_baum_welch_counts_equal_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    p = small_params(rng)
    texts = [rng.integers(0, 6, n).astype(np.int16) for n in (4, 1, 3, 6)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for t in texts:
        weights = {}
        for path in itertools.product(range(3), repeat=len(t)):
            q = p.start[path[0]] * p.emit[path[0], t[0]]
            for a, b, o in zip(path, path[1:], t[1:], strict=False):
                q *= p.move[a, b] * p.emit[b, o]
            weights[path] = q
        z = sum(weights.values())
        for path, q in weights.items():
            starts[path[0]] += q / z
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += q / z
            for s, o in zip(path, t, strict=True):
                emits[s, o] += q / z
    for cells in (1, 3, 5, 1000):  # blocks of one step and more
        got = hmm.expected_counts(texts, p, cells)
        assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits)
        assert got[3] == pytest.approx(math.log(10) * hmm.log10_likelihood(texts, p).sum())
    before, after = got[3], hmm.expected_counts(texts, hmm.maximise(*got[:3], np.zeros(6) + 1e-9))[3]
    assert after > before


def test_scores_equal_a_brute_force_model(spark, monkeypatch):
    """All of the query's model again, with plain recursions: classes, their laws, the rounds over whole texts, the words in their classes."""
    own, rounds = 5, 2
    for name, v in (("HEAD", 20), ("OWN", own), ("END", own + hmm.SHARED), ("CLASSES", own + 1 + hmm.SHARED)):
        monkeypatch.setattr(hmm, name, v)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 30]))) for i in range(60)] + [(60, "One two three of none"), (61, prose(rng, 60))]
    got = {r.doc_id: r.score for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rounds=rounds).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: WORDS.findall(t.translate(AZ)) for i, t in rows}
    c, a = Counter(), Counter()
    for i, w in words.items():
        a.update(w)
        c.update([] if held(i) else w)
    top = sorted(c, key=lambda w: (-c[w], w.encode()))[:own]
    end = own + hmm.SHARED
    class_of = lambda w: top.index(w) if w in top else own + zlib.crc32(w.encode()[-hmm.SUFFIX :]) % hmm.SHARED
    mass, kinds = np.zeros(end + 1), np.zeros(end + 1)
    for w in a:
        mass[class_of(w)] += c[w]
        kinds[class_of(w)] += c[w] > 0
    mass[end] = sum(not held(i) for i in words)
    prior = (mass + 0.5) / (mass + 0.5).sum()
    obs = {i: np.array([*map(class_of, w), end], dtype=np.int16) for i, w in words.items()}
    train = [obs[i] for i in words if not held(i)]
    p = hmm.first_params(sorted(hmm.windows_of(train), key=lambda w: w.tobytes()), prior)
    k = len(p.move)

    def forward(o):
        alpha = [p.start * p.emit[:, o[0]]]
        for x in o[1:]:
            alpha.append((alpha[-1] @ p.move) * p.emit[:, x])
        return alpha

    for _ in range(rounds):
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, end + 1))
        for o in train:
            alpha, beta = forward(o), [np.ones(k)]
            for x in o[:0:-1]:
                beta.insert(0, p.move @ (p.emit[:, x] * beta[0]))
            z = alpha[-1].sum()
            for t, x in enumerate(o):
                emits[:, x] += alpha[t] * beta[t] / z
                if t:
                    moves += alpha[t - 1][:, None] * p.move * (p.emit[:, x] * beta[t])[None] / z
            starts += alpha[0] * beta[0] / z
        p = hmm.maximise(starts, moves, emits, prior)
    for i, w in words.items():
        inside = sum(math.log10((c[x] + 0.5) / (mass[class_of(x)] + 0.5 * (kinds[class_of(x)] + 1))) for x in w if x not in top)
        assert got[i] == pytest.approx(math.log10(forward(obs[i])[-1].sum()) + inside, rel=1e-9)


def test_hidden_markov_probabilities_add_up(spark):
    """The probabilities of all texts of one word, known ones and one unknown word of each class, and of the empty text add up to at most one."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 12)) for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = sorted({w for _, t in rows for w in WORDS.findall(t.translate(AZ))})
    unknown = {}
    for i in range(20_000):
        w = f"?{i}"
        unknown.setdefault(hmm.shared_class(w.encode()), w)
    ids = iter(i for i in range(1000, 100_000) if zlib.crc32(str(i).encode()) % 5 == 1)
    asked = [(next(ids), w) for w in [*words, *unknown.values(), ""]]
    got = hmm.score_documents(spark.createDataFrame(rows + asked, "doc_id long, text string"), rounds=1).filter("held_out").collect()
    total = sum(10**r.score for r in got)
    assert len(got) == len(asked) and 0 < total <= 1 + 1e-9


def test_hidden_markov_beats_its_base_on_two_languages(spark):
    rng = random.Random(4)
    langs = [[f"{x}{i}{y}" for i in range(200)] for x, y in (("a", "ing"), ("z", "keit"))]
    df = spark.createDataFrame([(i, " ".join(rng.choice(langs[i % 2]) for _ in range(120))) for i in range(200)], "doc_id long, text string")
    h = [r for r in hmm.score_documents(df).collect() if r.held_out]
    assert sum(r.score for r in h) > sum(r.base_score for r in h) + 0.2 * sum(r.n_tokens for r in h)


def test_held_out_texts_do_not_shape_the_model(spark, monkeypatch):
    for name, v in (("HEAD", 20), ("OWN", 5), ("END", 5 + hmm.SHARED), ("CLASSES", 6 + hmm.SHARED)):
        monkeypatch.setattr(hmm, name, v)
    rng = random.Random(9)
    rows = [(i, prose(rng, 20)) for i in range(60)] + [(1000, "x" * 5000 + " " + prose(rng, 5))] * 3
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    other = [(i, t + " newly seen words" * 200 if held(i) else t) for i, t in rows]
    score = lambda rows: sorted((r.doc_id, r.score, r.base_score) for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rounds=1).collect() if not r.held_out)
    was, now = score(rows), score(other)
    assert len(was) > 40 and [r[0] for r in was] == [r[0] for r in now]
    assert np.allclose([r[1:] for r in was], [r[1:] for r in now], rtol=1e-12)


def test_hidden_markov_without_training_texts(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = hmm.score_documents(df).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)


def test_rare_words_meet_their_counts(docs, monkeypatch):
    """With few words on the workers most counts come from the join."""
    want = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.score_documents(docs, rounds=1).collect()}
    monkeypatch.setattr(hmm, "HEAD", 8)
    monkeypatch.setattr(hmm, "OWN", 4)
    monkeypatch.setattr(hmm, "END", 4 + hmm.SHARED)
    monkeypatch.setattr(hmm, "CLASSES", 5 + hmm.SHARED)
    got = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.score_documents(docs, rounds=1).collect()}
    assert got == want


# 9


def vectors(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).astype(np.float32)
    m[50:70] = m[3]  # equal vectors
    return m * rng.uniform(0.5, 2.0, (n, 1)).astype(np.float32) if seed else m


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest(spark, seed):
    m = vectors(seed=seed)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(m)]
    rows += [(1000, None, 0, "x"), (1020, [0.0] * 16, 0, "x"), (1040, [float("nan")] + [1.0] * 15, 0, "x"), (1060, [float("inf")] + [1.0] * 15, 0, "x"), (1080, [None] + [1.0] * 15, 0, "x"), (None, m[0].tolist(), 0, "x"), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, shard string")
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 20 == 0, shards=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    e, hits = m.astype(np.float64), 0
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(abs(s - float(e[q] @ e[i])) < 1e-9 for _, i, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        want = sorted((-round(float(e[q] @ e[i]), 12), i) for i in range(400) if i != q)[:20]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.97


def test_nearest_with_few_or_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], kind)
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(few, lambda i: i % 20 == 0).collect())
    assert got == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert ann.nearest(few.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(few.limit(1), lambda i: i % 20 == 0).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    m = vectors(200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, ann.nearest(df, lambda i: i % 5 == 0, shards=2).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, ann.nearest(df, lambda i: i % 5 == 0, shards=2).collect())) == want


def test_nearest_with_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(100, [1.0]), (120, m[0].tolist() + [1.0]), (140, []), (160, None)]
    ask = lambda r: sorted(map(tuple, ann.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, shards=2).collect()))
    assert ask(rows + odd) == ask(rows) and len(ask(rows)) == 60


def test_robust_pruning_keeps_diverse_edges():
    v = np.array([[0, 0], [1, 0], [1.05, 0], [0, 2], [-3, 0]], dtype=np.float32)
    kept = ann.robust_prune(v, np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, 4, -1]


# 6


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(VOCAB) for _ in range(rng.choice([5, 30, 200]))]
        bad = i % 8 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["rotten", "swine!", "Vile" + rng.choice(["a", "b", "c"])]))
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return docs, labels


def test_chain_finds_toxic_texts(spark):
    rows, marks = toxic_corpus()
    docs = spark.createDataFrame([*rows, (None, None), (9000, ""), rows[8]], "doc_id long, text string").withColumn("rejected", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (None, 1), (2, None), marks[0]], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels).collect()
    truth = {i: i % 8 == 0 for i, _ in rows}
    wrong = [r.doc_id for r in got if r.doc_id in truth and r.rejected != truth[r.doc_id]]
    assert len(got) == len(rows) + 3 and not wrong
    assert not any(r.rejected for r in got if not r.text)


def test_nothing_to_learn_rejects_nothing(spark):
    rows, _ = toxic_corpus(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(i, 0) for i in range(40)], [(i, 1) for i in range(40)]):
        assert not any(r.rejected for r in toxicity.judge(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    assert toxicity.judge(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def brute_logistic(x, y, l2=1e-3):
    """Newton's method on the dense matrix; the last column is the free bias."""
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    ridge, p = np.diag([l2] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ p))
        p = p - np.linalg.solve((x * (w * m * (1 - m))[:, None]).T @ x + ridge, x.T @ (w * (m - y)) + ridge @ p)
    return p


def test_chain_equals_brute_force():
    """Three categories, each model with the features that its folds allow and the out-of-fold probabilities of the earlier ones."""
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    noise = rng.random((300, 3)) < 0.15
    labels = np.stack([x[:, 0] > 0, (x[:, 1] > 0) | (x[:, 0] > 0), (x[:, 0] + x[:, 2]) > 0], axis=1) ^ noise
    labels, fold = labels.astype(np.int64), np.arange(300) % 5
    allowed = [np.arange(6) != f for f in range(5)] + [np.ones(6, dtype=bool)]
    rows = [np.flatnonzero(r) for r in x]
    index = {c: i for i, c in enumerate("abcdef")}
    chain, held = toxicity.fit_chain(rows, labels, index, "xyz", fold, allowed)
    want, whole = np.zeros((300, 3)), np.zeros((300, 3))
    for c in range(3):
        for f in range(5):
            some = lambda pick: np.concatenate([(x * allowed[f])[pick], want[pick, :c], np.ones((pick.sum(), 1))], axis=1)  # noqa: B023, E731
            want[fold == f, c] = 1 / (1 + np.exp(-some(fold == f) @ brute_logistic(some(fold != f), labels[fold != f, c].astype(float))))
        every = np.concatenate([x, want[:, :c], np.ones((300, 1))], axis=1)
        p = brute_logistic(every, labels[:, c].astype(float))
        whole[:, c] = 1 / (1 + np.exp(-np.concatenate([x, whole[:, :c], np.ones((300, 1))], axis=1) @ p))
    assert np.abs(held - want).max() < 2e-3 and np.abs(chain.predict(rows) - whole).max() < 2e-3
    assert chain.links[1][0] > 0 and chain.links[2][:2].any() and not chain.links[0].any()
    assert 0 < chain.reject_at < 1
    # A fold's labels have no say in its own probabilities.
    flipped = labels.copy()
    flipped[fold == 2, 0] ^= 1
    assert np.array_equal(toxicity.fit_chain(rows, flipped, index, "xyz", fold, allowed)[1][fold == 2, 0], held[fold == 2, 0])


def test_best_bar():
    y = np.array([1, 1, 0, 1, 0, 0])
    assert toxicity.best_bar(np.array([0.9, 0.8, 0.2, 0.7, 0.1, 0.1]), y) == pytest.approx(0.45)
    assert toxicity.best_bar(np.full(6, 0.5), y) == 1.0
    assert toxicity.best_bar(np.arange(6) / 6, np.zeros(6, dtype=int)) == toxicity.best_bar(np.zeros(0), np.zeros(0, dtype=int)) == 1.0


def test_chain_reads_whole_texts_and_one_text_of_an_identifier(spark):
    rows, marks = toxic_corpus()
    long = " ".join(random.Random(3).choice(VOCAB) for _ in range(200_000))
    docs = spark.createDataFrame([*rows, *[(i, "another text") for i, _ in marks[:40]], (7001, long + " rotten swine! Vileb"), (7002, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2, y) for i, y in marks], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert chain.categories == ("low_quality", "toxic")
    bracketed = toxicity.train(docs, labels, categories={"bad": "(toxic > 0)", "toxic": "toxic > 0"})
    assert bracketed.categories == ("bad", "toxic")
    with pytest.raises(AnalysisException):
        toxicity.train(docs, labels, categories={"bad": "rude > 0"})
    got = {r.doc_id: r.bad for r in toxicity.judge(docs.filter("doc_id > 7000"), labels.limit(0), prefix="q_", flag="bad").collect()}
    assert got == {7001: False, 7002: False}
    got = {r.doc_id: r.rejected for r in toxicity.judge(docs, labels).filter("doc_id > 7000").collect()}
    assert got == {7001: True, 7002: False}
