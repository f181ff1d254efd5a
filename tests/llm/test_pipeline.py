"""The pipeline's stages on a small corpus, each against its own brute-force version, and the driver contract."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tests_llm_helpers import AZ, brute_targets, shingles, toxic_rows  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, labels = toxic_rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    seen = {}
    for name, step in P.STAGES:
        before = docs.collect()
        step(spark, docs, folder).write.parquet(str(tmp_path / name))
        after_df = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, after_df.collect())
        if name != "bpe":
            assert after_df.columns == docs.columns
        docs = after_df
    before, after = seen["toxicity"]
    bad = lambda t: bool(re.search("rotten|swine|vile", (t or "").lower()))
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if not bad(r.text))
    before, after = seen["exact_dedup"]
    best = defaultdict(list)
    for r in before:
        best[(r.text or "").translate(AZ)].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(max(v) for v in best.values())
    before, after = seen["simhash_near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept, ids = {r.doc_id for r in after}, sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and jac(a, b) >= 0.8]
    assert pairs and not any(a in kept and b in kept for a, b in pairs)
    assert all(any(i in p for p in pairs) for i in set(ids) - kept)
    before, after = seen["mixing"]
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len(WORDS.findall(r.text or ""))
    for r in after:
        taken[r.source] += len(WORDS.findall(r.text))
    assert all(0 <= want - taken[s] < 1 for s, want in brute_targets(dict(size)).items())
    before, after = seen["bpe"]
    assert Counter(r.decoded_sha256 for r in after) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before)
    whole = P.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after))


def test_empty_tables(spark, folder, tmp_path):
    for n in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{n}.parquet").limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_contract():
    import __spark_entry__ as entry
    from crucible.llm.queries import ORACLE_SQL, QUERIES

    numbers = Counter(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == dict.fromkeys(range(1, 13), 1)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    random.seed(0)


#: Names that a stage might use for itself.
CLASHES = ("_row", "row", "label", "rejected", "p_toxic", "_mix_row", "shard", "place", "_id", "kept", "size", "taken", "fp", "key", "part")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, null identifiers with text, and columns of clashing names."""
    d, rng = tmp_path_factory.mktemp("odd"), random.Random(7)
    words = lambda n: " ".join(f"{rng.choice(['ka', 'lo', 'mi', 'ré'])}{rng.randrange(500)}" for _ in range(n))
    long, near = words(60_000), words(200)
    docs = [(i, words(rng.choice([3, 40])), "en", f"s{i % 3}", 1) for i in range(40)]
    docs += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \t", "en", "s0", 2), (None, None, None, None, None)]
    docs += [(60, long, "en", "s1", len(long)), (61, long + " more", "en", "s1", len(long) + 5), (62, near, "en", "s2", 1), (None, near + " end", "en", "s2", 1), (None, "only here, without identifier", "en", None, 1)]
    docs += [docs[3], docs[3], (3, docs[3][1], "de", "s9", 7), (70, docs[5][1].upper(), "en", "s0", 1)]
    docs = [(*r, *(f"{c}{i}" for c in CLASHES)) for i, r in enumerate(docs)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame(docs, kind).repartition(3, "lang").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    all_rows = {r._row: r for r in docs.collect()}
    for name, step in P.STAGES:
        step(spark, docs, odd).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "bpe":
            assert after.count() == docs.count()
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        for r in after.collect():  # columns keep their values
            was = all_rows[r._row]
            assert [r[c] for c in CLASHES] == [was[c] for c in CLASHES] and (r.doc_id, r.source) == (was.doc_id, was.source)
            assert name == "mixing" or r.text == was.text
        if name == "exact_dedup":
            have = Counter((r.text or "").translate(AZ) for r in after.collect())
            assert set(have.values()) == {1} and set(have) == {(r.text or "").translate(AZ) for r in all_rows.values()}
            best = defaultdict(list)
            for r in all_rows.values():
                best[(r.text or "").translate(AZ)].append(r.doc_id)
            assert all(r.doc_id == max((i for i in best[(r.text or "").translate(AZ)] if i is not None), default=None) for r in after.collect())
        if name == "simhash_near_dedup":
            ids = Counter(r.doc_id for r in after.collect())
            assert ids[60] == 1 and not ids[61] and ids[62] == 1 and ids[None] == 1  # the null identifier's near copy loses, its own text stays
        if name == "mixing":
            assert Counter(r._row for r in after.collect()).most_common(1)[0][1] <= 2
        docs = after
    assert P.run(spark, odd).count() == after.count()
