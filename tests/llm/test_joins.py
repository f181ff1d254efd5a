"""Operators 11 and 12 against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import AZ, WORDS

from crucible.llm import jaccard_join as J
from crucible.llm import spelling as S

SCHEMA = "doc_id long, text string"


def gram_sets(text, size=3):
    w = WORDS.findall((text or "").translate(AZ))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, percent=90):
    sets = [gram_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rng, n, words=120, edits=5, first=0):
    """Texts of one template, each with some words replaced."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def groups(spark, rows, **options):
    return sorted((tuple(r) for r in J.jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()), key=repr)


ODD = [
    (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE\ttwo"), (907, "one two three"), (None, "one two"),
    (None, "alone here is nobody else"), (908, "a b c a b c a b c"), (909, "a b c a b c"), (903, "one"), (910, "É b c"), (911, "é b c"), (912, "word " * 30_000),
]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    rows = family(rng, 60) + family(rng, 40, 60, 3, 100) + family(rng, 30, 30, 2, 200) + ODD
    rows += [(300 + i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(400 + i, rows[rng.randrange(60)][1].upper()) for i in range(20)]
    assert groups(spark, rows) == brute_groups(rows)


def test_groups_of_a_family_below_the_bar(spark):
    """Most pairs of the family are no links, keys are divided, and the last turn finds what the first ones leave."""
    rng = random.Random(6)
    rows = family(rng, 150, 90, 7)
    want = brute_groups(rows)
    assert 1 < len({x[2] for x in want}) < 150
    assert groups(spark, rows, part=16, reach=(1, 2)) == want
    assert groups(spark, rows, part=7, reach=(2, 3), bits=4) == want


def test_a_large_group_makes_no_square_of_pairs(spark, monkeypatch):
    made, stage = [], J.stage

    def spy(df, name):
        out = stage(df, name)
        if name == "jaccard-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "stage", spy)
    rows = family(random.Random(7), 1200, 200, 2)
    assert len({x[2] for x in groups(spark, rows)}) == 1
    assert sum(made) < 30 * len(rows)


def test_groups_of_nothing_and_of_clashing_names(spark):
    assert groups(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, row long, label string")
    assert sorted(map(tuple, J.jaccard_groups(df).collect())) == [(1, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_filters_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    steps = rng.integers(0, 9, 1 << 6).astype(np.uint8)
    for _ in range(300):
        a = np.unique(J.mixed(rng.integers(0, 1 << 40, rng.integers(1, 80), dtype=np.uint64)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.85, 0.95, 1.0])], J.mixed(rng.integers(0, 1 << 40, rng.integers(0, 6), dtype=np.uint64))]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        (fa, ba), (fb, bb) = (J.prefix_of(x, steps, percent) for x in (a, b))
        shared = [(i, int(np.flatnonzero(fb == x)[0])) for i, x in enumerate(fa) if x in fb]
        assert shared
        i, j = shared[0]
        about = lambda x, k, behind: (np.array([len(x)]), np.array([k]), behind[[k]], np.frombuffer(J.parity(x), dtype=np.uint64)[None])
        assert J.may_link(percent, *about(a, i, ba), *about(b, j, bb)).all()
        assert J.least_common(len(a), len(b), percent) <= both


def test_frequencies_count_every_document(spark):
    rows = [(i, "common words here " + str(i)) for i in range(100)]
    steps = J.frequencies(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 12)
    common, own = J.gram_set("common words here", 3)[0], J.gram_set("words here 7", 3)[0]
    assert steps[int(common >> np.uint64(52))] >= 26  # 4 log2(100)
    assert steps[int(own >> np.uint64(52))] < 10


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words):
    out, form, of = [], {}, {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(of[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(of[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def some_words(rng, n):
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("abné") for _ in range(rng.randrange(5, 9)))
        out[w] = rng.randrange(3, 60)
    return out


@pytest.mark.parametrize("part", [3, 1024])
def test_forms_equal_brute_force(spark, part):
    words = some_words(random.Random(part), 700) | {"aaaaa": 9, "aaaaaa": 3, "aaaaaaa": 40, "ababab": 8, "bababa": 80, "z" * 4000: 3, "z" * 4001: 6}
    got = S.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), part=part)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_forms(words)


def test_variants_of_texts(spark):
    rng = random.Random(1)
    vocab = ["Straße", "strasse", "colour", "color", "naïveté", "ÉCLAIR", "éclair", "words", "swords", "tiny"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice([" ", "-", "1", "\n"]) for _ in range(80))) for i in range(40)] + [(None, "colour color colour"), (7, None), (8, ""), (1, "words " * 5000)]
    have = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            have[run] += 1
    words = {w: n for w, n in have.items() if len(w) >= 5 and n >= 3}
    got = S.spelling_variants(spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_forms(words)
    assert S.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rarest_bigrams_of_near_words_meet():
    """The first matching bigram of a pair is among the three rarest of either word, at places that fit."""
    rng = random.Random(3)
    words = sorted(some_words(rng, 400))
    often = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    top = {w: [(g, p) for _, g, p in sorted((often[w[i : i + 2]], w[i : i + 2], i) for i in range(len(w) - 1))[:3]] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            s, l = sorted((a, b), key=len)
            assert any(g == h and q - p in ((0,) if len(s) == len(l) else (0, 1)) for g, p in top[s] for h, q in top[l])
