"""A small corpus for the pipeline: toxic texts, copies, near copies, odd rows."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in ("ka", "lo", "mi", "ré", "tu") for b in ("n", "sh", "ta", "x", "öl", "b")]


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(AZ))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, capped = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set()
    while free := [s for s in order if s not in capped]:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= target[s]
    return target


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(VOCAB) + rng.choice(["", "a", "e", "i"]) for _ in range(rng.choice([6, 40, 150]))]
        if i % 8 == 0:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["rotten", "swine!", "Vilea", "Vileb", "Vilec"]))
        elif i % 9 == 1:
            w = docs[rng.randrange(len(docs))][1].upper().split(" ") if i > 20 else w
        elif i % 9 == 4 and i > 20:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            w[rng.randrange(len(w))] = "edited"
        text = " ".join(w)
        docs.append((i, text, "en", None if i % 11 == 0 else f"s{i % 4}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(bool(re.search("rotten|swine|vile", text.lower())))))
    docs += [(n, "", "en", "s1", 0), (n + 1, None, None, None, None), (n + 2, " ", "en", "s2", 1)]
    return docs, labels
