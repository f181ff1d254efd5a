"""Toxicity by a classifier chain.

Linear models predict the categories one after the other; each sees the
probabilities of the earlier ones besides the text's features. For training,
these probabilities come out of fold: from models that did not see the row, with
features that were chosen without it. The features are words and the first
characters of words; the executors count them by fold and class, and the most
telling ones, a bounded number, make a model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.llm.common import stage, table

#: Labelled rows that train the chain, at most: those of the smallest hash.
MOST_LABELLED = 20_000
#: Features of a model, at most, for each category, and how telling one must be for it (log likelihood ratio).
MOST_FEATURES, LEAST_G2 = 300, 20.0
PREFIXES = (4, 5)
FOLDS = 5
#: In this order, the last one decides: what a label table says about a text. It labels one kind of toxicity; a chain takes any number.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic > 0"}
STRIP = ".,;:!?\"'()[]{}<>*#%$&|/\\-_=+~`^@"


def features(text: str | None) -> set[str]:
    """The distinct words, lower-cased and without punctuation at their ends, and their first 4 and 5 characters (marked)."""
    words = {w.strip(STRIP) for w in set((text or "").lower().split())}
    out = set(words)
    for k in PREFIXES:
        out.update([f"{k}|{w[:k]}" for w in words if len(w) >= k])
    out.discard("")
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """For category i: probability = sigmoid(bias + features + links[i] . probabilities of the earlier categories)."""

    categories: tuple[str, ...]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    reject_at: float = 1.0
    """The least probability of the last category that rejects a text."""

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities (rows by categories) of rows of feature numbers."""
        out = np.zeros((len(rows), len(self.categories)))
        for c in range(len(self.categories)):
            base = np.array([self.weights[c][r].sum() for r in rows]) if rows else np.zeros(0)
            out[:, c] = sigmoid(self.bias[c] + base + out[:, :c] @ self.links[c][:c])
        return out


def minimise(f, x: np.ndarray, steps: int = 120, memory: int = 10, enough: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking; f gives the value and the gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        t, slope = 1.0, g @ d
        while True:
            nxt = x - t * d
            v, h = f(nxt)
            if v <= value - 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = nxt - x, h - g
        done = value - v < enough * max(1e-12, abs(value))
        x, value, g = nxt, v, h
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if done:
            break
    return x


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-3):
    """Logistic regression (weights, bias, dense weights); both classes weigh the same."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, dtype=np.int32)]).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    by_feature = np.argsort(flat, kind="stable")
    owner_by_feature, count = owner[by_feature], np.bincount(flat, minlength=n_features)
    del owner, by_feature

    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of values that lie one group after the other; 0 for a group of none."""
        out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
        return out

    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    free = np.full(n_features + 1 + dense.shape[1], l2)
    free[n_features] = 0.0

    def loss(p: np.ndarray):
        # einsum and sum, not matrix products, which would start threads for so little work.
        z = sums(p[flat], size) + p[n_features] + np.einsum("ij,j->i", dense, p[n_features + 1 :])
        r = (sigmoid(z) - y) * weight
        g = np.concatenate([sums(r[owner_by_feature], count), [r.sum()], np.einsum("ij,i->j", dense, r)])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum()) + 0.5 * float((free * p * p).sum()), g + free * p

    p = minimise(loss, np.zeros(n_features + 1 + dense.shape[1]))
    return p[:n_features], p[n_features], p[n_features + 1 :]


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, index: dict[str, int], categories, fold: np.ndarray, allowed: list[np.ndarray] | None = None) -> tuple[Chain, np.ndarray]:
    """A chain from rows of feature numbers and 0/1 labels (rows by categories), and the out-of-fold probabilities that trained it.

    allowed[f]: which features a model without fold f may use; the last entry is
    that of the models of all rows. Without it all may use all.
    """
    n, k = len(index), len(categories)
    folds = int(fold.max()) + 1 if len(fold) else 0
    use = allowed if allowed is not None else [np.ones(n, dtype=bool)] * (folds + 1)
    out = np.zeros((len(rows), k))
    weights, bias, links = np.zeros((k, n)), np.full(k, -30.0), np.zeros((k, k))

    def fit(some: np.ndarray, c: int, may: np.ndarray):
        y = labels[some, c].astype(np.float64)
        if not 0 < y.sum() < len(y):
            return np.zeros(n), 30.0 if len(y) and y.all() else -30.0, np.zeros(c)
        return fit_linear([r[may[r]] for r in (rows[i] for i in some)], out[some, :c], y, n)

    for c in range(k):
        weights[c], bias[c], links[c, :c] = fit(np.arange(len(rows)), c, use[-1])
        for f in range(folds):
            own = np.flatnonzero(fold == f)
            if len(own):
                w, b, d = fit(np.flatnonzero(fold != f), c, use[f])
                out[own, c] = sigmoid(np.array([w[rows[i]].sum() for i in own]) + b + out[own, :c] @ d)
    return Chain(tuple(categories), index, weights, bias, links, best_bar(out[:, -1], labels[:, -1]) if len(rows) else 1.0), out


def best_bar(p: np.ndarray, y: np.ndarray) -> float:
    """The bar for probabilities p at which precision and recall of y have the largest harmonic mean, halfway between two of them, so that no row lies on it.

    Without rows of either class, or where nothing tells them apart: 1, which
    none reaches.
    """
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    last = np.flatnonzero(np.diff(p))  # whole ties; a bar below all rows is none
    if not len(last) or not 0 < hits[-1] < len(y):
        return 1.0
    f1 = 2 * hits[last] / (last + 1 + hits[-1])
    best = last[f1 == f1.max()]
    i = best[np.argmax(p[best] - p[best + 1])]  # of equals the widest gap
    return float((p[i] + p[i + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] | None = None, most_labelled: int = MOST_LABELLED) -> Chain:
    """The chain from labelled documents: at most `most_labelled`, by hash.

    `categories` are conditions on the label table, in the order of the chain; one
    on a column that it does not have is an error. Without `categories` those of
    CATEGORIES count whose column the table has. Rows without
    identifier, or for which a condition is null, do not count; of several
    labels each condition that one fulfils does, and of several texts with one
    identifier that of the smallest hash. Null texts are empty, and texts are read whole.
    """
    categories = dict(categories or {k: v for k, v in CATEGORIES.items() if v.split()[0] in labels.columns})
    names = tuple(categories)
    k = len(names)
    asked = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *(F.expr(v).alias(f"y{i}") for i, v in enumerate(categories.values()))).dropna()
    chosen = asked.groupBy("_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(k)))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(most_labelled)
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    known = text.groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"), *(F.first(f"y{i}").alias(f"y{i}") for i in range(k)))
    fold = F.pmod(F.xxhash64("_text", F.lit(11)), F.lit(FOLDS)).cast("int")
    known = stage(known.select("_text", fold.alias("fold"), *(f"y{i}" for i in range(k))), "toxicity-labelled")

    def expand(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch, words, of = big.slice(at, 256), [], []
                for i, text in enumerate(batch.column(0).to_pylist()):
                    mine = features(text)
                    words += mine
                    of += [i] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(batch.column(1 + c).take(pa.array(of, pa.int32())) for c in range(1 + k))], names=["f", "fold", *(f"y{c}" for c in range(k))])

    def cells(rows):
        """n{f}: rows of fold f; t{f}_{c}: those of category c."""
        return [*(F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)), *(F.count_if((F.col("fold") == f) & F.col(f"y{c}")).alias(f"t{f}_{c}") for f in range(FOLDS) for c in range(k))]

    whole = known.agg(*cells(known)).first()
    counts = known.mapInArrow(expand, "f string, fold int, " + ", ".join(f"y{c} boolean" for c in range(k))).groupBy("f").agg(*cells(known))

    def telling(without: int | None, c: int):
        """How telling a feature is for a category, in the folds but one."""
        rest = [f for f in range(FOLDS) if f != without]
        of = lambda x: sum((F.col(x.format(f)) for f in rest), F.lit(0))
        n, n_all = of("n{}"), float(sum(whole[f"n{f}"] for f in rest))
        part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
        t, t_all = of(f"t{{}}_{c}"), float(sum(whole[f"t{f}_{c}"] for f in rest))
        if not 0 < t_all < n_all:
            return F.lit(0.0)
        share = n / F.lit(n_all)
        g = 2 * (part(t, t_all * share) + part(n - t, (n_all - t_all) * share) + part(t_all - t, t_all * (1 - share)) + part(n_all - t_all - (n - t), (n_all - t_all) * (1 - share)))
        return F.when(n >= 2, F.round(g, 6)).otherwise(0.0)

    choices = [*range(FOLDS), None]
    counts = stage(counts.filter(" + ".join(f"n{f}" for f in range(FOLDS)) + " >= 2"), "toxicity-features")
    # One plan for all choices: a plan with a branch for each takes the driver far more memory.
    g_of = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), telling(f, c).alias("g")) for i, f in enumerate(choices) for c in range(k)))
    told = counts.select("f", F.explode(g_of).alias("t")).select("f", "t.*").filter(F.col("g") >= LEAST_G2)
    rank = F.row_number().over(Window.partitionBy("i", "c").orderBy(F.desc("g"), "f"))
    top = told.withColumn("rank", rank).filter(F.col("rank") <= MOST_FEATURES).select("f", "i").collect()  # MOST_FEATURES rows for each choice and category at most
    index = {f: i for i, f in enumerate(sorted({r.f for r in top}))}
    allowed = [np.zeros(len(index), dtype=bool) for _ in choices]
    for r in top:
        allowed[r.i][index[r.f]] = True
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode(batches):
        for batch in batches:
            index = shared.value
            rows = [np.array(sorted(index[f] for f in features(text) if f in index), dtype=np.int32).tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(batch.column(1 + c) for c in range(1 + k))], names=["r", "fold", *(f"y{c}" for c in range(k))])

    order = ["fold", *(f"y{c}" for c in range(k)), "r"]
    got = known.mapInArrow(encode, "r binary, fold int, " + ", ".join(f"y{c} boolean" for c in range(k))).orderBy(*order).collect()  # most_labelled rows of few numbers
    rows = [np.frombuffer(r.r, dtype=np.int32) for r in got]
    y = np.array([[r[f"y{c}"] for c in range(k)] for r in got], dtype=np.int64).reshape(len(got), k)
    return fit_chain(rows, y, index, names, np.array([r.fold for r in got], dtype=np.int64), allowed)[0]


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a probability for each category (columns of these names are replaced). Null and empty texts have no features."""
    names = [prefix + c for c in chain.categories]
    kept = [c for c in docs.columns if c not in names]
    at, order = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches):
        chain = shared.value
        find = chain.index.get
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch, rows = big.slice(k, 256), []
                for text in batch.column(at).to_pylist():
                    words = {w.strip(STRIP) for w in set((text or "").lower().split())}
                    got = {find(w) for w in words}
                    got.update([find(f"{p}|{s}") for p in PREFIXES for s in {w[:p] for w in words if len(w) >= p}])
                    got.discard(None)
                    rows.append(np.array(sorted(got), dtype=np.int64))
                p = chain.predict(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in order), *(pa.array(p[:, c].copy()) for c in range(p.shape[1]))], names=[*kept, *names])

    return docs.mapInArrow(work, T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names]))


def judge(docs: DataFrame, labels: DataFrame, reject_at: float | None = None, prefix: str = "p_", flag: str = "rejected") -> DataFrame:
    """docs with the chain's probabilities and `rejected`: the last category's probability is at least reject_at, or else the chain's own bar.

    Columns of these names are replaced; prefix and flag choose others. Repeated
    rows are judged alike, null and empty texts as texts without features, very
    long ones whole. Without texts of either class there is nothing to learn, and
    nothing is rejected; an empty table gives no rows.
    """
    chain = train(docs, labels)
    bar = chain.reject_at if reject_at is None else reject_at
    return score(docs, chain, prefix=prefix).withColumn(flag, (F.col(prefix + chain.categories[-1]) >= bar) & F.lit(bool(len(chain.index))))


def op6_classifier_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).drop("text")
