"""A hidden Markov language model trained by Baum-Welch counts from all partitions.

The chain emits word classes, of which there is a fixed number: each of the words
most frequent in training texts is a class of its own, the others share classes by the hash of
their last bytes, and the end of a text is a class. A class emits a word with
its smoothed frequency in the class. So the model's tables have a fixed size
while the vocabulary grows with the corpus: counts of the frequent words go to
the workers, those of the others meet their occurrences in a join.

Training runs the forward and the backward recursion over every whole training
text; the steps of long ones are taken in blocks, whose forward values are made
again from those at the block's begin when the backward recursion comes to it.
Scoring runs the scaled forward recursion over whole texts. Only the first
parameters, from which training sets out, come from pieces of some texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import ascii_lower_words, stage, table

STATES = 8
#: Words that are classes of their own; classes of the others; words whose counts the workers hold, at most, and how many bytes such a word has at most.
OWN, SHARED, HEAD, LONGEST = 4096, 1024, 131_072, 256
END = OWN + SHARED
CLASSES = END + 1
SUFFIX = 3
ROUNDS = 3
#: Tokens of texts that are trained on together, and values of the forward recursion that are kept at once (tokens).
TOKENS, CELLS = 1 << 22, 1 << 20
#: Pieces of so many tokens, and about how many of them, from which the first parameters come.
WINDOW = 256
FIRST_WINDOWS = 4000
FIRST_ROUNDS = 12
#: Distinct words that a worker counts before it hands on what it has.
FLUSH = 200_000


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-SUFFIX:]) % SHARED


class Params:
    """start: of a text; move: state to state; emit: state to class."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = (np.ascontiguousarray(x, dtype=np.float64) for x in (start, move, emit))
        self.by_class = np.ascontiguousarray(self.emit.T)


def maximise(starts, moves, emits, prior) -> Params:
    """The parameters of expected counts; a little of the corpus's class law goes to each state, so no class has probability 0."""
    emit = emits + 2.0 * prior[None, :]
    move = moves + 0.1
    start = starts + 0.1
    return Params(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def windows_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    return [t[k : k + WINDOW] for t in texts for k in range(0, len(t), WINDOW)]


def expected_counts(texts: list[np.ndarray], p: Params, cells: int = CELLS):
    """Baum-Welch counts (starts, moves, emits) and the log likelihood (natural) of whole texts, none of them empty.

    Texts advance side by side, the longest first, so that those at a step are
    always the first ones. Forward values of one block of steps are kept, of
    earlier blocks only the last ones.
    """
    k = p.move.shape[0]
    moves, emits, total = np.zeros((k, k)), np.zeros((k, p.emit.shape[1])), 0.0
    if not texts:
        return np.zeros(k), moves, emits, total
    texts = sorted(texts, key=lambda t: -len(t))
    size = np.array([len(t) for t in texts])
    flat, begin = np.concatenate(texts), np.concatenate([[0], np.cumsum(size)[:-1]])
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t
    upto = np.concatenate([[0], np.cumsum(live)])
    cuts = [0]
    while cuts[-1] < len(live):  # blocks of whole steps
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + cells, side="right")) - 1))

    def forward(a: int, b: int, now, keep: bool):
        """The steps a to b: the forward values after them, and if they are kept those of each step, one under the other."""
        kept = np.empty((upto[b] - upto[a], k)) if keep else None
        scale, obs = (np.empty(len(kept)), np.empty(len(kept), dtype=np.int64)) if keep else (None, None)
        log = 0.0
        for t in range(a, b):
            n = live[t]
            o = flat[begin[:n] + t]
            now = (np.broadcast_to(p.start, (n, k)) if t == 0 else now[:n] @ p.move) * p.by_class[o]
            s = now.sum(1)
            now = now / s[:, None]
            if keep:
                i = slice(upto[t] - upto[a], upto[t + 1] - upto[a])
                kept[i], scale[i], obs[i] = now, s, o
            else:
                log += float(np.log(s).sum())
        return now, kept, scale, obs, log

    now, at_cut = None, []
    for a, b in pairwise(cuts[:-1]):
        at_cut.append(now)
        now, *_, log = forward(a, b, now, False)
        total += log
    at_cut.append(now)
    ahead = np.zeros((0, k))
    for (a, b), now in zip(reversed([*pairwise(cuts)]), reversed(at_cut), strict=True):
        _, alpha, scale, obs, _ = forward(a, b, now, True)
        if b == cuts[-1]:
            total += float(np.log(scale).sum())
        by = p.by_class[obs] / scale[:, None]
        for t in range(b - 1, a - 1, -1):
            lo, hi = upto[t] - upto[a], upto[t + 1] - upto[a]
            m = len(ahead)
            moves += alpha[lo : lo + m].T @ ahead
            beta = np.ones((hi - lo, k))
            beta[:m] = ahead @ p.move.T
            alpha[lo:hi] *= beta
            ahead = by[lo:hi] * beta
        for s in range(k):
            emits[s] += np.bincount(obs, weights=alpha[:, s], minlength=p.emit.shape[1])
        starts = alpha[: live[0]].sum(0)
    return starts, moves * p.move, emits, total


def log10_likelihood(texts: list[np.ndarray], p: Params, lanes: int = 2048) -> np.ndarray:
    """Scaled forward recursion over whole texts, long ones side by side."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), lanes):
        mine = order[at : at + lanes]
        size = np.array([len(texts[i]) for i in mine])
        flat, begin = np.concatenate([texts[i] for i in mine]), np.concatenate([[0], np.cumsum(size)[:-1]])
        log, now, n = np.zeros(len(mine)), None, len(mine)
        for t in range(int(size[0])):
            while size[n - 1] <= t:
                n -= 1
            e = p.by_class[flat[begin[:n] + t]]
            now = (np.broadcast_to(p.start, e.shape) if t == 0 else now[:n] @ p.move) * e
            s = now.sum(1)
            now /= s[:, None]
            log[:n] += np.log10(s)
        out[mine] = log
    return out


def first_params(windows: list[np.ndarray], prior: np.ndarray, states: int = STATES, seed: int = 42) -> Params:
    """Each state starts from one window, each as unlike the earlier ones as can be; then some rounds on these windows alone."""
    rng = np.random.default_rng(seed)
    some = [windows[i] for i in rng.permutation(len(windows))[:600]]
    root = np.sqrt(np.stack([np.bincount(w, minlength=len(prior)) / max(1, len(w)) for w in some])) if some else np.zeros((1, len(prior)))
    chosen = [0]
    near = root @ root[0]
    while len(chosen) < min(states, len(root)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, root @ root[chosen[-1]])
    emit = np.stack([root[chosen[i % len(chosen)]] ** 2 for i in range(states)]) + prior[None, :] + 0.01 * rng.random((states, len(prior))) * prior[None, :]
    p = Params(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(1, keepdims=True))
    for _ in range(FIRST_ROUNDS):
        if windows:
            p = maximise(*expected_counts(windows, p)[:3], prior)
    return p


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is held out if the crc32 of its identifier as text leaves `held_fold`
    when divided by `folds`; a null identifier counts as empty text. Null and
    empty texts are their end alone. Texts of any length are scored whole;
    repeated rows are rows like any other, also in training; other columns are
    not read. An empty table gives no rows; with no training text at all, every
    token is unknown and the model is the uniform one.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_fold).alias("held_out"),
    )

    def count(batches):
        """(word, occurrences in training texts), also of words that only others have."""
        train, held = Counter(), set()

        def rows():
            words = list(train.keys() | held)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64())], names=["word", "c"])
            train.clear()
            held.clear()
            return out

        for batch in batches:
            for text, out in zip(batch.column(0), batch.column(1), strict=True):
                (held if out.as_py() else train).update(ascii_lower_words(text.as_py()))
                if len(train) + len(held) > FLUSH:
                    yield rows()
        yield rows()

    counted = base.select("_text", "held_out").mapInArrow(count, "word binary, c long")
    words = stage(counted.groupBy("word").agg(F.sum("c").alias("c")), "hmm-words")
    n_docs = base.agg(F.count_if(~F.col("held_out")).alias("t")).first().t
    # The words frequent in training texts: as many as fit, by steps of frequency. At most some thousand steps come to the driver.
    # Long words are never among them, so what comes to the driver and to the workers has a bound in bytes too.
    step = F.when((F.col("c") > 0) & (F.octet_length("word") <= LONGEST), F.floor(F.log2("c") * 64).cast("int")).otherwise(-1)
    steps = sorted(words.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect(), reverse=True)
    train_tokens, distinct = sum(r.c for r in steps) + n_docs, sum(r.v for r in steps) + (n_docs > 0)
    least, n = 1 << 30, 0
    for r in steps:
        n += r.n
        if n > HEAD or r.k < 0:
            break
        least = r.k
    frequent = words.filter(step >= least).toPandas()  # HEAD rows of LONGEST bytes at most
    frequent = frequent.sort_values(["c", "word"], ascending=[False, True], kind="stable")
    own = {bytes(w): i for i, w in enumerate(frequent.word[:OWN])}
    head = {bytes(w): (own.get(bytes(w)), math.log10(c + 0.5), c > 0) for w, c in zip(frequent.word, frequent.c.tolist(), strict=True)}
    of_class = F.lit(OWN) + F.pmod(F.crc32(F.substring("word", -SUFFIX, SUFFIX)), F.lit(SHARED)).cast("int")
    least_own = int(frequent.c.iloc[OWN - 1]) if len(frequent) >= OWN else 0
    shared = words.filter((F.col("c") <= least_own) | (step < 0)) if least_own else words.filter(step < least)
    by_class = shared.groupBy(of_class.alias("k")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()  # SHARED rows at most
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        mass[r.k], kinds[r.k] = r.n, r.v
    for w, c in zip(frequent.word[:OWN], frequent.c[:OWN].tolist(), strict=True):
        mass[own[bytes(w)]] = c
        if least_own and c == least_own:  # counted among the shared ones above
            k = shared_class(bytes(w))
            mass[k] -= c
            kinds[k] -= c > 0
    mass[END] = n_docs
    prior = (mass + 0.5) / (mass + 0.5).sum()
    den = np.log10(mass + 0.5 * (kinds + 1))
    end_log, log_all = math.log10(n_docs + 0.5), math.log10(train_tokens + 0.5 * (distinct + 1))
    known = spark.sparkContext.broadcast(head)

    def encode(batches):
        head = known.value
        crc = zlib.crc32
        for big in batches:
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                cols: list[list] = [[] for _ in range(7)]
                for text in batch.column(1).to_pylist():
                    words = ascii_lower_words(text)
                    obs = np.empty(len(words) + 1, dtype=np.int16)
                    classes, rest, log, log_shared, below, n_known = [], [], end_log, 0.0, 0.0, int(n_docs > 0)
                    for w in words:
                        x = head.get(w)
                        if x is None:
                            rest.append(w)
                            c = OWN + crc(w[-SUFFIX:]) % SHARED
                        else:
                            c, y, z = x
                            log += y
                            n_known += z
                            if c is None:
                                c = OWN + crc(w[-SUFFIX:]) % SHARED
                                log_shared += y
                        classes.append(c)
                    obs[:-1], obs[-1] = classes, END
                    below = float(den[obs[obs >= OWN]].sum() - den[END])
                    times = Counter(rest)
                    for col, v in zip(cols, (len(words) + 1, n_known, log, log_shared - below, obs.tobytes(), list(times), list(times.values())), strict=True):
                        col.append(v)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                names = ["n_tokens", "known", "log", "log_shared", "obs", "rest", "times"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["_id", "held_out", *names])

    id_type = base.schema["_id"].dataType.simpleString()
    encoded = base.mapInArrow(encode, f"_id {id_type}, held_out boolean, n_tokens long, known long, log double, log_shared double, obs binary, rest array<binary>, times array<int>")
    encoded = stage(encoded.withColumn("_row", F.monotonically_increasing_id()), "hmm-encoded")
    train = encoded.filter(~F.col("held_out")).select("obs")
    n_windows = train.agg(F.coalesce(F.sum(F.ceil(F.octet_length("obs") / (2 * WINDOW))), F.lit(0)).alias("n")).first().n

    def batched(batches, tokens):
        """Texts of at most so many tokens at a time (or one)."""
        some, n = [], 0
        for batch in batches:
            for x in batch.column(0):
                some.append(np.frombuffer(x.as_py(), dtype=np.int16))
                n += len(some[-1])
                if n >= tokens:
                    yield some
                    some, n = [], 0
        if some:
            yield some

    share = min(1.0, FIRST_WINDOWS / max(1, n_windows))

    def pick(batches):
        for texts in batched(batches, TOKENS):
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in windows_of(texts) if zlib.crc32(w.tobytes()) < share * (1 << 32)], pa.binary())], names=["w"])

    first = [np.frombuffer(r.w, dtype=np.int16) for r in train.mapInArrow(pick, "w binary").sort("w").limit(4 * FIRST_WINDOWS).collect()]
    params = first_params(first, prior, states)
    for _ in range(rounds if n_windows else 0):
        now = spark.sparkContext.broadcast(params)

        def expect(batches, now=now):
            starts = moves = emits = None
            for texts in batched(batches, TOKENS):
                s, m, e, _ = expected_counts(texts, now.value)
                starts, moves, emits = (s, m, e) if starts is None else (starts + s, moves + m, emits + e)
            if starts is not None:
                used = np.flatnonzero(emits.sum(0))
                rows = np.concatenate([starts[None], moves, emits[:, used].T])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], -2 - np.arange(len(moves)), used]).astype(np.int64)), *(pa.array(rows[:, i].copy()) for i in range(rows.shape[1]))], names=["key", *(f"s{i}" for i in range(rows.shape[1]))])

        counts = train.mapInArrow(expect, "key long, " + ", ".join(f"s{i} double" for i in range(states))).groupBy("key").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states)))
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES))
        for r in counts.collect():  # a row for each class and state, whatever the input
            v = r[1:]
            if r.key >= 0:
                emits[:, r.key] = v
            elif r.key == -1:
                starts[:] = v
            else:
                moves[-2 - r.key] = v
        params = maximise(starts, moves, emits, prior)
    final = spark.sparkContext.broadcast(params)

    def forward(batches):
        rows, texts, n = [], [], 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(log10_likelihood(texts, final.value))], names=["_row", "chain"])
            rows.clear()
            texts.clear()
            return out

        for batch in batches:
            for r, x in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(r.as_py())
                texts.append(np.frombuffer(x.as_py(), dtype=np.int16))
                n += len(texts[-1])
                if n >= 1 << 23:
                    yield flush()
                    n = 0
        if rows:
            yield flush()

    chain = encoded.select("_row", "obs").mapInArrow(forward, "_row long, chain double")
    pairs = encoded.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("word"), F.col("x.times").alias("n"))
    rare = pairs.join(words.filter(step < least).select("word", "c"), "word")
    rare = rare.groupBy("_row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_of = encoded.drop("obs", "rest", "times").join(chain, "_row").join(rare, "_row", "left")
    return all_of.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log") + zero("rare_log") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("chain") + F.col("log_shared") + zero("rare_log")).alias("score"),
    )


def op3_hidden_markov(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
