"""Operator 1: documents scored by masked pseudo-likelihood.

A token's probability is conditional on its neighbours on both sides: their
embeddings, weighted by place, are summed through a tanh into a hidden vector,
and a two-level softmax (class of 64, place in the class) gives the
probability. A document's score is the sum of its tokens' conditional
log-probabilities, each token left out of its own context.

Word counts cover every document. The network tells the commonest words and one
entry for all others apart; each of the others has its own share in that entry,
by its count in the corpus. Counts of the commonest of these (a bounded number)
are sent to the tasks, and a join on the table of all words brings the rest to the
documents: what is gathered grows with the corpus. Training passes over every document once, in
rounds: each round every task trains the current network on its share of its
documents, and the networks are averaged, weighted by tokens, by a Spark
aggregate over parameters. Only the network, its vocabulary and the counts to be
sent, all of bounded size, come to the driver; the table of all words stays in the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.common import chunks, fresh, text_column, tidy, words
from editforge.session import materialize

#: Classes, and words a class: the vocabulary is their product, its last entry all other words.
CLASSES = 64
VOCABULARY = CLASSES * CLASSES
#: Neighbours on either side, and the width of embeddings and the hidden vector.
REACH, WIDTH = 3, 16
#: Rounds of training; every document is in exactly one.
ROUNDS = 2
BATCH = 4096
RATE = 0.15
#: At most so many words with their counts are sent to the tasks; counts of all others come by a join.
HELD = 1 << 19
SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "place": (2 * REACH, WIDTH), "bias": (WIDTH,), "w1": (WIDTH, CLASSES), "b1": (CLASSES,),
          "shift": (CLASSES, WIDTH), "w2": (WIDTH, CLASSES), "b2": (CLASSES, CLASSES)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The network's arrays as views of one."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at: at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray) -> np.ndarray:
    """A network that gives every word its share in ``counts`` whatever the context."""
    flat = np.zeros(SIZE, np.float32)
    p, rng = unpack(flat), np.random.default_rng(11)
    for name in ("embed", "w1", "w2"):
        p[name][...] = rng.standard_normal(SHAPES[name]) * 0.1
    p["embed"][-1] = 0  # beyond the ends of a text
    p["place"][...] = 1
    share = (counts + 1.0).reshape(CLASSES, CLASSES)
    p["b1"][...] = np.log(share.sum(1) / share.sum())
    p["b2"][...] = np.log(share / share.sum(1, keepdims=True))
    return flat


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def forward(p, ids: np.ndarray):
    """Hidden vectors and both softmaxes for the tokens of ``ids`` but REACH at either end."""
    n = len(ids) - 2 * REACH
    x = p["embed"][ids]
    s = np.zeros((n, WIDTH), np.float32) + p["bias"]
    for k, o in enumerate((*range(REACH), *range(REACH + 1, 2 * REACH + 1))):
        s += x[o: o + n] * p["place"][k]
    h = np.tanh(s)
    t = ids[REACH: REACH + n]
    c, j = t // CLASSES, t % CLASSES
    real = t < VOCABULARY
    c, j = np.where(real, c, 0), np.where(real, j, 0)
    q1 = softmax(h @ p["w1"] + p["b1"])
    q2 = softmax((h + p["shift"][c]) @ p["w2"] + p["b2"][c])
    return x, h, c, j, real, q1, q2


def log_probabilities(p, ids: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each token (0 at the ends of texts)."""
    out = np.zeros(len(ids))
    for a in range(0, len(ids) - 2 * REACH, 4 * BATCH):
        part = ids[a: a + 4 * BATCH + 2 * REACH]
        _, _, c, j, real, q1, q2 = forward(p, part)
        rows = np.arange(len(c))
        out[a + REACH: a + REACH + len(c)] = np.where(real, np.log(q1[rows, c]) + np.log(q2[rows, j]), 0)
    return out


def by_row(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``index``."""
    return np.stack([np.bincount(index, values[:, d], n) for d in range(values.shape[1])], 1).astype(np.float32)


class Trainer:
    """Stochastic gradient steps with a rate of its own for each parameter (Adagrad)."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.seen, self.tokens = flat.copy(), np.full(SIZE, 1e-3, np.float32), 0
        self.p, self.grad = unpack(self.flat), np.zeros(SIZE, np.float32)
        self.g = unpack(self.grad)

    def step(self, ids: np.ndarray):
        p, g = self.p, self.g
        x, h, c, j, real, q1, q2 = forward(p, ids)
        n, rows = len(c), np.arange(len(c))
        m = max(1, int(real.sum()))
        q1[rows, c] -= 1
        q2[rows, j] -= 1
        if m < n:
            q1[~real], q2[~real] = 0, 0
        q1 /= m
        q2 /= m
        g["w1"][...] = h.T @ q1
        g["b1"][...] = q1.sum(0)
        hs = h + p["shift"][c]
        g["w2"][...] = hs.T @ q2
        d2 = q2 @ p["w2"].T
        g["shift"][...] = by_row(c, d2, CLASSES)
        g["b2"][...] = by_row(c, q2, CLASSES)
        ds = (q1 @ p["w1"].T + d2) * (1 - h * h)
        g["bias"][...] = ds.sum(0)
        dx = np.zeros_like(x)
        for k, o in enumerate((*range(REACH), *range(REACH + 1, 2 * REACH + 1))):
            g["place"][k] = (ds * x[o: o + n]).sum(0)
            dx[o: o + n] += ds * p["place"][k]
        g["embed"][...] = by_row(ids, dx, VOCABULARY + 1)
        g["embed"][-1] = 0
        self.seen += self.grad * self.grad
        self.flat -= RATE * self.grad / np.sqrt(self.seen)
        self.tokens += m


def token_ids(h: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of word hashes in the vocabulary (sorted ``keys``); the last one for all others."""
    if not len(keys):
        return np.full(len(h), VOCABULARY - 1, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, places[at], VOCABULARY - 1)


def streams(batches, text: str, keys, places):
    """(batch, first row, rows, token stream with REACH fillers around each text, first token of each text and end of the last, word hashes)."""
    for batch in batches:
        for row, n, data, offsets in chunks(text_column(batch, text)):
            h, first, _, _ = words(data, offsets)
            ids = token_ids(h, keys, places)
            shift = REACH * (np.arange(n) + 1)
            out = np.full(len(ids) + REACH * (n + 1), VOCABULARY, np.int64)
            out[np.arange(len(ids)) + np.repeat(shift, np.diff(first))] = ids
            yield batch, row, n, out, first, h


class Scorer:
    """What training has learnt: the network and its vocabulary, the table (word, count) of all words, and its commonest rows."""

    def __init__(self, keys, places, flat, counted: DataFrame, others: int, held: tuple[np.ndarray, np.ndarray]):
        self.keys, self.places, self.flat, self.counted, self.others, self.held = keys, places, flat, counted, others, held


def commonest(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words whose count lies above a bound that at most HELD words pass."""
    level = F.floor(F.log2("count") * 8)
    bound, total = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # some 500 levels at most
        total += r["count"]
        if total > HELD:
            break
        bound = r["level"]
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counted.where(level >= bound).toArrow()
    keys = np.asarray(found["word"]).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(found["count"])[order]


def fit(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Scorer:
    """Count words over all documents, then train the network on all of them."""
    spark = documents.sparkSession
    rows = documents.select(F.col(text).alias("text")).where("text is not null")

    def count(batches):
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(text_column(batch)):
                k, n = np.unique(words(data, offsets)[0], return_counts=True)
                both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                keys, sums = both, np.bincount(at, np.concatenate([sums, n]), len(both)).astype(np.int64)
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a: a + 100_000].view(np.int64)), pa.array(sums[a: a + 100_000])], names=["word", "count"])

    counted = materialize(rows.mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "words")
    kinds, tokens = counted.agg(F.count("*"), F.sum("count")).first()
    top = counted.orderBy(F.desc("count"), "word").limit(VOCABULARY - 1).collect()
    share = np.zeros(VOCABULARY)
    share[: len(top)] = [r["count"] for r in top]
    share[-1] = (tokens or 0) - share.sum()
    keys = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, flat = keys[order], start(share)
    if tokens:
        for r in range(rounds):
            sent = spark.sparkContext.broadcast((keys, order, flat))
            mine = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)

            def train(batches, sent=sent):
                keys, places, flat = sent.value
                trainer = Trainer(flat)
                for _, _, _, ids, *_ in streams(batches, "text", keys, places):
                    for a in range(0, len(ids) - 2 * REACH, BATCH):
                        trainer.step(ids[a: a + BATCH + 2 * REACH])
                if trainer.tokens:
                    at = np.arange(SIZE, dtype=np.int32)
                    for a in range(0, SIZE, 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(at[a: a + 20_000]), pa.array(trainer.flat[a: a + 20_000].astype(np.float64) * trainer.tokens),
                                                          pa.array(np.full(len(at[a: a + 20_000]), trainer.tokens, np.int64))], names=["at", "value", "tokens"])

            learnt = (mine.mapInArrow(train, "at int, value double, tokens long").groupBy("at")
                      .agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow())  # SIZE rows
            flat = flat.copy()
            flat[np.asarray(learnt["at"])] = np.asarray(learnt["value"])
    # One part more for a word that the corpus does not hold.
    return Scorer(keys, order, flat, counted, int(share[-1]) + kinds - len(top) + 1, commonest(counted))


def score(documents: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``documents`` with n_tokens, log_prob (the sum) and mean_log_prob.

    A word outside the network's vocabulary has the probability of the entry for
    others times its share among them, (count + 1) / (their tokens + their kinds + 1);
    a word that the corpus does not hold counts 0. A text without words (null,
    empty, blank) has no token, a sum of 0 and a null mean. Equal texts get equal
    scores, whatever their key; columns of those names are replaced; an empty table
    stays empty. Texts are scored where they lie: only their digests, sums and rare
    words are shuffled, and the columns that the caller goes on to use.
    """
    spark = documents.sparkSession
    kept = documents.drop("n_tokens", "log_prob", "mean_log_prob")
    key = fresh(kept, "_digest")
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)), 1, 16)
    sent = spark.sparkContext.broadcast((scorer.keys, scorer.places, scorer.flat, scorer.held, scorer.others))

    @tidy
    def run(batches):
        keys, places, flat, (known, counts), others = sent.value
        p, own = unpack(flat), np.log((counts + 1) / others)
        for batch, row, n, ids, first, h in streams(batches, "text", keys, places):
            logs = log_probabilities(p, ids)
            total = np.concatenate([[0], np.cumsum(logs)])
            shift = REACH * (np.arange(n) + 1)
            a, size = first[:-1] + shift, np.diff(first)
            sums = np.where(size > 0, total[a + size] - total[a], 0)
            owner = np.repeat(np.arange(n), size)
            other = ids[np.arange(len(h)) + np.repeat(shift, size)] == VOCABULARY - 1
            owner, word = owner[other], h[other]
            if len(known) and len(word):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                hit = known[at] == word
                sums += np.bincount(owner[hit], own[at[hit]], n)
                owner, word = owner[~hit], word[~hit]
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            begins = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])]) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.r_[begins, len(word)]) if len(word) else begins
            digests = batch.column("digest")
            yield pa.RecordBatch.from_arrays([digests.slice(row, n), pa.nulls(n, pa.int64()), pa.array(size.astype(np.int64)), pa.array(sums)], names=NAMES)
            for i in range(0, len(begins), 100_000):
                part = begins[i: i + 100_000]
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(owner[part] + row)), pa.array(word[part].view(np.int64)), pa.array(times[i: i + 100_000].astype(np.int64)),
                                                  pa.nulls(len(part), pa.float64())], names=NAMES)

    NAMES = ["digest", "word", "n", "log_prob"]
    # A row without a word stands for a text: n tokens, their sum as far as it is known. The others: n times a word whose count is not held.
    found = documents.select(digest.alias("digest"), F.col(text).alias("text")).mapInArrow(run, "digest binary, word long, n long, log_prob double")
    found = materialize(found, "scored")
    share = F.log((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(scorer.others)))
    words_of = (found.where("word is not null").join(scorer.counted, "word", "left").groupBy("digest").agg(F.sum(F.col("n") * share).alias("rest")))
    # Copies of a text add their words up as they add up their sums.
    texts = (found.where("word is null").groupBy("digest").agg(F.count("*").alias("copies"), F.max("n").alias("n_tokens"), F.max("log_prob").alias("inner"))
             .join(words_of, "digest", "left")
             .select(F.col("digest").alias(key), "n_tokens", (F.col("inner") + F.coalesce(F.col("rest") / F.col("copies"), F.lit(0.0))).alias("log_prob")))
    return (kept.withColumn(key, digest).join(texts, key).drop(key)
            .withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))))


def op1_pseudo_likelihood(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    return score(documents, fit(documents)).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")
