"""Operator 5: toxicity by nearest labelled examples.

Texts are TF-IDF vectors over terms (words and word beginnings) that tell the
labels apart in a bounded sample of labelled rows; document frequencies come
from every document. The nearest examples by exact cosine are found through an
inverted index with the largest weight of every block of examples: blocks are
visited from the highest upper bound down, until no block can hold a nearer
example. Votes weighted by nearness give a score, calibrated by
leaving each example out in turn; the nearest examples are the evidence. A text
without a telling term is a vector over all words of the sample instead, held
by the same search against the examples that have no telling term either; of
these only ones at a cosine of MIN_COSINE or more vote.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editforge.llm.common import chunks, mix64, places, text_column, tidy
from editforge.session import materialize

#: Largest number of labelled rows that terms and examples are taken from (least hash of the id first).
FIT_ROWS = 16_000
#: Largest number of terms, the most telling first.
MAX_TERMS = 4_096
#: Lengths of word beginnings that are terms beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
NEIGHBOURS = 16
BLOCK = 32
THRESHOLD = 0.3
#: Weight of the base rate among the votes.
PRIOR_WEIGHT = 0.25
#: Least cosine of an example that votes on a text by all its words.
MIN_COSINE = 0.5
#: Share of all index entries that belong to common words: a block is bounded by the length of their part of a vector instead of by word.
COMMON = 0.3
#: Votes on equal counts that a worker remembers.
VOTES = 5_000
_WORD = re.compile(r"[^\W_]+")


def word_terms(token: str) -> tuple[str, ...]:
    """Terms of a white-space token: its words, and their beginnings with a star."""
    out = []
    for w in _WORD.findall(token):
        out.append(w)
        out.extend(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return tuple(out)


#: Characters whose words are looked up at once; longer texts are cut between words.
PIECE = 1 << 19
_GAP = re.compile(r"[\W_]")
_LETTERS: list = []


def letters() -> np.ndarray:
    """Of every code point, whether it is part of a word; made once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


class Found:
    """Words (runs of letters and digits) of lowered texts, as 64-bit hashes of them and of their beginnings."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = letters()[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
        start, self.size = edge[::2], edge[1::2] - edge[::2]
        #: Number of each word's text.
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        self.first = np.cumsum(self.size) - self.size
        points = points[solid]
        place = np.arange(len(points)) - np.repeat(self.first, self.size)
        value = mix64(points + np.uint64(1 << 42)) * places(int(self.size.max(initial=0)))[place]
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=self.total[1:])

    def _hash(self, words, size, salt: int):
        first = self.first[words]
        return mix64(self.total[first + size] - self.total[first] + (np.atleast_1d(size).astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93))

    def whole(self, words=slice(None)) -> np.ndarray:
        return self._hash(words, self.size[words], 0)

    def heads(self, k: int, words=slice(None)) -> np.ndarray:
        """Hashes of the first k characters of words that have as many."""
        return self._hash(words, k, 1 << 32)


def word_keys(words: list[str]) -> np.ndarray:
    """Sorted hashes of words; a word's number is its hash's place."""
    return np.unique(np.concatenate([Found(w).whole() for _, w in _pieces(words)] or [np.zeros(0, np.uint64)]))


def _pieces(texts):
    """(their numbers, lowered texts) of about PIECE characters together; longer texts come in several pieces."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(texts):
        t, at = t.lower(), 0
        while at < len(t):
            gap = _GAP.search(t, at + PIECE) if len(t) - at > PIECE else None
            end = gap.start() if gap else len(t)
            numbers.append(i), held.append(t[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield np.array(numbers), held
                numbers, held, size = [], [], 0
    if held:
        yield np.array(numbers), held


class Keys:
    """Numbers of hashes, by binary search in a sorted array."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray | None = None):
        order = np.argsort(keys)
        self.keys, self.numbers = (keys, None) if numbers is None else (keys[order], numbers[order])

    def find(self, hashes: np.ndarray):
        """(which of the hashes are keys, their numbers)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == hashes)
        return hit, at[hit] if self.numbers is None else self.numbers[at[hit]]


class Counts:
    """Terms of several texts: ``sizes`` of each text, then numbers and times of all, in order."""

    def __init__(self, pairs: list, n_texts: int, n_terms: int):
        """``pairs``: (text, number) of occurrences, piece by piece, already counted."""
        n_terms = max(1, n_terms)
        keys, times = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *pairs))
        keys, at = np.unique(keys, return_inverse=True)
        self.times = np.bincount(at, times, len(keys)).astype(np.int64)
        self.numbers = keys % n_terms
        self.ends = np.searchsorted(keys, np.arange(n_texts + 1) * n_terms)

    def of(self, i: int):
        here = slice(self.ends[i], self.ends[i + 1])
        return self.numbers[here], self.times[here]


class Terms:
    """Counts the telling terms and the words of texts, all words of a piece at once."""

    def __init__(self, told: dict[str, int], keys: np.ndarray):
        self.n_told, self.words = len(told), Keys(keys)
        self.told = self._told([(t, i) for t, i in told.items() if not t.endswith("*")], None)
        self.heads = {k: self._told([(t[:-1], i) for t, i in told.items() if t.endswith("*") and len(t) == k + 1], k) for k in PREFIXES}
        # Of every telling term the first characters, which most words do not have.
        short = {t[: PREFIXES[0]] for t in told if len(t) >= PREFIXES[0]}
        self.likely = self._told([(t, 0) for t in sorted(short)], PREFIXES[0])

    @staticmethod
    def _told(terms, k):
        found = Found([t for t, _ in terms])
        return Keys(found.whole() if k is None else found.heads(k), np.array([i for _, i in terms], np.int64))

    def _of_piece(self, found: Found):
        """(places of words, numbers of telling terms)."""
        short = np.flatnonzero(found.size < PREFIXES[0])
        long = np.flatnonzero(found.size >= PREFIXES[0])
        likely = np.concatenate([short, long[self.likely.find(found.heads(PREFIXES[0], long))[0]]])
        hit, number = self.told.find(found.whole(likely))
        out = [(likely[hit], number)]
        for k, keys in self.heads.items():
            longer = likely[found.size[likely] > k]
            hit, number = keys.find(found.heads(k, longer))
            out.append((longer[hit], number))
        return (np.concatenate(x) for x in zip(*out))

    def count(self, texts: list[str], every: bool = False) -> tuple[Counts, Counts]:
        """Counts of telling terms, and of words; the latter only of texts without telling terms, or of ``every`` text."""
        n, told, words = len(texts), [], []
        n_told, n_words = max(1, self.n_told), max(1, len(self.words.keys))
        wanted, pieces = np.ones(n, bool), list(_pieces(texts))

        def add_words():
            at = np.flatnonzero(wanted[numbers[found.text]])
            hit, number = self.words.find(found.whole(at))
            words.append(np.unique(numbers[found.text[at[hit]]] * n_words + number, return_counts=True))

        for numbers, piece in pieces:
            found = Found(piece)
            at, number = self._of_piece(found)
            told.append(np.unique(numbers[found.text[at]] * n_told + number, return_counts=True))
            if every:
                add_words()
        told = Counts(told, n, n_told)
        if not every:
            wanted = np.diff(told.ends) == 0
            for numbers, piece in pieces:
                if wanted[numbers].any():
                    found = found if len(pieces) == 1 else Found(piece)
                    add_words()
        return told, Counts(words, n, n_words)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(first, size):
    """first[i], first[i] + 1, ... size[i] of them, for all i."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class Examples:
    """Labelled vectors, rows sorted so that like ones share a block.

    A vector's cosine with any row of a block is at most the sum over its
    words of its weight times the block's largest; over the ``common`` words,
    whose sums are loose and costly, the product of the lengths of both parts bounds it.
    In blocks that may hold a near example the same is done row by row with the row's own
    weights, and only rows that still may be near are multiplied out.
    """

    def __init__(self, ids, labels, sizes, terms, weights, n_terms: int, least: float = 0.0, common: float = 0.0):
        """``sizes``: number of terms of each example; ``terms`` and ``weights`` of all of them (rows of unit length), terms in order. Examples below ``least`` are not found."""
        ids, sizes, terms = (np.asarray(x, np.int64) for x in (ids, sizes, terms))
        labels, weights = np.asarray(labels, np.float64), np.asarray(weights, np.float64)
        self.least, self.n_terms = least, n_terms
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        heaviest = np.lexsort((terms, -weights, row))[ends[:-1]] if len(terms) else np.zeros(0, np.int64)
        order = np.lexsort((ids, labels, terms[heaviest])) if len(ids) else np.zeros(0, np.int64)
        flat = _spread(ends[order], sizes[order])
        self.ids, self.labels = ids[order], labels[order]
        self.ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
        self.terms, self.weights = terms[flat].astype(np.int32), weights[flat]
        self.n_blocks = -(-len(ids) // BLOCK)
        df = np.bincount(self.terms, minlength=n_terms)
        by_df = np.argsort(-df, kind="stable")
        self.common = np.zeros(n_terms, bool)
        self.common[by_df[: int(np.searchsorted(np.cumsum(df[by_df]), common * len(self.terms), "right"))]] = True
        # Inverted index: for each term its blocks, and the largest weight in each.
        row = np.repeat(np.arange(len(order)), np.diff(self.ends))
        self.part = np.sqrt(np.bincount(row, np.where(self.common[self.terms], self.weights, 0) ** 2, len(order)))
        self.longest = np.array([self.part[i: i + BLOCK].max() for i in range(0, len(order), BLOCK)])
        rare = np.flatnonzero(~self.common[self.terms])
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.row, self.row_weight = row[rare].astype(np.int32), self.weights[rare]
        self.row_ends = np.searchsorted(self.terms[rare], np.arange(n_terms + 1))
        key = self.terms[rare].astype(np.int64) * max(1, self.n_blocks) + row[rare] // BLOCK
        at = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[at], prepend=-1))
        self.post_block = (key[at][first] % max(1, self.n_blocks)).astype(np.int32)
        self.post_max = np.maximum.reduceat(self.weights[rare][at], first) if len(first) else np.zeros(0)
        self.post_ends = np.searchsorted(key[at][first], np.arange(n_terms + 1) * max(1, self.n_blocks))
        self.dense = None

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1):
        """(places, cosines) of the k examples of highest cosine above 0 and from ``least`` on, ties by smaller id; ``but``: a place left out."""
        if self.dense is None:
            self.dense = np.zeros(self.n_terms)
        rare = ~self.common[terms]
        a = self.post_ends[terms[rare]]
        size = self.post_ends[terms[rare] + 1] - a
        at = _spread(a, size)
        bound = np.bincount(self.post_block[at], np.repeat(weights[rare], size) * self.post_max[at], self.n_blocks)
        bound = bound + self.longest * np.sqrt((weights[~rare] ** 2).sum())
        floor = max(self.least - 1e-9, 0.0)
        live = (bound > 0) & (bound + 1e-9 >= floor)
        if not live.any():
            return np.zeros(0, np.int64), np.zeros(0)
        a = self.row_ends[terms[rare]]
        size = self.row_ends[terms[rare] + 1] - a
        at = _spread(a, size)
        bound = np.bincount(self.row[at], np.repeat(weights[rare], size) * self.row_weight[at], len(self.ids))
        bound = bound + self.part * np.sqrt((weights[~rare] ** 2).sum())
        order = np.flatnonzero(np.repeat(live, BLOCK)[: len(bound)] & (bound > 0) & (bound + 1e-9 >= floor))
        order = order[np.argsort(-bound[order], kind="stable")]
        self.dense[terms] = weights
        places, found, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order) and bound[order[at]] + 1e-9 >= floor:
            new = order[at: at + 2 * BLOCK]
            size = self.ends[new + 1] - self.ends[new]
            flat = _spread(self.ends[new], size)
            scores = np.add.reduceat(self.weights[flat] * self.dense[self.terms[flat]], np.cumsum(size) - size)
            at += 2 * BLOCK
            places, found = np.concatenate([places, new]), np.concatenate([found, scores])
            good = (found > 0) & (found >= floor) & (places != but)
            places, found = places[good], found[good]
            best = np.lexsort((self.ids[places], -np.round(found, 12)))[:k]
            places, found = places[best], found[best]
            if len(found) == k:
                floor = max(floor, found[-1])
        self.dense[terms] = 0
        return places, np.minimum(found, 1.0)


class Model:
    """What a fit has learnt: bounded by MAX_TERMS and FIT_ROWS, whatever the input."""

    def __init__(self, numbers, idf, examples: Examples, base: float, empty: float, knots=None, words=None, word_idf=None, whole: Examples | None = None):
        self.numbers, self.idf, self.examples, self.base, self.empty, self.knots = numbers, idf, examples, base, empty, knots
        self.words, self.word_idf, self.whole = np.zeros(0, np.uint64) if words is None else words, word_idf, whole

    def vote(self, terms, weights, k: int = NEIGHBOURS, but: int = -1):
        places, cosines = self.examples.nearest(terms, weights, k, but)
        near = cosines ** 2
        return (near @ self.examples.labels[places] + PRIOR_WEIGHT * self.base) / (near.sum() + PRIOR_WEIGHT), places, cosines

    def calibrate(self):
        """Isotonic fit of the labels to the votes, each example left out of its own vote."""
        e = self.examples
        votes = np.array([self.vote(e.terms[a:b], e.weights[a:b], but=i)[0] for i, (a, b) in enumerate(zip(e.ends[:-1], e.ends[1:]))])
        blocks: list[list[float]] = []  # sum of votes, sum of labels, number
        for i in np.argsort(votes, kind="stable").tolist():
            blocks.append([votes[i], e.labels[i], 1])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
        self.knots = (np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + self.base) / (b[2] + 1) for b in blocks])) if blocks else None

    def score(self, terms, times):
        """(score, evidence places, their cosines) of a text's counts of telling terms."""
        vote, places, cosines = self.vote(*unit(terms, times, self.idf))
        return float(np.interp(vote, *self.knots)) if self.knots else vote, places, cosines

    def score_whole(self, terms, times):
        """The same for a text without a telling term, by the counts of all its words; a near copy outweighs all that is merely like it."""
        if not len(terms) or self.whole is None:
            return self.empty, np.zeros(0, np.int64), np.zeros(0)
        places, cosines = self.whole.nearest(*unit(terms, times, self.word_idf))
        near = cosines ** 2 / (1.01 - cosines ** 2)
        return float((near @ self.whole.labels[places] + PRIOR_WEIGHT * self.empty) / (near.sum() + PRIOR_WEIGHT)), places, cosines


def unit(terms, times, idf: np.ndarray):
    """(term numbers, weights) of a TF-IDF vector of length 1."""
    weights = (1 + np.log(times)) * idf[terms]
    return terms, weights / np.sqrt(weights @ weights) if len(terms) else weights


def units(sizes, terms, times, idf: np.ndarray) -> np.ndarray:
    """Weights of many TF-IDF vectors of length 1, laid one after the other."""
    weights = (1 + np.log(times)) * idf[terms]
    row = np.repeat(np.arange(len(sizes)), sizes)
    return weights / np.sqrt(np.bincount(row, weights ** 2, len(sizes)))[row]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
        fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Learn from the labelled documents that are not held out.

    At most ``fit_rows`` labels are used; document frequencies cover every
    document. Labels or keys that are null are left out; of several labels of a
    document the highest holds. Without any label every score is 0.5.
    """
    sample = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
              .orderBy(F.xxhash64(key), key).limit(fit_rows))
    sample = materialize(sample, "labelled")  # at most fit_rows narrow rows: small enough to be sent to every executor
    texts = documents.select(F.col(key).cast("long").alias("_id"), F.col(key), text).join(F.broadcast(sample), key, "left").select("_id", "_y", text)

    def count_terms(batches):
        toxic, clean, rows = Counter(), Counter(), [0, 0]
        for batch in batches:
            for y, t in zip(batch.column("_y").to_pylist(), text_column(batch, text)):
                (toxic if y else clean).update({s for w in set(t.as_py().lower().split()) for s in word_terms(w)})
                rows[bool(y)] += 1
        names = [*(toxic.keys() | clean.keys())]
        yield pa.RecordBatch.from_pydict({"term": pa.array([*names, None], pa.string()), "n1": pa.array([*(toxic[n] for n in names), rows[1]], pa.int64()),
                                          "n0": pa.array([*(clean[n] for n in names), rows[0]], pa.int64())})

    counted = materialize(texts.where("_y is not null").mapInArrow(tidy(count_terms), "term string, n1 long, n0 long")
                          .groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    whole = counted.where("term is null").agg(F.sum("n1"), F.sum("n0")).first()
    n1, n0 = whole[0] or 0, whole[1] or 0
    if not n1 + n0:
        return Model({}, np.zeros(0), Examples([], [], [], [], [], 0), 0.5, 0.5)
    base = (n1 + 0.5) / (n1 + n0 + 1)
    # Telling: among its documents the odds of the label are more than double, whatever the base rate.
    # Gain of the labels' likelihood when a term's documents have a rate of their own; it must exceed what the best of so many terms gets by chance.
    terms, df = F.col("term"), F.col("n1") + F.col("n0")
    part = lambda n, rate: F.when(n > 0, n * F.log(n / (df * rate))).otherwise(0.0)
    gain = part(F.col("n1"), base) + part(F.col("n0"), 1 - base)
    least = float(np.log(max(2, counted.where("n1 + n0 >= 3").count()))) + 0.5
    told = (counted.where(terms.isNotNull()).withColumn("gain", gain).where(F.col("gain") >= least)
            .where(F.col("n1") * (1 - base) > 2 * base * F.col("n0")).orderBy(F.desc("gain"), "term").limit(max_terms).select("term").collect())
    numbers = {r[0]: i for i, r in enumerate(told)}
    names = counted.where(terms.isNotNull() & ~terms.endswith("*")).select("term").toArrow()["term"]  # of at most fit_rows texts
    words = word_keys(names.to_pylist())
    del names
    everything = documents.sparkSession.sparkContext.broadcast(words)  # eight bytes a word of at most fit_rows texts
    n_told = len(numbers)

    def vectors(batches):
        known = Terms(numbers, everything.value)
        df, n = np.zeros(n_told + len(known.words.keys), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for row, rows, _, _ in chunks(text_column(batch, text), PIECE):
                part = batch.slice(row, rows)
                told, every = known.count(text_column(part, text).to_pylist(), every=True)
                df[:n_told] += np.bincount(told.numbers, minlength=n_told)[:n_told]
                df[n_told:] += np.bincount(every.numbers, minlength=len(df) - n_told)[: len(df) - n_told]
                ids, ys, ts, cs = [], [], [], []
                for j, (i, y) in enumerate(zip(part.column("_id").to_pylist(), part.column("_y").to_pylist())):
                    if y is None:
                        continue
                    t, c = told.of(j)
                    ids.append(i), ys.append(y), ts.append(t), cs.append(c)
                    if not len(t):
                        t, c = every.of(j)
                        ids.append(i), ys.append(-2 - bool(y)), ts.append(t), cs.append(c)
                yield rows_of(ids, ys, ts, cs)
        here = np.flatnonzero(df)
        yield rows_of([None, None], [-1, -4], [here, []], [df[here], [n]])

    def rows_of(ids, ys, ts, cs):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([np.asarray(t, np.int32) for t in ts], pa.list_(pa.int32())),
                                           pa.array([np.asarray(c, np.int64) for c in cs], pa.list_(pa.int64()))], names=["id", "y", "terms", "counts"])

    seen = materialize(texts.mapInArrow(tidy(vectors), "id long, y int, terms array<int>, counts array<long>"), "vectors")
    n_docs = seen.where("y = -4").agg(F.sum(F.element_at("counts", 1))).first()[0]
    pairs = seen.where("y = -1").select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n")).toArrow()
    df = np.zeros(n_told + len(words))  # a row a term of at most fit_rows texts
    df[np.asarray(pairs["terms"])] = np.asarray(pairs["n"])
    idf = np.log((n_docs + 1) / (df + 1)) + 1

    def examples(condition: str, idf, **how):
        rows = seen.where(condition).where("size(terms) > 0").orderBy("id", "y").toArrow().combine_chunks()  # at most fit_rows
        if not len(rows):
            return Examples([], [], [], [], [], len(idf), **how)
        sizes = pc.list_value_length(rows["terms"]).to_numpy()
        terms, times = (pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "counts"))
        y = rows["y"].to_numpy()
        return Examples(rows["id"].to_numpy(), np.where(y < 0, -2 - y, y), sizes, terms, units(sizes, terms, times, idf), len(idf), **how)

    empty = seen.where("y >= 0 and size(terms) = 0").agg(F.sum("y"), F.count("*")).first()
    # Of texts without any telling term the base rate is learnt too, with one row's weight of doubt.
    model = Model(numbers, idf[:n_told], examples("y >= 0", idf[:n_told]), base, ((empty[0] or 0) + base) / (empty[1] + 1), None, words, idf[n_told:],
                  examples("y in (-2, -3)", idf[n_told:], least=MIN_COSINE, common=COMMON))
    model.calibrate()
    return model


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with score, predicted, evidence (nearest examples: id, label, cosine).

    Columns of those names are replaced. Texts without any telling
    term are held against labelled ones of that kind by all their words; null
    and empty texts, and those that no such example is near, get the rate of that kind; equal texts get equal
    scores; an empty table stays empty.
    """
    kept = documents.drop("score", "predicted", "evidence")
    names = kept.columns
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS and MAX_TERMS

    def shown(examples, s, places, cosines):
        return s, [{"id": int(examples.ids[p]), "label": int(examples.labels[p]), "cosine": float(c)} for p, c in zip(places[:3].tolist(), cosines[:3].tolist())]

    def run(batches):
        m = sent.value
        terms, voted = Terms(m.numbers, m.words), {}
        for whole in batches:
            for row, rows, _, _ in chunks(text_column(whole, text), PIECE):
                batch, out = whole.slice(row, rows), []
                telling, every = terms.count(text_column(batch, text).to_pylist())
                for i in range(batch.num_rows):
                    told = telling.of(i)
                    if not len(told[0]):
                        out.append(shown(m.whole, *m.score_whole(*every.of(i))))
                        continue
                    key = (told[0].tobytes(), told[1].tobytes())
                    if key not in voted:
                        if len(voted) > VOTES:
                            voted.clear()
                        voted[key] = shown(m.examples, *m.score(*told))
                    out.append(voted[key])
                scores, evidence = [s for s, _ in out], [e for _, e in out]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                     pa.array(evidence, pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())])))],
                    names=[*names, "score", "predicted", "evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidy(run), f"{fields}, score double, predicted int, evidence array<struct<id: bigint, label: int, cosine: double>>")


def op5_toxicity(spark, sf_dir):
    root = sf_dir.rstrip("/")
    documents = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
