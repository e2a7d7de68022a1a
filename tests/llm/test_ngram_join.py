"""N-gram join against all pairs in Python."""

import random

import numpy as np
import pytest

from editforge.llm.ngram_join import divide_skip, similar_documents

SCHEMA = "doc_id long, text string, id int"


def shingle_set(text, n):
    w = [x.decode().translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").encode().split()]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i: i + n]) for i in range(len(w) - n + 1)}


def brute_force(rows, n, num, den):
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(s), find(d)) for d, s in sets}


def edited(rng, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 8, 10), (1, 5, 10)])
def test_equals_all_pairs(spark, n, num, den):
    rng = random.Random(n)
    vocabulary = [f"W{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for d in range(0, 240, 6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((2, 5, 12, 40, 150, 400)))] + rng.choice(([], common))
        for k in range(6):  # a chain of copies, each farther from the first
            rows.append((d + k, " ".join(base)))
            base = edited(rng, base, rng.choice((0, 1, 2)) * max(1, len(base) // 120), vocabulary)
    rows += [(1000, ""), (1001, "  "), (1002, None), (1003, "one"), (1004, "ONE")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(4)
    got = {tuple(r) for r in similar_documents(df, n, num, den).collect()}
    assert got == brute_force(rows, n, num, den)


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in similar_documents(df, 3, 9, 10).collect()} == brute_force(rows, 3, 9, 10)


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1), (4, "a b c d", 2)], SCHEMA)
    assert sorted(map(tuple, similar_documents(df).collect()), key=str) == [(4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, 4)] or \
        sorted(map(tuple, similar_documents(df).collect()), key=str) == [(4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None)]
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        query = np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.choice(query, rng.integers(1, len(query) + 1)), rng.integers(0, 300, rng.integers(0, 9)).astype(np.uint64)]))
                for _ in range(rng.integers(1, 9))]
        want = [i for i, s in enumerate(sets) if 10 * len(np.intersect1d(query, s)) >= 8 * len(np.union1d(query, s))]
        assert divide_skip(query, sets, 8, 10) == want
