"""Nearest vectors by one-bit codes against all inner products in double precision."""

import numpy as np

from editforge.llm.vector_search import Coder, nearest_vectors, op11_one_bit_codes

SCHEMA = "vec_id long, embedding array<float>, id string, rank int, cell string"


def brute_force(rows, k=20, step=20):
    """(query, [(vec_id, score)]) over all sound rows."""
    sound = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            sound[i] = min(v, sound.get(i, v))
    ids = np.array(sorted(sound))
    width = max(len(sound[i]) for i in ids)
    x = np.array([list(sound[i]) + [0.0] * (width - len(sound[i])) for i in ids])
    out = {}
    for i, v in zip(ids.tolist(), x):
        if i % step == 0:
            score = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def ask(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA).repartition(parts)
    got = {}
    for r in nearest_vectors(df, df.where("vec_id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def single(x):
    return [float(c) for c in np.float32(x)]


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_whole_table_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_force(rows)
    got = {}
    for r in op11_one_bit_codes(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.95
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert all(abs(s - x[q] @ x[i]) < 1e-12 and i != q for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_lengths_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24)) * 2
    rows = [(i, single(base[i % 40] * rng.uniform(0.2, 3) + rng.standard_normal(24) * 0.4)) for i in range(1500)]
    rows += [(2000 + i, rows[8][1]) for i in range(700)]          # a third are copies of one vector
    rows += [(3000 + i, single(np.array(rows[8][1]) + 1e-4 * rng.standard_normal(24))) for i in range(100)]
    want = brute_force(rows)
    got = ask(spark, rows)
    assert all(len(got[q]) == 20 for q in want) and recall(got, want) >= 0.95
    for q in (2000, 2020, 2680):  # copies: the least ids other than its own
        assert all(i < 2100 for i, _ in got[q]) or recall({q: got[q]}, {q: want[q]}) == 1


def test_few_and_unsound_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(0, v), (20, [2.0, 0.0, 1.0]), (3, [5.0, 5.0, 5.0]), (4, [5.0, 5.0]), (5, v), (5, v), (5, [0.5, 9.0, 9.0]), (None, v), (40, None), (60, []), (80, [0.0] * 3),
            (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (140, [None, 1.0, 1.0])]
    want = brute_force(rows)
    for parts in (1, 4):
        assert ask(spark, rows, parts) == want
    assert ask(spark, [(0, v)]) == {} and ask(spark, [(1, None)]) == {} and ask(spark, []) == {}


def test_blocks_change_nothing(spark, monkeypatch):
    from editforge.llm import vector_search
    rng = np.random.default_rng(6)
    rows = [(i, single(rng.standard_normal(70))) for i in range(900)]
    whole = ask(spark, rows)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vector_search, "ESTIMATES", 500)
    assert ask(spark, rows, 5) == whole
    assert recall(whole, brute_force(rows)) >= 0.95


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    for dims in (8, 64, 100):
        x = rng.standard_normal((3000, dims)) * rng.uniform(0.1, 5, (3000, 1))
        coder = Coder(x, np.arange(3000), 3000, 20, 0.98)
        cell, codes, length, along = coder.encode(x)
        q = rng.standard_normal((50, dims))
        off, n = [], 0
        for c in range(len(coder.centres)):
            at = cell == c
            guess, error = coder.estimate(coder.planes(q), codes[at], length[at], along[at], coder.centres[c], q)
            true = q @ x[at].T
            off.append(((true - guess) / error).ravel())
        off = np.concatenate(off)
        assert (np.abs(off) <= 1).mean() > 0.995
        assert abs(off.mean()) < 0.02


def test_thresholds_are_reached_by_k_others():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 16))
    coder = Coder(x, np.arange(400), 400, 20, 0.98)
    reach = coder.thresholds(x[:50], np.arange(50), 20)
    score = x[:50] @ x.T
    score[np.arange(50), np.arange(50)] = -np.inf
    assert ((score >= reach[:, None]).sum(1) >= 20).all()
