"""Vector links against all pairs in double precision."""

import numpy as np

from editforge.llm.vector_links import Grid, link_vectors, multi_sequence, unit

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def brute_force(rows, least=0.9):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    us = [unit(np.array([v], np.float32))[0] if o else None for (_, v), o in zip(rows, ok)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(us[a]) == len(us[b]) and us[a] @ us[b] >= least:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def test_planted_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((300, 32)).astype(np.float32))]
    for g in range(12):
        base = rows[g * 7][1]
        for k in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (base + rng.standard_normal(32) * rng.choice([0, 0.02, 0.2, 0.4])).astype(np.float32)))
    rows = [(int(i), [float(x) for x in v]) for i, v in rows]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] + [1.0] * 31), (2004, [None] + [1.0] * 31),
             (2005, [float("inf")] + [1.0] * 31), (2006, rows[3][1][:16]), (2007, rows[3][1][:16]), (2008, [x * 3 for x in rows[4][1]])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in link_vectors(df).collect()}
    want = brute_force(rows)
    assert len(got) == len(rows)
    total, lost = sum(w[0] for w in want.values()), sum(abs(want[i][0] - got[i][0]) for i in want)
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert lost <= 0.02 * total
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 0, "a"), (3, v, 0, "a"), (3, v, 0, "a"), (2, v, 0, "a"), (9, None, 0, "a")], SCHEMA)
    got = sorted(map(tuple, link_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (3, 1, 2, False), (3, 1, 2, False), (2, 1, 2, True), (9, 0, 9, True)], key=str)
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert link_vectors(spark.createDataFrame([(1, None, 0, "a")], SCHEMA).limit(1)).collect()[0].n_links == 0


def test_multi_sequence_is_sorted():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = np.sort(rng.random(7)), np.sort(rng.random(7))
        out = multi_sequence(a.tolist(), b.tolist(), list(range(7)), list(range(7)), 49)
        sums = [a[c // 7] + b[c % 7] for c in out]
        assert len(set(out)) == 49 and sums == sorted(sums)


def test_recall_at_threshold():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((4000, 64)))
    grid = Grid(x, 4000, 0.9, 0.97)
    side = rng.standard_normal((500, 64))
    y = unit(side - (side * x[:500]).sum(1, keepdims=True) * x[:500]) * (1 - 0.81) ** 0.5 + 0.9 * x[:500]
    found = [c in w or d in u for c, w, d, u in zip(grid.cells(y), grid.walk(x[:500]), grid.cells(x[:500]), grid.walk(y))]
    assert np.mean(found) >= 0.97
