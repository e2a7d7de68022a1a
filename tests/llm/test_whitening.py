"""Whitening against exact sums and a double-precision eigensolver over all rows."""

import math

import numpy as np
import pytest

from editforge.llm.whitening import Whitener, eigen, op12_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string"


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), [5, 5 - 1e-9, 5 - 2e-9, 3, 1, 1e-3], [1, 1, 1, 1, 2, 2, 2, 7], [1e-8, 1, 1e8], [3.0], [0.0, 0.0, 4.0],
    np.concatenate([[0.026, 0.0254], np.linspace(0.0141, 0.0167, 62)]), [2 + 1e-12, 2, 2 - 1e-12, 1]])
def test_eigenvectors_are_right_to_double_precision(values):
    a = spectrum(values)
    a = (a + a.T) / 2
    e, x = eigen(a)
    long = np.longdouble
    assert (np.diff(e) <= 0).all()
    assert np.abs(x.T.astype(long) @ x - np.eye(len(e))).max() < 1e-15
    residual = a.astype(long) @ x - x.astype(long) * e
    assert np.abs(residual).max() < 4e-16 * max(map(abs, values))
    assert np.abs(np.sort(values)[::-1] - e).max() < 1e-14 * max(map(abs, values))


def test_close_eigenvalues_are_parted_where_single_precision_cannot():
    values = [1, 1 - 1e-9, 1 - 3e-9, 0.5]
    a = spectrum(values, 3)
    _, want = np.linalg.eigh((a + a.T) / 2)
    _, got = eigen((a + a.T) / 2)
    assert np.abs(np.abs((want[:, ::-1] * got).sum(0)) - 1).max() < 1e-6  # a gap of 1e-9 leaves seven digits of a vector


def plain(rows, components=4):
    """All rows at once: integers for the sums, float64 eigh for the vectors."""
    rows = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(k, tuple(math.floor(256 * float(np.float32(c))) + 0 for c in v)) for k, v in rows]
    fit = sorted(set(x for _, x in grid))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([t / n for t in total])
    y = np.array(fit, float) - mean
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for k, x in grid:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total))
        for c in range(min(components, len(e))):
            out.append((k, c + 1, n, deviation, float((np.array(x) - mean) @ u[:, c]) / e[c] ** 0.5, e[c] / np.trace(cov)))
    return out


def test_whole_table_equals_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(plain([(r["vec_id"], r["embedding"]) for r in df.collect()]), key=lambda r: r[:2])
    got = sorted(map(tuple, op12_whitening(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[:2])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    a, b = np.array([r[4] for r in got]).reshape(-1, 4), np.array([r[4] for r in want]).reshape(-1, 4)
    sign = np.sign((a * b).sum(0))
    assert np.abs(a * sign - b).max() < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10


def test_partitioning_and_repeats_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) * [4, 3, 2, 1, 1]]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(80)] + [(None, rows[5][1]), (7, rows[5][1])]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("-inf")] + [0.0] * 4)]
    df = spark.createDataFrame([(k, v, 0, "a", "b") for k, v in rows], SCHEMA)
    want = sorted(plain(rows), key=str)
    for parts in (1, 7):
        got = whiten(df.repartition(parts)).collect()
        assert sorted([tuple(r)[:4] for r in got], key=str) == sorted([r[:4] for r in want], key=str)
        assert max(r["identity_error"] for r in got) < 1e-10
        by = {(r["vec_id"], r["component"]): r["whitened"] for r in got if r["vec_id"] is not None and r["vec_id"] != 7}
        assert all(abs(abs(by[k, c]) - abs(w)) < 1e-9 for k, c, _, _, w, _ in want if k is not None and k != 7)


def test_edges(spark):
    def run(rows):
        return sorted(map(tuple, whiten(spark.createDataFrame([(k, v, 0, "a", "b") for k, v in rows], SCHEMA)).collect()), key=str)
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [0.5, 0.25])]) == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    # Short vectors have zeros; the second dimension depends on nothing else.
    got = run([(1, [1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])])
    assert [r[:4] for r in got] == [(k, c, 2, 512 ** 2) for k in (1, 2, 3) for c in (1, 2)]
    assert [abs(r[4]) if r[4] is not None else None for r in got] == [1.0, None] * 3 and got[0][5] == 1.0 and got[0][6] < 1e-12


def test_very_large_entries(spark):
    """Entries beyond a long are held at its ends; deviations beyond a long are null, the rest is finite."""
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 3.0])]
    got = whiten(spark.createDataFrame([(k, v, 0, "a", "b") for k, v in rows], SCHEMA)).collect()
    assert [r["deviation"] for r in got if r["vec_id"] == 1] == [None, None]
    assert all(r["whitened"] is None or np.isfinite(r["whitened"]) for r in got)


def test_deviation_leaves_64_bits_where_it_must():
    big = 10 ** 9
    w = Whitener(big, [big * 3, 5], np.eye(2) * big, [3, 0], 2)
    x = np.array([[2_000, -9], [3, 0]])
    assert w.deviation(x) == [(big * 2000 - 3 * big) ** 2 + (big * -9 - 5) ** 2, 25]
