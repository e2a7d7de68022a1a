"""The scanning automaton against a plain loop over each log."""

import random
import re

import numpy as np
import pytest

from editforge.operators.scan import LOOKAHEAD, STATES, scan, scan_errors


def loop(lines):
    """One log read from top to bottom: (position, kind, line number or None)."""
    out, i = [], 0
    while i < len(lines):
        t = (lines[i] or "").strip()
        if t.startswith("Error:"):
            stop, found = min(i + 1 + LOOKAHEAD, len(lines)), None
            j = i + 1
            while j < stop:
                found = re.match(r"--> \S+:(\d+):\d+:", (lines[j] or "").strip())
                if found:
                    break
                j += 1
            out.append((i + 1, "header", int(found.group(1)) if found else None))
            i = j
            continue
        inline = re.search(r":(\d+):\d+: Error:", t)
        if inline:
            out.append((i + 1, "inline", int(inline.group(1))))
        i += 1
    return out


TEXTS = ["Error: a", "  Error: b", "--> f.sol:7:1:", " --> g.sol:12:3:", "--> f.sol:9:1: x.sol:5:2: Error: both", "a.sol:3:4: Error: c", "Error: d :8:9: Error: e", "Warning: w", "|", "", None, "TypeError: t", "--> f.sol"]


def logs(rng, n, most):
    return {d: [rng.choice(TEXTS[:7] if rng.random() < 0.7 else TEXTS) for _ in range(rng.randint(1, most))] for d in range(n)}


@pytest.mark.parametrize("block,fan", [(1, 2), (2, 3), (5, 2), (7, 4), (1 << 16, 1 << 10)])
def test_blocks_of_any_size_read_alike(spark, block, fan):
    docs = logs(random.Random(block), 40, 60)
    docs[None] = docs[3]
    rows = [(d, i + 1, t, 1) for d, lines in docs.items() for i, t in enumerate(lines)]
    random.Random(1).shuffle(rows)
    got = scan_errors(spark.createDataFrame(rows, "doc long, pos int, t string, blk int").repartition(5), block, fan).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *e) for d, lines in docs.items() for e in loop(lines)), key=str)


def test_a_hot_log_is_split(spark):
    """One log with two thirds of all lines, headers so dense that no block starts in a state known beforehand."""
    rng = random.Random(4)
    docs = {"hot": [rng.choice(TEXTS[:2] * 4 + TEXTS[2:6]) for _ in range(4000)], "x": TEXTS, "none": ["|"] * 9}
    rows = [(d, i + 1, t) for d, lines in docs.items() for i, t in enumerate(lines)]
    got = scan_errors(spark.createDataFrame(rows, "doc string, pos long, t string"), block=37, fan=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *e) for d, lines in docs.items() for e in loop(lines)), key=str)


def test_empty(spark):
    assert scan_errors(spark.createDataFrame([], "doc long, pos long, t string")).count() == 0


def test_blocks_are_read_by_the_batch(spark):
    """Short logs by the thousand: no step calls Python once a block."""
    rows = [(d, i + 1, "Error: a") for d in range(40) for i in range(5)]
    got = scan_errors(spark.createDataFrame(rows, "doc long, pos long, t string"), block=2, fan=2)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 40


def test_functions_compose():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        header = rng.random(n) < 0.4
        loc = np.where(~header & (rng.random(n) < 0.3), 5, 0)
        inline = np.where(~header & (rng.random(n) < 0.3), 6, 0)
        cut = int(rng.integers(0, n + 1))
        part = lambda a, b: (np.flatnonzero(header[a:b]).tolist(), loc[a:b], inline[a:b])
        for state in range(STATES):
            middle, first = scan(*part(0, cut), state)
            end, second = scan(*part(cut, n), middle)
            whole, found = scan(*part(0, n), state)
            assert whole == end
            best = {}
            for place, kind, line in first + [(p + cut, k, v) for p, k, v in second]:
                best[place, kind] = max(best.get((place, kind), 0), line or 0)
            want = {}
            for place, kind, line in found:
                want[place, kind] = max(want.get((place, kind), 0), line or 0)
            assert best == want
