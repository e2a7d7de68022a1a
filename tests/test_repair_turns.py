"""Turn-by-turn repair against the sequential loop over whole texts."""

import random

import pytest

from editforge.operators import deps as D
from editforge.operators import diff as E
from editforge.operators import paths as P
from editforge.operators.repair import MAX_PASSES, repair_turns
from editforge.operators.replay import replay
from editforge.plans import corpus as C


def loop(texts, order, requires, max_passes):
    """Delete a line, delete what is invalid pass by pass, record the state: (line numbers of each recorded state), turns."""
    state, recorded, turns = sorted(texts), [tuple(sorted(texts))], 0
    key = {ln: i for i, ln in enumerate(order)}
    while state:
        turns += 1
        header = next((ln for ln in state if texts[ln].strip().startswith("pragma solidity")), None)
        others = [ln for ln in state if ln != header]
        state.remove(min(others, key=key.get) if others else header)
        passes, valid = 0, False
        while max_passes is None or passes < max_passes:
            if not state:
                valid = True
                break
            errors = [ln for ln in state if any(r not in state for r in requires.get(ln, ()))]
            if not errors:
                valid = True
                break
            state = [ln for ln in state if ln not in errors]
            passes += 1
        if valid or not state:
            recorded.append(tuple(state))
    return recorded, turns


def run(spark, docs, edges, max_passes, parts=3):
    """docs: {ok: {ln: text}}, edges: {ok: {ln: [req]}}; the operator's recorded states and the loop's, path by path."""
    lines = spark.createDataFrame([(ok, ln, t) for ok, d in docs.items() for ln, t in d.items()], "ok long, ln long, t string").repartition(parts)
    needs = spark.createDataFrame([(ok, ln, r) for ok, d in edges.items() for ln, rs in d.items() for r in rs], "ok long, ln long, req long")
    ranks = P.deletion_order(lines, P.path_fanout(lines.select("ok").distinct()))
    got, order = {}, {}
    for r in repair_turns(lines, ranks, needs, max_passes).collect():
        got.setdefault((r["ok"], r["path_id"]), []).append(r)
    for r in ranks.collect():
        order.setdefault((r["ok"], r["path_id"]), []).append((r["rank"], r["ln"]))
    assert len(got) == 3 * len(docs)
    bounded = 0
    for path, rows in got.items():
        want, turns = loop(docs[path[0]], [ln for _, ln in sorted(order[path])], edges.get(path[0], {}), max_passes)
        m = rows[0]["total_steps"]
        assert m == len(want) - 1 and max(r["removal"] for r in rows) == turns
        assert [tuple(sorted(r["ln"] for r in rows if r["step"] > k)) for k in range(m + 1)] == want
        bounded += turns > m
    return bounded


def random_docs(seed, n, headers):
    rng = random.Random(seed)
    docs, edges = {}, {}
    for ok in range(n):
        size = rng.randint(4, 30)
        docs[ok] = {ln: f"x{ln}" for ln in range(1, size + 1)}
        for ln in rng.sample(range(1, size + 1), min(headers, size)):
            docs[ok][ln] = "  pragma solidity ^0.4.0;"
        edges[ok] = {ln: [r for r in rng.sample(range(1, size + 1), rng.randint(0, 2)) if r != ln] for ln in docs[ok]}
    return docs, edges


@pytest.mark.parametrize("headers", [0, 1, 2, 3])
def test_protection_passes_to_the_next_header(spark, headers):
    run(spark, *random_docs(headers, 60, headers), None)


@pytest.mark.parametrize("max_passes", [0, 1, 2, 3])
def test_bound_on_passes(spark, max_passes):
    assert run(spark, *random_docs(10 + max_passes, 60, 2), max_passes) > 0


def test_chains_around_the_bound(spark):
    docs, edges = {}, {}
    for ok, n in enumerate((49, 50, 51, 52, 101, 200)):
        docs[ok] = {ln: f"c{ln}" for ln in range(1, n + 1)}
        edges[ok] = {ln: [ln - 1] for ln in range(2, n + 1)}
    run(spark, docs, edges, MAX_PASSES)
    assert run(spark, docs, edges, 10) > 0


def test_equals_the_closed_form_without_the_two_rules(spark):
    docs, edges = random_docs(7, 40, 1)
    edges = {ok: {ln: r for ln, r in d.items() if not docs[ok][ln].strip().startswith("pragma")} for ok, d in edges.items()}
    lines = spark.createDataFrame([(ok, ln, t) for ok, d in docs.items() for ln, t in d.items()], "ok long, ln long, t string")
    needs = spark.createDataFrame([(ok, ln, r) for ok, d in edges.items() for ln, rs in d.items() for r in rs], "ok long, ln long, req long")
    ranks = P.deletion_order(lines, P.path_fanout(lines.select("ok").distinct()))
    want = P.steps_from_removal(D.repair_closure(ranks, needs)).select("ok", "path_id", "ln", "step", "total_steps")
    got = repair_turns(lines, ranks, needs, None).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_paths_of_the_loop_make_records_that_replay(spark):
    rows = []
    for ok in range(8):
        body = [f"uint v{i} = v{i - 1};" if i else "uint v0 = 1;" for i in range(70)]
        text = ["library L {", "pragma solidity ^0.4.1;", "}", "pragma solidity ^0.5.0;", *body[: 20 + ok * 7]]
        rows += [(ok, i + 1, t) for i, t in enumerate(text)]
    pb = C.build_paths(spark.createDataFrame(rows, "ok long, ln long, t string"), compat=True, max_passes=20)
    for r in replay(C.edit_records(pb)).collect():
        assert r["replayed"] == r["final_code"] and r["steps"] == r["steps_count"]
    assert E.diff_hunks(pb.steps, pb.lines).select("ok", "path_id").distinct().count() == 24


def test_empty(spark):
    none = spark.createDataFrame([], "ok long, ln long, t string, req long, path_id int, rank long")
    assert repair_turns(none, none, none).count() == 0


def test_violations_of_damaged_steps_equal_a_plain_count(spark):
    rng = random.Random(11)
    steps, edges = [], []
    for ok in range(20):
        n, m = rng.randint(1, 12), rng.randint(1, 8)
        steps += [(ok, 0, ln, rng.randint(1, m + 1), m) for ln in range(1, n + 1)]
        edges += [(ok, ln, r) for ln in range(1, n + 1) for r in rng.sample(range(1, n + 1), rng.randint(0, min(2, n))) if r != ln]
    got = D.snapshot_validity(spark.createDataFrame(steps, "ok long, path_id int, ln long, step long, total_steps long"), spark.createDataFrame(edges, "ok long, ln long, req long")).collect()
    step = {(ok, ln): s for ok, _, ln, s, _ in steps}
    for r in got:
        here = {ln for (ok, ln), s in step.items() if ok == r["ok"] and s > r["state"]}
        assert r["n_lines"] == len(here)
        assert r["violations"] == len({ln for ok, ln, q in edges if ok == r["ok"] and ln in here and q not in here})
    assert len(got) == sum({ok: m + 1 for ok, _, _, _, m in steps}.values()) and any(r["violations"] for r in got)
