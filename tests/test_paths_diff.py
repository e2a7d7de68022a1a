"""Deletion paths, closure and diffs against brute-force Python on small hand documents."""

import difflib
import random
import re

from pyspark.sql import functions as F

from editforge.operators import deps as D
from editforge.operators import diff as E
from editforge.operators import paths as P
from editforge.plans import corpus as C


def _doc(rnd, n_items, tag):
    """A small contract-shaped document with unique lines, nested blocks and uses."""
    lines = [f"pragma solidity ^0.4.{tag % 10};", f"contract K{tag} {{"]
    for i in range(n_items):
        lines.append(f"  uint v{tag}_{i} = {i};")
        if rnd.random() < 0.5:
            lines.append(f"  function g{tag}_{i}() {{")
            lines.append(f"    total{i} += v{tag}_{rnd.randrange(i + 1)};")
            if rnd.random() < 0.5:
                lines.append(f"    if (x{i}) {{ y{i}(); }}")
            lines.append(f"  }} // end {i}")
    lines.append("}")
    return lines


def _docs(rnd, n):
    """``n`` documents, all long enough (>= 6 lines) to enter path sampling."""
    return {100 + k: _doc(rnd, rnd.randint(4, 7), 100 + k) for k in range(n)}


def _lines_df(spark, docs):
    rows = [(ok, ln + 1, t) for ok, ls in docs.items() for ln, t in enumerate(ls)]
    return spark.createDataFrame(rows, "ok bigint, ln bigint, t string")


def _brute_steps(n_lines, rank, reqs):
    """Sequential reference loop: delete the first surviving line by rank, then
    repeatedly delete every line whose requirement is gone; step = turn of removal."""
    alive, step, turn = set(range(1, n_lines + 1)), {}, 0
    order = sorted(alive, key=lambda ln: rank[ln])
    while alive:
        turn += 1
        victim = next(ln for ln in order if ln in alive)
        alive.discard(victim)
        step[victim] = turn
        while True:
            bad = {ln for ln in alive if any(r not in alive for r in reqs.get(ln, ()))}
            if not bad:
                break
            for ln in bad:
                alive.discard(ln)
                step[ln] = turn
    return step


def test_closure_equals_sequential_loop(spark):
    docs = _docs(random.Random(3), 12)
    lines = _lines_df(spark, docs)
    pb = C.build_paths(lines, min_lines=6)
    ranks = {(r.ok, r.path_id, r.ln): r.rank for r in pb.ranks.collect()}
    edges = {}
    for e in pb.edges.collect():
        edges.setdefault(e.ok, {}).setdefault(e.ln, set()).add(e.req)
    got = {(r.ok, r.path_id, r.ln): r.step for r in pb.steps.collect()}
    for ok, ls in docs.items():
        for path in range(3):
            rank = {ln: ranks[(ok, path, ln)] for ln in range(1, len(ls) + 1)}
            want = _brute_steps(len(ls), rank, edges.get(ok, {}))
            assert {ln: got[(ok, path, ln)] for ln in rank} == want


def test_header_goes_last_and_blocks_pair_up(spark):
    docs = _docs(random.Random(5), 4)
    pb = C.build_paths(_lines_df(spark, docs), min_lines=6)
    n = {ok: len(ls) for ok, ls in docs.items()}
    for r in pb.ranks.where(F.col("ln") == 1).collect():
        assert r.rank == n[r.ok]
    e = {(r.ok, r.ln, r.req) for r in pb.edges.collect()}
    for ok, ls in docs.items():   # opener line 2 and the closing brace require each other
        assert (ok, 2, len(ls)) in e and (ok, len(ls), 2) in e


def _states(steps_rows, docs, cap=2000):
    by = {}
    for r in steps_rows:
        by.setdefault((r.ok, r.path_id), {})[r.ln] = r.step
    out = {}
    for (ok, p), st in by.items():
        m = min(max(st.values()), cap)
        out[(ok, p)] = ["\n".join(docs[ok][ln - 1] for ln in sorted(st) if st[ln] > k) for k in range(m + 1)]
    return out


def _difflib_hunks(a, b):
    a = a + "\n" if a and not a.endswith("\n") else a
    b = b + "\n" if b and not b.endswith("\n") else b
    d = difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), "prev", "curr", n=3)
    return "".join(x for x in d if not (x.startswith("---") or x.startswith("+++"))).strip()


def test_diffs_equal_difflib_on_unique_lines(spark):
    docs = _docs(random.Random(11), 10)
    pb = C.build_paths(_lines_df(spark, docs), min_lines=6)
    states = _states(pb.steps.collect(), docs)
    diffs = {(r.ok, r.path_id, r.fwd): r.diff for r in E.diff_hunks(pb.steps, pb.lines).collect()}
    assert diffs
    for (ok, p), st in states.items():
        fwd = st[::-1]
        for j in range(1, len(fwd)):
            assert diffs[(ok, p, j)] == _difflib_hunks(fwd[j - 1], fwd[j]), (ok, p, j)


def _replay(seq):
    cur, hunks, h = [], [], None
    for line in seq.split("\n"):
        m = re.match(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@$", line)
        if m:
            h = [int(m.group(3)), 1 if m.group(2) is None else int(m.group(2)), []]
            hunks.append(h)
        else:
            h[2].append(line[1:])
    for c, b, body in hunks:
        start = max(c - 1, 0)
        cur[start:start + b] = body
    return "\n".join(cur), len(hunks)


def test_replay_edit_sequence_gives_final_code(spark):
    docs = _docs(random.Random(13), 8)
    docs[999] = ["pragma solidity ^0.4.1;", "contract R {", "  }", "  }", "  uint a = 1;", "  uint a = 1;",
                 "}", "}"]   # repeated lines
    pb = C.build_paths(_lines_df(spark, docs), min_lines=6)
    recs = C.edit_records(pb).collect()
    assert len(recs) == 3 * len(docs)
    for r in recs:
        text, _ = _replay(r.edit_sequence)
        assert text == r.final_code == "\n".join(docs[r.original_line_no])


def test_hand_hunks(spark):
    # empty -> one line; two insertions 6 apart share a hunk, 7 apart do not
    lines = spark.createDataFrame([(1, 1, "x")], "ok bigint, ln bigint, t string")
    steps = spark.createDataFrame([(1, 0, 1, 1, 1, 1)], "ok bigint, path_id int, ln bigint, removal bigint, "
                                                        "step bigint, total_steps bigint")
    assert E.diff_hunks(steps, lines).first().diff == "@@ -0,0 +1 @@\n+x"

    def one_step(gap):
        n = gap + 2
        ls = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, n + 1)], "ok bigint, ln bigint, t string")
        st = spark.createDataFrame([(1, 0, i, 0, 1 if i in (1, n) else 2, 2) for i in range(1, n + 1)],
                                   "ok bigint, path_id int, ln bigint, removal bigint, step bigint, "
                                   "total_steps bigint")
        return E.diff_hunks(st, ls).where("fwd = 2").first().diff
    assert one_step(6).count("@@ -") == 1
    assert one_step(7).count("@@ -") == 2


def test_compat_drops_plus_plus_lines(spark):
    ls = spark.createDataFrame([(1, 1, "a"), (1, 2, "++i;")], "ok bigint, ln bigint, t string")
    st = spark.createDataFrame([(1, 0, 1, 0, 2, 2), (1, 0, 2, 0, 1, 2)],
                               "ok bigint, path_id int, ln bigint, removal bigint, step bigint, total_steps bigint")
    d = {r.fwd: r.diff for r in E.diff_hunks(st, ls).collect()}
    assert d[2] == "@@ -1 +1,2 @@\n a\n+++i;"
    dc = {r.fwd: r.diff for r in E.diff_hunks(st, ls, compat=True).collect()}
    assert dc[2] == "@@ -1 +1,2 @@\n a"


def test_states_shrink_and_validity(spark):
    docs = _docs(random.Random(17), 6)
    pb = C.build_paths(_lines_df(spark, docs), min_lines=6)
    v = D.snapshot_validity(pb.steps, pb.edges, 2000).collect()
    assert v and all(r.violations == 0 for r in v)
    by = {}
    for r in v:
        by.setdefault((r.ok, r.path_id), []).append((r.state, r.n_lines))
    for states in by.values():
        sizes = [n for _, n in sorted(states)]
        assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] == 0


def test_step_cap_leaves_final_code(spark):
    docs = _docs(random.Random(19), 3)
    pb = C.build_paths(_lines_df(spark, docs), min_lines=6, cap=2)
    full = {(r.ok, r.path_id): r.total_steps for r in pb.steps.select("ok", "path_id", "total_steps").collect()}
    s = P.path_summary(pb.steps, pb.lines, 2).collect()
    assert any(full[(r.ok, r.path_id)] > 2 for r in s)
    for r in s:
        if full[(r.ok, r.path_id)] > 2:
            assert r.total_steps == 2 and r.final_code != ""
        else:
            assert r.total_steps == full[(r.ok, r.path_id)] and r.final_code == ""


def _same_hunks(spark, docs, **options):
    from plain_hunks import plain_diff_hunks
    pb = C.build_paths(_lines_df(spark, docs))
    got = E.diff_hunks(pb.steps, pb.lines, **options).collect()
    want = plain_diff_hunks(pb.steps, pb.lines, **options).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_hunks_equal_plain_form_on_random_documents(spark):
    rnd = random.Random(17)
    docs = {k: [rnd.choice([f"uint a{k}_{i} = 1;", "++x;", "}", "{", f"f(a{k}_{rnd.randrange(i + 1)});", "plain"]) for i in range(rnd.randint(6, 30))] for k in range(500)}
    _same_hunks(spark, docs)
    _same_hunks(spark, {k: docs[k] for k in range(60)}, compat=True)
    _same_hunks(spark, {k: docs[k] for k in range(60)}, cap=4)
    _same_hunks(spark, {k: docs[k] for k in range(60)}, context=1)


def test_long_chain_keeps_its_paths(spark):
    chain = ["uint v0 = 1;"] + [f"uint v{i} = v{i - 1};" for i in range(1, 200)]
    pb = C.build_paths(_lines_df(spark, {1: chain}))
    ranks = {(r.path_id, r.ln): r.rank for r in pb.ranks.collect()}
    got = {(r.path_id, r.ln): r.removal for r in pb.steps.collect()}
    assert {p for p, _ in got} == {0, 1, 2} and len(got) == 600
    for path in range(3):
        least = 10 ** 9
        for ln in range(1, 201):
            least = min(least, ranks[path, ln])
            assert got[path, ln] == least


def test_long_document_gives_few_rows(spark):
    lines = [f'string s{i} = "x";' for i in range(2000)]
    pb = C.build_paths(_lines_df(spark, {1: lines}), n_paths=1)
    diffs = E.diff_hunks(pb.steps, pb.lines).collect()
    assert len(diffs) == 2000   # one independent line a step, no state is written out
    assert sum(d["diff"].count("\n") for d in diffs) <= 2000 * 8


def test_short_paths_have_the_hunks_of_long_ones():
    """Lines left as a list and as linked lines: the same diffs, whatever a step takes away."""
    import random

    from editforge.operators.diff import _path_hunks, _short_path_hunks
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(0, 40)
        top = rng.randint(1, n + 1)
        steps = [rng.randint(1, top) for _ in range(n)]
        texts = [rng.choice(["a", "++b", "", "--c"]) for _ in range(n)]
        args = steps, texts, rng.randint(1, top), rng.choice([0, 1, 3, 5]), rng.random() < 0.5
        assert list(_short_path_hunks(*args)) == list(_path_hunks(*args))


def test_texts_of_long_batches_are_read_in_pieces(spark, monkeypatch):
    from editforge.operators import diff as E
    from editforge.plans import corpus as C
    df = spark.createDataFrame([(ok, ln, f"uint v{ln % 4} = v{ln % 3};") for ok in range(9) for ln in range(1, 8 + ok)], "ok bigint, ln bigint, t string")
    rows = C.build_paths(df, min_lines=None).rows
    import pyarrow as pa
    batch = pa.Table.from_pylist([{"m": r["total_steps"], "lines": [{"t": x["t"], "step": x["step"]} for x in r["lines"]]} for r in rows.collect()]).combine_chunks().to_batches()
    got = []
    for size in (1, 40, 1 << 14):
        monkeypatch.setattr(E, "PIECE_LINES", size)
        got.append([b.to_pylist() for b in E._batch_hunks(3, False, ["m"])(batch)])
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 27
