"""The scope rule against a plain tree of blocks."""

import random
import re

from editforge.operators.deps import DECL_RE, IDENT_RE
from editforge.operators.replay import replay
from editforge.operators.scopes import scoped_dependencies
from editforge.plans import corpus as C

DECLARES = re.compile(DECL_RE.replace("++", "+"))


def plain(lines):
    """Edges of one document, block by block."""
    edges, stack, home, span = set(), [], {}, {}
    depth = 0
    openers = {}   # level -> opener line
    ends = {}
    for ln, t in enumerate(lines, 1):
        net = t.count("{") - t.count("}")
        before, depth = depth, depth + net
        home[ln] = (before, openers.get(before))
        for level in range(min(depth + 1, before), before + 1):
            o = openers.get(level)
            if o is not None:
                edges.add((ln, o))
                if level > depth:
                    edges.add((o, ln))
                    ends.setdefault((level, o), ln)
        for level in range(before + 1, depth + 1):
            openers[level] = ln
    declared = {}
    for ln, t in enumerate(lines, 1):
        m = DECLARES.match(t)
        if m:
            level, o = home[ln]
            declared.setdefault(m.group(1), {}).setdefault((level, o), ln)
    for ln, t in enumerate(lines, 1):
        m = DECLARES.match(t)
        own = m.group(1) if m else ""
        for name in set(re.findall(IDENT_RE, t)) - {own}:
            around = [((o or 0, level), first) for (level, o), first in declared.get(name, {}).items()
                      if o is None or (o < ln and ln <= ends.get((level, o), 10**9))]
            if around:
                edges.add((ln, max(around)[1]))
    return {(a, b) for a, b in edges if a != b}


def document(rng, n):
    lines, depth = [], 0
    for i in range(n):
        r, name = rng.random(), rng.choice("abc")
        if r < 0.25 and depth < 5:
            lines.append(f"f{i}({name}) {{")
            depth += 1
        elif r < 0.45 and depth:
            lines.append("}")
            depth -= 1
        elif r < 0.7:
            lines.append(f"uint {name} = {rng.choice('abc')} + {i};")
        else:
            lines.append(f"{name} += {rng.choice('abc')};")
    return lines + ["}"] * (depth if rng.random() < 0.8 else 0)


def run(spark, docs):
    df = spark.createDataFrame([(ok, i, t) for ok, d in docs.items() for i, t in enumerate(d, 1)], "ok long, ln long, t string")
    got = {}
    for r in scoped_dependencies(df.repartition(3)).collect():
        got.setdefault(r["ok"], set()).add((r["ln"], r["req"]))
    return got


def test_random_documents(spark):
    rng = random.Random(3)
    docs = {ok: document(rng, rng.randint(1, 40)) for ok in range(150)}
    got = run(spark, docs)
    for ok, d in docs.items():
        assert got.get(ok, set()) == plain(d), d


def test_inner_declarations_hide_outer_ones(spark):
    doc = ["contract C {", "uint x = 1;", "f() {", "uint x = 2;", "x += 1;", "}", "g() {", "x += 1;", "h() {", "x += 2;", "uint x = 3;", "}", "x += 3;", "}", "}"]
    got = run(spark, {1: doc})[1]
    uses = {ln: {r for a, r in got if a == ln} & {2, 4, 11} for ln in (5, 8, 10, 13)}
    assert uses == {5: {4}, 8: {2}, 10: {11}, 13: {2}}


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "uint a;"), (1, 3, "a = 1;")], "ok long, ln long, t string")
    assert [tuple(r) for r in scoped_dependencies(df).collect()] == [(1, 3, 2)]
    assert scoped_dependencies(df.limit(0)).count() == 0


def test_lines_spread_by_key_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(1, 1, "uint a;"), (1, 2, "a = 1;"), (2, 1, "{"), (2, 2, "}")], "ok long, ln long, t string").repartition("ok")
    edges = scoped_dependencies(df)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 1), (2, 1, 2), (2, 2, 1)]


def test_either_rule_builds_paths(spark):
    rng = random.Random(5)
    docs = {ok: document(rng, 25) for ok in range(6)}
    df = spark.createDataFrame([(ok, i, t) for ok, d in docs.items() for i, t in enumerate(d, 1)], "ok long, ln long, t string")
    for rule in (scoped_dependencies, C.D.line_dependencies):
        pb = C.build_paths(df, rule=rule)
        for r in replay(C.edit_records(pb)).collect():
            assert r["replayed"] == r["final_code"] and r["bad_hunk"] is None
