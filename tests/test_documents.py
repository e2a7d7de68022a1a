"""Built documents: one row per document gives what the tables of lines and steps give, and nothing large is broadcast."""

import random

from pyspark.sql import functions as F

from editforge.operators import deps as D
from editforge.operators import diff as E
from editforge.operators import paths as P
from editforge.operators import sft as S
from editforge.plans import corpus as C
from editforge.sources import jsonl as J


def lines(spark, seed=3, n=12):
    rng = random.Random(seed)
    rows = []
    for ok in range(n):
        body = ["pragma solidity ^0.4.1;"] * (ok % 2) + ["contract C {"] + [f"uint v{i} = v{rng.randrange(i + 1)};" for i in range(rng.randint(3, 9))] + ["}"]
        rows += [(ok, i, t) for i, t in enumerate(body, 1)]
    return spark.createDataFrame(rows, "ok bigint, ln bigint, t string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Exchange")


def test_document_rows_equal_the_tables(spark):
    pb = C.build_paths(lines(spark))
    order = P.deletion_order(pb.lines, pb.paths)
    assert rows(P.steps_from_removal(D.repair_closure(order, pb.edges)).select("ok", "path_id", "ln", "removal", "step", "total_steps")) == rows(pb.steps)
    for cap in (None, 2):
        assert rows(P.row_summary(pb.rows, cap)) == rows(P.path_summary(pb.steps, pb.lines, cap))
        states = P.snapshots(pb.steps, pb.lines, cap)
        assert rows(P.row_snapshots(pb.rows, cap)) == rows(states)
        assert rows(E.row_adjacent_pairs(pb.rows, cap)) == rows(E.adjacent_pairs(states))
        assert rows(P.document_diversity(pb.documents, cap)) == rows(P.path_diversity(pb.steps, cap))
        assert rows(J.document_bundle(pb.documents, cap)) == rows(J.path_bundle(states, P.path_summary(pb.steps, pb.lines, cap)))
        hunks = E.row_hunks(pb.rows, cap)
        assert rows(E.hunk_rows(hunks)) == rows(E.diff_hunks(pb.steps, pb.lines, cap))
        assert rows(E.row_sequence(hunks).select("ok", "path_id", "edit_sequence", "steps_count")) == rows(E.edit_sequence(E.hunk_rows(hunks)))


def test_no_shuffle_behind_the_build(spark):
    pb = C.build_paths(lines(spark))
    for df in (C.edit_records(pb), P.row_snapshots(pb.rows), E.row_adjacent_pairs(pb.rows), J.document_bundle(pb.documents), P.document_diversity(pb.documents)):
        assert exchanges(df)[1] == 0


def test_repeated_documents_join_each_step_with_each_text(spark):
    df = lines(spark, n=3)
    pb = C.build_paths(df.union(df))
    got = {(r["ok"], r["path_id"]): r["initial_code"] for r in P.row_summary(pb.rows).collect()}
    text = {}
    for r in df.orderBy("ok", "ln").collect():
        text.setdefault(r["ok"], []).extend([r["t"]] * 4)
    assert got == {(ok, p): "\n".join(t) for ok, t in text.items() for p in range(3)}


def test_responses_and_steps_are_not_broadcast(spark):
    pb = C.build_paths(lines(spark))
    answers = spark.range(12).select(F.col("id").alias("original_line_no"), F.lit("do").alias("instruction"))
    records = spark.createDataFrame(C.edit_records(pb).collect(), C.edit_records(pb).schema)
    for df in (S.attach_instruction(records, answers), D.snapshot_validity(pb.steps, pb.edges)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    """What one task holds of the lines is bounded, however small their files are."""
    monkeypatch.setattr(C, "TASK_LINES", 16)
    df = lines(spark, n=60).cache()
    want = rows(D.line_dependencies(df))
    pb = C.build_paths(df, min_lines=None)
    assert rows(pb.edges) == want
    assert pb.edges.rdd.getNumPartitions() >= df.count() // 16


def orders(spark, path, n):
    """Tables of n orders with one line item each."""
    spark.range(n).selectExpr("id o_orderkey", "id o_custkey").write.parquet(f"{path}/orders.parquet")
    spark.range(n).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "2 l_quantity", "'R' l_returnflag", "'F' l_linestatus",
                              "date'2020-01-01' l_shipdate", "1.5d l_extendedprice").write.parquet(f"{path}/lineitem.parquet")


def test_line_items_are_spread_by_their_count(spark, tmp_path, monkeypatch):
    from editforge.functions import numbering
    from editforge.sources import fixtures as X
    monkeypatch.setattr(numbering.tasks_for, "__defaults__", (10,))
    n = 200
    orders(spark, tmp_path, n)
    docs = X.code_docs(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == n // 10
    assert docs.where("code is not null").count() == n


def test_header_lines_read_the_code_once(spark, tmp_path):
    from editforge.sources import fixtures as X
    orders(spark, tmp_path, 4)
    df = X.header_lines(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 2
    for ok in range(4):
        texts = [r["t"] for r in df.where(f"ok = {ok}").orderBy("ln").collect()]
        assert texts[:6] == [*X.TWO_HEADERS, f"contract C{ok} {{"] and len(texts) > 6


def test_rule_in_the_document_equals_the_windows(spark):
    """Braces that do not close, names beside digits and letters of other scripts, literals with escapes and line ends, missing texts, repeated documents."""
    rng = random.Random(5)
    parts = ["{", "}", "{{", "}}", "uint a", "uint8  public a1 = 2a;", "\x0bint memory", "string s = \"x{a\\\"}\"", "'b}\\'", "a", "9a1", "_b.a", "é1a", "\"a\r{\\\r\"", "\"\\ }\" a", "bytes32 b", "byte\tstorage c", "uint publicx",
             "address \x85 d", "\"", "'", "\\", "bool constant c;", "c=d+publicx*memory"]
    rows_in = []
    for ok in range(80):
        for ln in range(1, rng.randint(2, 14)):
            rows_in.append((ok, ln * 3 - 20, None if rng.random() < 0.05 else " ".join(rng.choices(parts, k=rng.randint(1, 4))) if rng.random() < 0.7 else "\r".join(rng.choices(parts, k=2))))
    rows_in += [r for r in rows_in if r[0] % 7 == 0]
    df = spark.createDataFrame(rows_in, "ok bigint, ln bigint, t string")
    docs = P.document_lines(df).collect()
    import numpy as np
    import pyarrow as pa
    ln, texts = np.array([x["ln"] for d in docs for x in d["lines"]]), pa.array([x["t"] for d in docs for x in d["lines"]], pa.string())
    n, lines_, reqs = D.document_dependencies(np.array([len(d["lines"]) for d in docs]), ln, texts)
    got = sorted(zip(np.repeat([d["ok"] for d in docs], n).tolist(), lines_.tolist(), reqs.tolist()))
    assert len(got) > 300 and got == rows(D.line_dependencies(df))


def test_default_build_reads_its_documents_once(spark):
    """Default rule: no edges, lines or orders are written or shuffled beside the documents."""
    made = []
    write, C.materialize = C.materialize, lambda df, name="stage": made.append(df) or write(df, name)
    try:
        C.build_paths(lines(spark), min_lines=None)
    finally:
        C.materialize = write
    assert len(made) == 1 and exchanges(made[0])[1] == 1


def test_eligible_documents_equal_their_lines(spark):
    """Short, empty and missing texts, a missing key, keys that repeat with other and equal texts: the same rows, none of them a line before the shuffle."""
    text = lambda i, n: "\n".join(["contract C {", *(f"uint v{k} = {i};" for k in range(n - 2)), "}"])
    docs = [(i % 9, text(i, 4 + i % 5)) for i in range(30)] + [(20, text(1, 7))] * 2 + [(None, text(2, 8)), (21, None), (22, ""), (23, text(3, 5)), (24, "\n" * 6)]
    df = spark.createDataFrame(docs, "ok bigint, code string")
    got = P.eligible_documents(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert plan.count("Exchange") == 1
    assert rows(got) == rows(P.document_lines(P.eligible_lines(df))) and {20, 24} <= {r["ok"] for r in got.collect()}
    for n in (None, 7):
        a, b = C.build_paths(got, min_lines=n), C.build_paths(P.eligible_lines(df), min_lines=n)
        assert rows(a.steps) == rows(b.steps) and rows(a.lines) == rows(b.lines) and rows(a.edges) == rows(b.edges)


def test_registered_builds_shuffle_documents_not_lines(spark):
    """Builds whose texts do not lie by document make no row per line before the documents are written."""
    from editforge.plans import queries as Q
    made = []
    write, C.materialize = C.materialize, lambda df, name="stage": made.append(df) or write(df, name)
    try:
        Q.q_edit_corpus(spark, "/root/testdata/sf0.001"), Q._status_build(spark, "/root/testdata/sf0.001")
    finally:
        C.materialize = write
    assert len(made) == 2 and not any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in made)
    assert "Generate" in P.document_lines(P.eligible_lines(Q.X.clean_docs(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()


def test_validity_of_documents_equals_the_tables(spark):
    """L7 in the document's row: no shuffle without edges of one's own; damaged steps, caps, repeated documents and other edges count alike."""
    df = lines(spark, n=9)
    late = lambda ln, step, total: F.when(ln % 3 == 0, F.least(step + 2, total + 1)).otherwise(step)
    bad = 0
    for given in (df, df.union(df.where("ok < 4"))):
        pb = C.build_paths(given)
        damaged = P.with_steps(pb.documents, late)
        own = pb.edges.select("ok", (F.col("ln") + 1).alias("ln"), (F.col("req") - 1).alias("req"))
        for cap in (None, 3):
            assert exchanges(D.snapshot_validity(damaged, None, cap))[1] == 0
            for docs in (pb.documents, damaged):
                steps = P.step_rows(docs)
                want = rows(D.snapshot_validity(steps, pb.edges, cap))
                assert rows(D.snapshot_validity(docs, None, cap).select("ok", "path_id", "state", "n_lines", "violations")) == want
                bad += sum(r[4] for r in want)
                assert rows(D.snapshot_validity(docs, own, cap)) == rows(D.snapshot_validity(steps, own, cap))
    assert bad


def test_validity_of_many_documents_goes_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_LINES", 20)
    pb = C.build_paths(lines(spark, n=40))
    batch = pb.documents.toArrow().combine_chunks().to_batches()[0]
    assert len(list(D._pieces(batch))) > 5
    got = [tuple(r.values()) for piece in D._pieces(batch) for r in D._state_counts(piece.rename_columns(["key", "lines", "paths"]), None).to_pylist()]
    assert sorted(got) == rows(D.snapshot_validity(pb.steps, pb.edges))


def test_instructions_join_documents_as_they_join_records(spark):
    """Repeated and missing responses, null instructions, short documents: the same records, and no edit sequence in a shuffle."""
    df = lines(spark, n=8)
    answers = spark.createDataFrame([(0, " a "), (1, "b"), (1, "b"), (2, None), (3, "c\n"), (77, "d"), (None, "e")], "original_line_no bigint, instruction string")
    short = spark.createDataFrame([(3, i, str(i)) for i in range(40, 47)] + [(90, i, str(i)) for i in range(1, 8)], "ok bigint, ln bigint, t string")
    given = df.union(short)
    answers = answers.union(spark.createDataFrame([(90, "f")], answers.schema))
    want = rows(S.attach_instruction(C.edit_records(C.build_paths(given, min_lines=None)), answers).select("original_line_no", "path_id", "final_code", "edit_sequence", "steps_count", "instruction"))
    records = S.instruct_eligible(C.records_once(S.attach_instruction(P.document_lines(given), answers, key="ok")))
    assert sorted(map(str, rows_of(records))) == sorted(map(str, want)) and len(want) == 3 * 5
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def rows_of(df):
    return [tuple(r) for r in df.select("original_line_no", "path_id", "final_code", "edit_sequence", "steps_count", "instruction").collect()]


def tables(spark, path, n):
    orders(spark, path, n)
    spark.createDataFrame([(c, t, "assistant" if t else "user", f"text {c} {t}") for c in range(5) for t in range(3)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")


def test_texts_of_responses_are_not_shuffled_by_order(spark, tmp_path, monkeypatch):
    from editforge.functions import numbering
    from editforge.sources import fixtures as X
    monkeypatch.setattr(numbering.tasks_for, "__defaults__", (10,))
    tables(spark, tmp_path, 40)
    joined = X.responses(spark, str(tmp_path))
    got = rows(joined)
    assert got == sorted((ok, f"text {ok % 5} 1") for ok in range(40))
    records = C.records_once(S.attach_instruction(P.document_lines(P.eligible_lines(X.clean_docs(spark, str(tmp_path)))), joined, key="ok"))
    # Line items, orders (twice: codes, responses) are dealt by key; texts are sent, and neither they nor documents are dealt again.
    assert exchanges(records)[0] == 3 and "BroadcastExchange" in records._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "TURNS_SENT", 0)
    assert rows(X.responses(spark, str(tmp_path))) == got


def test_dual_sink_writes_packed_lines(spark, tmp_path):
    import gzip
    import json
    sft = spark.createDataFrame([(5, 0, "final", "edits", 2, "do"), (6, 1, "final", "edits", 1, None)],
                                "original_line_no bigint, path_id bigint, final_code string, edit_sequence string, steps_count bigint, instruction string")
    assert tuple(S.dual_sink(sft, f"{tmp_path}/a", f"{tmp_path}/b").first()) == (2, 2, 0)
    for name, output in (("a", "edits"), ("b", "final")):
        found = [json.loads(x) for f in sorted((tmp_path / name).glob("*.gz")) for x in gzip.open(f, "rt")]
        assert sorted((x["original_line_no"], x["instruction"], x["output"]) for x in found) == [(5, "do", output), (6, None, output)]


def test_sequences_of_documents_equal_those_of_paths(spark, monkeypatch):
    """E1, E2 and E4 in the document's row, also without written documents: repeated documents, caps, marks, long paths, small pieces, further columns."""
    df = lines(spark, n=9)
    long = spark.createDataFrame([(50, i, f"line {i}") for i in range(1, 61)], df.schema)
    names = ["original_line_no", "path_id", "final_code", "edit_sequence", "steps_count"]
    for given in (df.union(long), df.union(df.where("ok < 4"))):
        pb = C.build_paths(given, min_lines=None)
        for cap, sep in ((None, E.JOIN_SEPARATOR), (3, E.TAGGED_SEPARATOR), (0, E.JOIN_SEPARATOR)):
            hunks = E.row_hunks(pb.rows, cap, keep=P.summary_columns())
            want = rows(E.row_records(E.row_sequence(hunks, sep)).select(names))
            with monkeypatch.context() as m:
                m.setattr(E, "PIECE_ROWS", 2)
                m.setattr(E, "SHORT_PATH", 20)
                assert rows(C.document_records(pb.documents, cap, sep=sep)) == want
            told = C.records_once(P.document_lines(given).withColumn("mark", F.col("ok") * 2), cap, sep=sep)
            assert told.where("mark = original_line_no * 2").count() == len(want) and rows(told.select(names)) == want
    assert E.document_sequences(pb.documents.where("ok < 0")).count() == 0
