"""Error channel: which records are in error, how they are counted, what the reports say of them."""

import json

from pyspark.sql import functions as F

from editforge.operators import errors as ER
from editforge.operators import paths as P
from editforge.operators import sft as S
from editforge.plans import corpus as C

CODE = "\n".join(["pragma solidity ^0.4.0;", "contract A {", "uint a;", "uint b;", "uint c;", "uint d;", "}"])
LINES = [json.dumps({"contract": CODE}), json.dumps({"contract": CODE})[:30], json.dumps({"contract": 7}), json.dumps([CODE]),
         json.dumps({"contract": None}), json.dumps({"other": 1}), "   ", json.dumps({"contract": " \n "}), json.dumps({"contract": "a\nb"}),
         json.dumps({"contract": False}), json.dumps({"contract": ["x"]}), json.dumps({"contract": {"a": 1}}), "3", '"text"']
ERRORS = [None, "bad_json", "not_text", "not_object", "not_text", None, "blank", None, None, "not_text", "not_text", "not_text", "not_object", "not_object"]


def plain_status(line):
    """What reading one line at a time says."""
    try:
        code = json.loads(line).get("contract", "").strip()
    except Exception:
        return "error"
    return "empty_code" if not code else "skipped_too_short" if len(code.splitlines()) < P.MIN_LINES else "success"


def scan(spark):
    return spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "ok bigint, raw string")


def test_errors_of_lines(spark):
    got = {r["ok"]: r for r in ER.read_code(scan(spark)).collect()}
    assert set(got) == {i for i, e in enumerate(ERRORS) if e != "blank"}
    for i, r in got.items():
        assert r["error"] == ERRORS[i]
        assert (r["code"] is None) == (ERRORS[i] is not None)
    assert got[0]["code"] == CODE and got[5]["code"] == got[7]["code"] == ""
    assert ER.read_code(scan(spark).limit(0)).count() == 0


def test_extra_error_column_is_replaced(spark):
    df = scan(spark).withColumn("error", F.lit("old")).withColumn("status", F.lit("old"))
    assert {r["error"] for r in ER.read_code(df).collect()} == set(ERRORS) - {"blank"}


def test_first_error_holds(spark):
    df = ER.flag(ER.flag(spark.range(4), F.col("id") > 1, "bad_json"), F.col("id") > 0, "not_text")
    assert [r["error"] for r in df.orderBy("id").collect()] == [None, "not_text", "bad_json", "bad_json"]


def test_status_equals_line_by_line(spark):
    docs = ER.read_code(scan(spark)).select("ok", "code", "error")
    pb = C.build_paths(P.eligible_lines(docs.where("error is null")), min_lines=None)
    want = {i: plain_status(line) for i, line in enumerate(LINES) if line.strip()}
    for build in (pb, None):
        routed = C.status_route(docs, build)
        assert {r["ok"]: r["status"] for r in routed.collect()} == want
        report = {r["status"]: (r["n_docs"], r["n_paths"]) for r in S.status_report(spark, routed).collect()}
        assert report["error"] == (sum(s == "error" for s in want.values()), 0)
        assert report["success"] == (1, 3) and report["empty_code"] == (2, 0) and report["skipped_too_short"] == (1, 0)


def test_missing_path_is_an_error(spark):
    docs = spark.createDataFrame([(i, CODE) for i in range(3)], "ok bigint, code string")
    pb = C.build_paths(P.eligible_lines(docs), min_lines=None)
    pb.steps = pb.steps.where("not (ok = 1 and path_id = 2) and ok <> 2")
    assert {r["ok"]: (r["status"], r["n_paths"]) for r in C.status_route(docs, pb).collect()} == {0: ("success", 3), 1: ("error", 2), 2: ("failed_logic", 0)}


def test_counts_come_with_the_write(spark, tmp_path):
    counts = ER.counted_write(ER.read_code(scan(spark)).select("ok", "code", "error"), str(tmp_path / "out"))
    assert counts == {"rows": 13, "errors": 9, "bad_json": 1, "not_object": 3, "not_text": 5, "missing_path": 0}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13


def test_diff_report_counts_errors(spark):
    docs = ER.read_code(scan(spark)).select("ok", "code", "error")
    pb = C.build_paths(P.eligible_lines(docs.where("error is null")), min_lines=None)
    row = ER.diff_report(docs, pb.steps, C.edit_records(pb)).first()
    assert (row["total"], row["processed"], row["skipped"], row["errors"]) == (12, 3, 0, 9)
    none = ER.diff_report(docs, pb.steps, C.edit_records(pb).where("path_id = 0")).first()
    assert (none["total"], none["processed"], none["skipped"], none["errors"]) == (12, 1, 2, 9)
