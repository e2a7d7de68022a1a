"""Diagnostics (L1, L2, L6, B7) and version resolution (L4, L5) hand cases."""

from pyspark.sql import functions as F

from editforge.operators import deps as D
from editforge.operators import diagnostics as G
from editforge.operators import versions as V


def _log(spark, lines):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(lines)], "doc bigint, pos bigint, t string")


def test_error_lookahead_four_lines(spark):
    found = G.error_lines(_log(spark, ["Error: x", "a", "b", "c", "--> f.sol:7:3:"])).collect()
    assert [(r.kind, r.line_no) for r in found] == [("header", 7)]
    missed = G.error_lines(_log(spark, ["Error: x", "a", "b", "c", "d", "--> f.sol:7:3:"])).collect()
    assert [(r.kind, r.line_no) for r in missed] == [("header", None)]
    inline = G.error_lines(_log(spark, ["a.sol:12:5: Error: y", "TypeError: t", "Warning: w"])).collect()
    assert [(r.kind, r.line_no) for r in inline] == [("inline", 12)]


def test_error_lookahead_across_blocks(spark):
    # a tiny block size forces the header and its location into different blocks (halo rows)
    log = _log(spark, ["x", "x", "Error: e", "y", "--> f.sol:3:1:", "z"])
    assert [r.line_no for r in G.error_lines(log, block=3).collect()] == [3]


def test_fallback_is_deterministic_and_in_range(spark):
    errs = G.error_lines(_log(spark, ["Error: a", "Error: b"]))
    counts = spark.createDataFrame([(1, 5)], "doc bigint, n_lines bigint")
    a = sorted(r.line_no for r in G.error_line_fallback(errs, counts).collect())
    b = sorted(r.line_no for r in G.error_line_fallback(errs, counts).collect())
    assert a == b and all(1 <= x <= 5 for x in a)
    none = spark.createDataFrame([(1, 0)], "doc bigint, n_lines bigint")
    assert G.error_line_fallback(errs, none).count() == 0


def test_error_context_and_repair(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 21)], "doc bigint, ln bigint, t string")
    errs = spark.createDataFrame([(1, 10)], "doc bigint, line_no bigint")
    ctx = G.error_context(lines, errs).collect()
    assert [r.ln for r in ctx] == list(range(7, 14)) and [r.ln for r in ctx if r.marker == ">>"] == [10]
    none = spark.createDataFrame([(1, 99)], "doc bigint, line_no bigint")
    assert [r.ln for r in G.error_context(lines, none).collect()] == list(range(1, 11))
    out = D.repair_by_error_lines(lines.withColumnRenamed("doc", "ok"),
                                  spark.createDataFrame([(1, 99)], "ok bigint, ln bigint")).collect()
    assert len(out) == 19 and max(r.old_ln for r in out) == 19   # nothing deletable: last line goes


def _resolve(spark, exprs, compat):
    e = spark.createDataFrame([(x,) for x in exprs], "expr string")
    cat = spark.createDataFrame([(0, 4, p) for p in range(27)] + [(0, 5, p) for p in range(18)]
                                + [(0, 6, p) for p in range(13)], "major int, minor int, patch int")
    return {r.expr: r.version for r in V.resolve_version(e, cat, compat).collect()}


def test_version_resolution_default_and_compat(spark):
    exprs = ["^0.4.3", "0.4.11", ">=0.4.2 <0.6.0", "=0.4.9", ">= 0.4.5", "~0.4.1", "^9.9.9", None]
    d = _resolve(spark, exprs, False)
    assert d["^0.4.3"] == "0.4.26" and d["0.4.11"] == "0.4.11" and d[">=0.4.2 <0.6.0"] == "0.5.17"
    assert d["=0.4.9"] == "0.4.9" and d[">= 0.4.5"] == "0.6.12" and d["~0.4.1"] == "0.6.12"
    assert d["^9.9.9"] == "0.6.12" and d[None] == "0.6.12"
    c = _resolve(spark, exprs, True)
    assert c["=0.4.9"] == "0.6.12" and c[">= 0.4.5"] == "0.4.5"


def test_pragma_extract(spark):
    df = spark.createDataFrame([("x\nPragma  Solidity >=0.4.2 <0.6.0 ;\n",), ("none",)], "code string")
    assert [r.e for r in df.select(V.pragma_expr(F.col("code")).alias("e")).collect()] == [">=0.4.2 <0.6.0", None]
