"""Deletion paths (backward sampling) as a bulk job: B1, B2, B5, B6, A6, A7, F2.

A path deletes one random surviving line per turn, then deletes whatever
became invalid, until the text is empty. Choosing uniformly among surviving
lines each turn is distributed like one random permutation whose deleted
entries are skipped, so a path is fully described by a per-line rank (B2) and
the closure of requirements (B4, ``deps.py``): ``step(line)`` is the turn at
which the line disappears. States are then ``lines with step > k``.

A document is one input record. Built paths are kept as one row per document
(``corpus.build_paths``) and read as one row per path (``path_rows``); states, pairs
and summaries are worked out in that row, so no text is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values (reference settings) ---------------------------------------
PATHS_PER_DOC = 3
MIN_LINES = 6
MAX_DELETIONS = 2000
SEED_BASE = 42
HEADER_RE = "(?U)^[\\s\\x1c-\\x1f]*pragma solidity"   # strip().startswith("pragma solidity")
# -----------------------------------------------------------------------------


def min_lines(lines: DataFrame, n: int = MIN_LINES, key: str = "ok") -> DataFrame:
    """documents with at least ``n`` lines -> (key, n_lines)."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= n)


def eligible_lines(docs: DataFrame, n: int = MIN_LINES, key: str = "ok", code: str = "code") -> DataFrame:
    """F1+F2 at document level, then one row per line: (key, ln, t, n_lines).

    ``docs`` holds normalised texts (P5: no blank lines, joined by ``\\n``), so
    the line count is the size of the split and no aggregate is needed. The
    size test sits inside the generator rather than in a Filter: a Filter
    would be pushed below the projection and evaluate the cleaning
    expressions of ``code`` twice.
    """
    d = docs.select(key, F.split(F.col(code), "\n", -1).alias("_a"))
    x = d.select(key, F.posexplode(F.when(F.size("_a") >= n, F.col("_a"))).alias("_p", "t"),
                 F.size("_a").cast("bigint").alias("n_lines"))
    return x.select(key, (F.col("_p") + 1).cast("bigint").alias("ln"), "t", "n_lines")


def path_fanout(docs: DataFrame, n_paths: int = PATHS_PER_DOC, seed_base: int = SEED_BASE,
                key: str = "ok") -> DataFrame:
    """B1 (+P10): ``n_paths`` paths per document with seed ``base + key*1000 + path``."""
    return (docs.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("path_id"))
            .withColumn("seed", (F.lit(seed_base) + F.col(key) * 1000 + F.col("path_id")).cast("bigint")))


def deletion_order(lines: DataFrame, paths: DataFrame, key: str = "ok") -> DataFrame:
    """B2: (key, path_id, ln, rank); rank 1 is deleted first, the first header line last."""
    hdr = Window.partitionBy(key)
    marked = lines.select(key, "ln", F.regexp_like(F.col("t"), F.lit(HEADER_RE)).alias("_h"))
    marked = marked.withColumn("hdr_ln", F.min(F.when(F.col("_h"), F.col("ln"))).over(hdr))
    joined = marked.join(paths, key)
    w = Window.partitionBy(key, "path_id").orderBy(
        F.coalesce(F.col("ln") == F.col("hdr_ln"), F.lit(False)),
        T.md5_order_key(F.col("seed"), F.col("ln")), F.col("ln"))
    return joined.select(key, "path_id", "ln", F.row_number().over(w).cast("bigint").alias("rank"))


def document_lines(lines: DataFrame, key: str = "ok") -> DataFrame:
    """(key, lines): one row per document with its (ln, t) in line order; no shuffle if ``lines`` lie by ``key``."""
    return lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ln", "t"))).alias("lines"))


def eligible_documents(docs: DataFrame, n: int = MIN_LINES, key: str = "ok", code: str = "code") -> DataFrame:
    """``document_lines`` of ``eligible_lines`` without a row per line: texts are brought together by ``key`` and cut into lines there.

    A key that repeats holds the lines of all its texts of ``n`` lines or more; no shuffle if ``docs`` lie by ``key``.
    """
    whole = F.filter(F.transform(F.collect_list(code), lambda c: F.split(c, "\n", -1)), lambda a: F.size(a) >= n)
    numbered = F.transform(whole, lambda a: F.transform(a, lambda t, i: F.struct((i + 1).cast("bigint").alias("ln"), t.alias("t"))))
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.flatten(numbered)).alias("lines")).where(F.size("lines") > 0)


def lines_of_documents(docs: DataFrame, key: str = "ok") -> DataFrame:
    """(key, ln, t) from ``document_lines``."""
    return docs.select(key, F.explode("lines").alias("l")).select(key, "l.ln", "l.t")


def path_seeds(n_paths: int = PATHS_PER_DOC, seed_base: int = SEED_BASE, key: str = "ok") -> Column:
    """B1 within a document row: (path_id, seed) per path."""
    seed = lambda p: (F.lit(seed_base) + F.col(key) * 1000 + p).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(n_paths - 1)), lambda p: F.struct(p.alias("path_id"), seed(p).alias("seed")))


def first_header() -> Column:
    """The number of the first header line within a document row, null without one."""
    headers = F.filter("lines", lambda x: F.regexp_like(x["t"], F.lit(HEADER_RE)))
    return F.array_min(headers.getField("ln")).cast("bigint")


def _paired(lines: Column, steps: Column) -> Column:
    """(ln, t, step) in line order of a path's ``lines`` (ln, t) and ``steps`` (ln, step), joined by ln."""
    row = lambda l, s: F.struct(l["ln"].alias("ln"), l["t"].alias("t"), s["step"].alias("step"))
    ln = lines.getField("ln")
    alike = (ln == steps.getField("ln")) & (F.size(F.array_distinct(ln)) == F.size(ln))
    pairs = F.flatten(F.transform(steps, lambda s: F.transform(F.filter(lines, lambda l: l["ln"] == s["ln"]), lambda l: row(l, s))))
    return F.when(alike, F.zip_with(lines, steps, row)).otherwise(F.sort_array(pairs))


def path_rows(documents: DataFrame, key: str = "ok") -> DataFrame:
    """(key, path_id, total_steps, lines): one row per path of built documents, lines as (ln, t, step); further columns of a document go with each path."""
    kept = [c for c in documents.columns if c not in (key, "lines", "paths")]
    p = documents.select(key, "lines", F.explode("paths").alias("p"), *kept)
    steps = F.zip_with("lines", "p.step", lambda l, s: F.struct(l["ln"].alias("ln"), s.alias("step")))
    return p.select(key, "p.path_id", "p.total_steps", _paired(F.col("lines"), steps).alias("lines"), *kept)


def whole_paths(steps: DataFrame, lines: DataFrame, key: str = "ok") -> DataFrame:
    """``path_rows`` of ``steps`` (key, path_id, ln, step, total_steps) and ``lines`` (key, ln, t), as any source gives them."""
    s = steps.repartition(key).groupBy(key, "path_id").agg(F.max("total_steps").alias("total_steps"), F.sort_array(F.collect_list(F.struct("ln", "step"))).alias("steps"))
    # Files of steps and lines are far smaller than their rows: neither is to be broadcast.
    joined = s.join(document_lines(lines, key).hint("merge"), key)
    return joined.select(key, "path_id", "total_steps", _paired(F.col("lines"), F.col("steps")).alias("lines")).where(F.size("lines") > 0)


def step_rows(documents: DataFrame, key: str = "ok") -> DataFrame:
    """(key, path_id, ln, removal, step, total_steps) of built documents, one row per line and path."""
    p = documents.select(key, F.col("lines.ln").alias("ln"), F.explode("paths").alias("p"))
    return (p.select(key, "p.path_id", "p.total_steps", F.explode(F.arrays_zip("ln", F.col("p.removal").alias("removal"), F.col("p.step").alias("step"))).alias("s"))
            .select(key, "path_id", "s.ln", "s.removal", "s.step", "total_steps"))


def with_steps(documents: DataFrame, step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Built documents with other steps: ``step`` of a line's number, its step and its path's total_steps."""
    changed = lambda p: F.zip_with("lines", p["step"], lambda l, s: step(l["ln"], s, p["total_steps"]))
    return documents.withColumn("paths", F.transform("paths", lambda p: p.withField("step", changed(p))))


def steps_from_removal(removal: DataFrame, key: str = "ok") -> DataFrame:
    """(key, path_id, ln, removal) -> + step (turn at which the line goes) and total_steps."""
    w = Window.partitionBy(key, "path_id").orderBy("removal")
    return (removal.withColumn("step", F.dense_rank().over(w).cast("bigint"))
            .withColumn("total_steps", F.max("step").over(Window.partitionBy(key, "path_id"))))


def capped(steps: DataFrame, cap: int | None = None) -> DataFrame:
    """``m = min(total_steps, cap)`` recorded transitions per path; without a cap all of them.

    The reference's setting is ``MAX_DELETIONS``.
    """
    m = F.col("total_steps") if cap is None else F.least(F.col("total_steps"), F.lit(cap))
    return steps.withColumn("m", m.cast("bigint"))


def _text(lines: Column) -> Column:
    return F.array_join(lines.getField("t"), "\n")


def _left(state: Column) -> Column:
    """The text of a state: lines with step > state."""
    return _text(F.filter("lines", lambda x: x["step"] > state))


def path_summary(steps: DataFrame, lines: DataFrame, cap: int | None = None,
                 key: str = "ok") -> DataFrame:
    """(key, path_id, total_steps, initial_code, final_code) per path.

    ``final_code`` is ``""`` when the path reached the empty text, else the
    state after ``cap`` deletions.
    """
    return row_summary(whole_paths(steps, lines, key), cap, key)


def row_summary(rows: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``path_summary`` of rows as ``path_rows`` has them."""
    return capped(rows, cap).select(key, "path_id", F.col("m").alias("total_steps"), *(c.alias(n) for n, c in summary_columns().items()))


def summary_columns() -> dict[str, Column]:
    """The texts of ``path_summary`` in the row of a path with ``lines`` and ``m``."""
    return {"initial_code": _text(F.col("lines")), "final_code": _left(F.col("m"))}


def snapshots(steps: DataFrame, lines: DataFrame, cap: int | None = None,
              key: str = "ok") -> DataFrame:
    """(key, path_id, state, code) for states 0..m; state k = lines with step > k."""
    return row_snapshots(whole_paths(steps, lines, key), cap, key)


def row_snapshots(rows: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``snapshots`` of rows as ``path_rows`` has them."""
    states = capped(rows, cap).select(key, "path_id", "lines", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("state"))
    return states.select(key, "path_id", "state", _left(F.col("state")).alias("code"))


def row_states(rows: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``row_snapshots`` with ``prev``, the text of the state before (null for state 0)."""
    states = capped(rows, cap).select(key, "path_id", "lines", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("state"))
    return states.select(key, "path_id", "state", F.when(F.col("state") > 0, _left(F.col("state") - 1)).alias("prev"), _left(F.col("state")).alias("code"))


def row_pairs(rows: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """(key, path_id, state, prev, curr) for states 0..m-1: the state's text behind that of the next one."""
    states = capped(rows, cap).where("m > 0").select(key, "path_id", "m", "lines", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("state"))
    return states.select(key, "path_id", "m", "state", _left(F.col("state") + 1).alias("prev"), _left(F.col("state")).alias("curr"))


def path_object(p: Column, cap: int | None = None) -> Column:
    """A path of a built document as its row says it: path_id, initial_code, final_code, valid_snapshots, total_steps."""
    steps = F.zip_with("lines", p["step"], lambda l, s: F.struct(l["ln"].alias("ln"), s.alias("step")))
    m = p["total_steps"] if cap is None else F.least(p["total_steps"], F.lit(cap).cast("bigint"))
    left = lambda x, state: _text(F.filter(x, lambda l: l["step"] > state))
    # Inside the function the lines are a variable: they are worked out once.
    return F.element_at(F.transform(F.array(_paired(F.col("lines"), steps)), lambda x: F.struct(
        p["path_id"].alias("path_id"), _text(x).alias("initial_code"), left(x, m).alias("final_code"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), m), lambda k: left(x, k)).alias("valid_snapshots"), m.alias("total_steps"))), 1)


def path_lengths(steps: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """total_steps per path."""
    return capped(steps, cap).groupBy(key, "path_id").agg(F.max("m").alias("total_steps"))


def path_diversity(steps: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """Per document, 'steps_differ' / 'states_differ' / 'identical' over its paths' recorded states.

    A path's states are fingerprinted by md5 of its line->step list (steps
    past the last recorded state are one), so no snapshot arrays are compared.
    """
    shown = F.least(F.col("step"), F.col("m") + 1)
    fp = capped(steps, cap).withColumn("shown", shown).groupBy(key, "path_id").agg(
        F.max("m").alias("total_steps"),
        F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("ln", "shown"))).getField("shown"), ",")).alias("fp"))
    return fp.groupBy(key).agg(
        F.when(F.count_distinct("total_steps") > 1, F.lit("steps_differ"))
        .when(F.count_distinct("fp") > 1, F.lit("states_differ"))
        .otherwise(F.lit("identical")).alias("verdict"))


def document_diversity(documents: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``path_diversity`` of built documents."""
    m = lambda p: p["total_steps"] if cap is None else F.least(p["total_steps"], F.lit(cap).cast("bigint"))
    shown = lambda p: F.sort_array(F.zip_with("lines", p["step"], lambda l, s: F.struct(l["ln"].alias("ln"), F.least(s, m(p) + 1).alias("shown")))).getField("shown")
    many = lambda of: F.size(F.array_distinct(F.transform("paths", of))) > 1
    verdict = F.when(many(m), F.lit("steps_differ")).when(many(lambda p: F.md5(F.array_join(shown(p), ","))), F.lit("states_differ")).otherwise(F.lit("identical"))
    return documents.select(key, verdict.alias("verdict"))
