"""Whole-corpus plans: deletion paths and edit sequences over a lines table.

``build_paths`` is the bulk form of the reference's per-contract sampler: F2 ->
B1 -> B2 -> B3 -> B4 -> steps. Everything downstream (snapshots, diffs, edit
records, reports) is a function of its ``steps`` table (key, path_id, ln,
removal, step, total_steps) plus the lines text.

Both are kept as one row per document (``documents``), with its lines and the steps of
all its paths: they are shuffled once, by document, and what is made of a path is made in its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbering import tasks_for
from ..operators import deps as D
from ..operators import diff as E
from ..operators import errors as X
from ..operators import paths as P
from ..operators import repair as R
from ..session import checkpoint_dir, materialize

#: Lines of documents that one task is to hold.
TASK_LINES = 1 << 18


@dataclass
class PathBuild:
    lines: DataFrame        # (key, ln, t) of documents passing F2
    docs: DataFrame         # (key, n_lines)
    paths: DataFrame        # (key, path_id, seed)
    ranks: DataFrame        # (key, path_id, ln, rank)
    edges: DataFrame        # (key, ln, req)
    steps: DataFrame        # (key, path_id, ln, removal, step, total_steps)
    cap: int | None         # most recorded transitions of a path; None: all
    key: str
    documents: DataFrame    # (key, lines (ln, t), paths (path_id, total_steps, removal, step)), written

    @property
    def rows(self) -> DataFrame:
        """(key, path_id, total_steps, lines (ln, t, step)): one row per path."""
        return P.path_rows(self.documents, self.key)


def build_paths(lines: DataFrame, cap: int | None = None, n_paths: int = P.PATHS_PER_DOC,
                min_lines: int | None = P.MIN_LINES, key: str = "ok",
                rule: Callable[[DataFrame, str], DataFrame] = D.line_dependencies,
                compat: bool = False, max_passes: int | None = R.MAX_PASSES) -> PathBuild:
    """``lines`` (key, ln, t), or one row per document (key, lines) as ``paths.document_lines`` and ``paths.eligible_documents``
    give them; pass ``min_lines=None`` when F2 was applied already (``paths.eligible_lines``, ``paths.eligible_documents``),
    which avoids an aggregate and a semi-join.

    ``rule`` is the checker (B3): any function of (lines, key) that returns the
    requirements (key, ln, req). ``compat`` follows the sequential loop turn by turn: protection
    passes from a lost header to the next, and repair after a deletion ends after ``max_passes`` passes."""
    checkpoint_dir(lines.sparkSession)
    whole = "lines" in lines.columns
    if min_lines is not None and whole:
        lines = lines.where(F.size("lines") >= min_lines)
    elif min_lines is not None:
        docs = P.min_lines(lines, min_lines, key)
        lines = lines.join(docs.select(key), key, "left_semi")
    repair = (lambda d: R.document_turns(d, max_passes, key)) if compat else (lambda d: D.document_repair(d, key))
    paths_of = [P.path_seeds(n_paths, key=key).alias("seeds"), P.first_header().alias("header")]
    # The rule of the library is worked out in the document's row; a rule of one's own may be any plan, unions too.
    own = rule is not D.line_dependencies
    kept = lines if whole else P.document_lines(lines, key)
    kept = materialize(kept if own else repair(kept.select(key, "lines", *paths_of)))
    # One shuffle by document, over tasks of a bounded number of lines; with a rule of one's own, its edges are written.
    n_lines = kept.agg(F.sum(F.size("lines.ln"))).first()[0] or 0
    spread = kept.select(key, "lines").where(F.col(key).isNotNull() & F.col("lines").isNotNull() & (F.size("lines") > 0)).repartition(tasks_for(kept, n_lines, TASK_LINES), key)
    texts = P.lines_of_documents(spread, key)
    edges = materialize(rule(texts, key), "edges") if own else rule(texts, key)
    built = materialize(repair(spread.join(D.document_edges(edges, key).hint("merge"), key, "left").select(key, "lines", *paths_of, "edges"))) if own else kept
    docs = built.select(key, F.size("lines").cast("bigint").alias("n_lines"))
    paths = P.path_fanout(docs, n_paths, key=key)
    ranks = P.deletion_order(texts, paths, key)
    return PathBuild(P.lines_of_documents(built, key), docs, paths, ranks, edges, P.step_rows(built, key), cap, key, built)


def _seeded(documents: DataFrame, n_paths: int, key: str) -> DataFrame:
    kept = [c for c in documents.columns if c not in (key, "lines")]
    return documents.select(key, "lines", P.path_seeds(n_paths, key=key).alias("seeds"), P.first_header().alias("header"), *kept)


def path_documents(documents: DataFrame, n_paths: int = P.PATHS_PER_DOC, key: str = "ok") -> DataFrame:
    """The documents of ``build_paths`` (default rule, no ``compat``), not written: for a plan that reads them once.

    ``documents`` (key, lines) is as ``paths.document_lines`` gives it; further columns go with the document.
    """
    return D.document_repair(_seeded(documents, n_paths, key), key)


def records_once(documents: DataFrame, cap: int | None = None, n_paths: int = P.PATHS_PER_DOC, key: str = "ok", sep: str = E.JOIN_SEPARATOR, compat: bool = False) -> DataFrame:
    """``document_records`` of ``path_documents``, built and told in one pass over the documents."""
    kept = [c for c in documents.columns if c not in (key, "lines")]
    return E.row_records(E.document_sequences(_seeded(documents, n_paths, key), cap, key, compat=compat, sep=sep, build=(D.close_documents, ("seeds", "header"))), key, kept)


def edit_records(pb: PathBuild, sep: str = E.JOIN_SEPARATOR, compat: bool = False) -> DataFrame:
    """E1 -> E2 -> E4 (+F3, P14)."""
    return document_records(pb.documents, pb.cap, pb.key, sep, compat)


def document_records(documents: DataFrame, cap: int | None = None, key: str = "ok", sep: str = E.JOIN_SEPARATOR, compat: bool = False) -> DataFrame:
    """``edit_records`` of built documents; their further columns go with each record."""
    kept = [c for c in documents.columns if c not in (key, "lines", "paths")]
    return E.row_records(E.document_sequences(documents, cap, key, compat=compat, sep=sep), key, kept)


def status_route(all_docs: DataFrame, pb: PathBuild | None = None, key: str = "ok", n_paths: int = P.PATHS_PER_DOC) -> DataFrame:
    """one status per input document, precedence error -> empty -> short -> failed -> success.

    ``all_docs`` is (key, code) and, from the error channel, ``error``. ``n_paths`` counts the
    paths that ``pb`` holds; a document with some of its paths only is an error as well. Without ``pb`` every
    eligible document counts as having all its paths, as the default build makes them: no shuffle then.
    """
    docs = all_docs if "error" in all_docs.columns else all_docs.withColumn("error", F.lit(None).cast("string"))
    n_lines = T.line_count(F.col("code"))
    if pb is None:
        whole = F.col("error").isNull() & (F.col("code") != "") & (n_lines >= P.MIN_LINES)
        d = docs.withColumn("n_paths", F.when(whole, F.lit(n_paths)).otherwise(F.lit(0)).cast("bigint"))
    else:
        d = X.missing_paths(docs, pb.steps, F.lit(n_paths), key)
    status = (F.when(F.col("error").isNotNull(), F.lit("error"))
              .when(F.col("code") == "", F.lit("empty_code"))
              .when(n_lines < P.MIN_LINES, F.lit("skipped_too_short"))
              .when(F.col("n_paths") == 0, F.lit("failed_logic"))
              .otherwise(F.lit("success")))
    return d.select(key, status.alias("status"), "n_paths")
