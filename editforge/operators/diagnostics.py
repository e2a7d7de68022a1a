"""Checker diagnostics: L1 error lines, L2 fallback, L6 error context.

Log lines are rows ``(doc, pos, t)``. The look-ahead of L1 (an ``Error:``
header takes the first ``--> file:L:C:`` among the next 4 lines) is a window
frame ``rows between 1 following and 4 following``. The window runs per
``(doc, block of positions)``; the first 4 rows of each block are copied into
the previous block as look-ahead halo, so a log with a very large number of
lines is split over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values ------------------------------------------------------------------
HEADER_PREFIX = "Error:"
LOCATION_RE = "^--> \\S+:(\\d+):\\d+:"
INLINE_RE = ":(\\d+):\\d+: Error:"
LOOKAHEAD = 4
CONTEXT = 3
FALLBACK_LINES = 10
# -------------------------------------------------------------------------------------


def _num(pattern: str, c):
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("bigint")


def error_lines(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """L1: (doc, pos, kind, line_no) per error found; ``line_no`` is null for a header
    without a location in the look-ahead (see L2). ``kind`` is ``header`` or ``inline``."""
    s = log.select("doc", "pos", T.strip_ws(F.col("t")).alias("s"))
    s = s.select("doc", "pos", F.col("s").startswith(HEADER_PREFIX).alias("hdr"),
                 _num(LOCATION_RE, F.col("s")).alias("loc"), _num(INLINE_RE, F.col("s")).alias("inl"),
                 F.floor((F.col("pos") - 1) / block).cast("bigint").alias("blk"))
    halo = s.where(((F.col("pos") - 1) % block) < LOOKAHEAD).withColumn("blk", F.col("blk") - 1) \
        .withColumn("own", F.lit(False))
    rows = s.withColumn("own", F.lit(True)).unionByName(halo)
    w = Window.partitionBy("doc", "blk").orderBy("pos").rowsBetween(1, LOOKAHEAD)
    rows = rows.withColumn("ahead", F.first("loc", ignorenulls=True).over(w)).where("own")
    return rows.where(F.col("hdr") | F.col("inl").isNotNull()).select(
        "doc", "pos", F.when(F.col("hdr"), F.lit("header")).otherwise(F.lit("inline")).alias("kind"),
        F.when(F.col("hdr"), F.col("ahead")).otherwise(F.col("inl")).alias("line_no"))


def error_line_fallback(errors: DataFrame, line_counts: DataFrame) -> DataFrame:
    """L2: distinct (doc, line_no); an error without a location gets a deterministic
    pseudo-random line in ``1..n`` (n = lines of the doc's code; none when n = 0)."""
    e = errors.join(line_counts, "doc", "left")
    pick = T.hash_pick(F.concat_ws(":", F.col("doc"), F.col("pos")), F.col("n_lines"))
    ln = F.when(F.col("line_no").isNotNull(), F.col("line_no")) \
        .when(F.col("n_lines") > 0, pick)
    return e.select("doc", ln.alias("line_no")).where(F.col("line_no").isNotNull()).distinct()


def error_context(lines: DataFrame, errors: DataFrame, context: int = CONTEXT,
                  fallback: int = FALLBACK_LINES) -> DataFrame:
    """(doc, ln, marker, t): lines within ``context`` of an error line, ``>>``
    on error lines; the first ``fallback`` lines when no error line is in range."""
    e = errors.select("doc", F.col("line_no").alias("ln"), F.lit(1).alias("is_err")).distinct()
    x = lines.join(e, ["doc", "ln"], "left").withColumn("is_err", F.coalesce("is_err", F.lit(0)))
    w = Window.partitionBy("doc").orderBy("ln")
    x = (x.withColumn("near", F.max("is_err").over(w.rangeBetween(-context, context)))
         .withColumn("any_err", F.max("is_err").over(Window.partitionBy("doc"))))
    shown = (F.col("near") == 1) | ((F.col("any_err") == 0) & (F.col("ln") <= fallback))
    return x.where(shown).select("doc", "ln", F.when(F.col("is_err") == 1, F.lit(">>")).otherwise(F.lit("  "))
                                 .alias("marker"), "t")
