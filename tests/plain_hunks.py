"""The plain form of E1: every line with every state that holds it. Quadratic; a check for the operator."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from editforge.operators.diff import CONTEXT, _ordered_join
from editforge.operators.paths import capped


def _range(start0, length):
    return (F.when(length == 1, (start0 + 1).cast("string"))
            .when(length == 0, F.concat(start0.cast("string"), F.lit(",0")))
            .otherwise(F.concat((start0 + 1).cast("string"), F.lit(","), length.cast("string"))))


def plain_diff_hunks(steps, lines, cap=None, key="ok",
               context=CONTEXT, compat=False):
    """(key, path_id, fwd, diff) with one unified-diff text per forward step.

    ``compat=True`` also drops added lines that start with ``++`` (the reference
    filters every diff line starting ``+++``/``---`` to remove file headers).
    """
    s = capped(steps, cap).where(F.col("m") >= 1)
    x = s.select(key, "path_id", "ln", "step", "m",
                 F.explode(F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("m") - F.col("step") + 1),
                                      F.col("m"))).alias("fwd"))
    x = x.withColumn("added", (F.col("step") == F.col("m") - F.col("fwd") + 1).cast("int"))
    # Every frame below shares partition (key, path_id, fwd) and order ln: one sort serves all.
    w = Window.partitionBy(key, "path_id", "fwd").orderBy("ln")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    x = (x.withColumn("pos", F.row_number().over(w))
         .withColumn("near", F.max("added").over(w.rowsBetween(-context, context)))
         .withColumn("added_before", F.coalesce(F.sum("added").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0)))
         .withColumn("added_from", F.sum("added").over(ahead))
         .withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(key, "path_id", "fwd"))))
    gap = F.col("near") == 0
    x = (x.withColumn("start", (F.col("near") == 1) & (F.lag("near", 1, 0).over(w) == 0))
         .withColumn("next_gap", F.min(F.when(gap, F.col("pos"))).over(ahead))
         # suffix sums never grow along ln, so the first gap row ahead holds the largest one
         .withColumn("added_after_hunk", F.max(F.when(gap, F.col("added_from"))).over(ahead)))
    # Header fields, known on the first row of each hunk (difflib range format).
    n_new = F.coalesce(F.col("next_gap") - 1, F.col("n_rows")) - F.col("pos") + 1
    n_add = F.col("added_from") - F.coalesce(F.col("added_after_hunk"), F.lit(0))
    i1 = F.col("pos") - 1 - F.col("added_before")
    header = F.concat(F.lit("@@ -"), _range(i1, n_new - n_add), F.lit(" +"), _range(F.col("pos") - 1, n_new),
                      F.lit(" @@\n"))
    shown = x.where(F.col("near") == 1).select(
        key, "path_id", "fwd", "ln", "pos", "added", F.when(F.col("start"), header).otherwise(F.lit("")).alias("hdr"))
    shown = shown.join(lines.select(key, "ln", "t"), [key, "ln"])
    keep = ~((F.col("added") == 1) & F.col("t").startswith("++")) if compat else F.lit(True)
    body = F.concat(F.when(F.col("added") == 1, F.lit("+")).otherwise(F.lit(" ")), F.col("t"))
    # compat drops the line but keeps its hunk's header (collect_list skips the nulls)
    text = (F.when(keep, F.concat(F.col("hdr"), body))
            .when(F.col("hdr") != "", F.regexp_replace("hdr", "\n\\z", "")))
    item = F.when(text.isNotNull(), F.struct(F.col("pos").alias("k"), text.alias("v")))
    return shown.groupBy(key, "path_id", "fwd").agg(_ordered_join(F.collect_list(item), "\n").alias("diff"))
