"""Ordered row numbers without a window over a whole (possibly hot) group.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends every row of a group to
one task. When one group can hold a large share of all rows (a shard, a
source, a user), we number inside fixed-width blocks of the ordering key
instead, then add the running count of the earlier blocks of the same group.
The per-block counts table has at most ``groups x target_blocks`` rows, and
its window is per group over at most ``target_blocks`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                     block_key: Column, out: str = "row_no",
                     target_blocks: int = 1024) -> DataFrame:
    """Add ``out`` = 1-based row number inside ``group_cols`` ordered by ``order_cols``.

    ``block_key`` must be a numeric expression that never decreases along
    ``order_cols``; the order must be total (unique) inside a group.
    """
    df = df.withColumn("_bk", block_key.cast("bigint"))
    lo, hi = df.agg(F.min("_bk"), F.max("_bk")).first()
    if lo is None:
        return df.drop("_bk").withColumn(out, F.lit(None).cast("bigint"))
    width = max(1, -(-(hi - lo + 1) // target_blocks))
    df = df.withColumn("_blk", F.floor((F.col("_bk") - F.lit(lo)) / F.lit(width)).cast("bigint"))
    gb = [*group_cols, "_blk"]
    inner = Window.partitionBy(*gb).orderBy(*order_cols)
    local = df.withColumn("_rn", F.row_number().over(inner).cast("bigint"))
    counts = df.groupBy(*gb).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*gb, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, on=gb, how="inner")
            .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
            .drop("_bk", "_blk", "_rn", "_off"))


#: Rows that one task is to sort; fewer where a small input would leave cores without work.
TASK_ROWS, LEAST_ROWS = 1 << 16, 1 << 13


def tasks_for(df: DataFrame, n_rows: int, task_rows: int = TASK_ROWS) -> int:
    """Partitions for ``n_rows`` rows, so that the memory of one task does not grow with the input.

    Shuffles of narrow, well compressed rows are otherwise merged by their size on
    disk, and what a task sorts grows up to many times that size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n_rows // task_rows), min(cores, -(-n_rows // LEAST_ROWS)))
