"""Error channel: what is wrong with a record stands in its ``error`` column (null: nothing).

Every stage may set it (``flag``); the first error of a record holds. Records
in error take no part in later stages, but reach the status and the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from . import clean as K

#: Reasons: a line that is no JSON, a JSON value that is no object, a code field that is no text, a record without the paths it should have.
REASONS = ["bad_json", "not_object", "not_text", "missing_path"]


def flag(df: DataFrame, condition: Column, reason: str) -> DataFrame:
    """Set ``error`` where ``condition`` holds and no error stands yet; a null condition does not hold."""
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.coalesce(before, F.when(condition, F.lit(reason))))


def read_code(scan: DataFrame, name: str = "contract") -> DataFrame:
    """JSONL lines (``raw``) with ``code`` (stripped) and ``error``; blank lines are no records and go.

    A missing field is the empty code; a field that holds anything but text, null
    included, is an error. Of records in error the code is null.
    """
    p = K.parse_records(scan).where("status <> 'blank'")
    p = flag(p.drop("error"), F.col("status") == "bad_json", "bad_json")
    p = flag(p, F.col("status") == "not_object", "not_object")
    p = flag(p, F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{name}", "variant")) != "STRING", "not_text")
    code = F.when(F.col("error").isNull(), F.coalesce(T.strip_ws(K.field(F.col("v"), name)), F.lit("")))
    return p.withColumn("code", code).drop("v", "status")


def counted_write(df: DataFrame, path: str, name: str = "errors") -> dict[str, int]:
    """Write ``df`` as Parquet; rows and errors by reason are counted by the same job.

    The counts are observed metrics of that job: no second pass over the data.
    A stage that runs again after a lost executor may be counted twice; the written
    table is the authority.
    """
    seen = Observation(name)
    counts = [F.count_if(F.col("error") == r).alias(r) for r in REASONS]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"), *counts).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def missing_paths(docs: DataFrame, steps: DataFrame, expected: Column, key: str = "ok") -> DataFrame:
    """``docs`` with ``n_paths`` (produced) and the error ``missing_path`` where some, but not all ``expected`` ones were made.

    A document without any path is no error but failed repair (status ``failed_logic``).
    """
    made = steps.groupBy(key, "path_id").agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("*").alias("n_paths"))
    d = docs.join(made, key, "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)).cast("bigint"))
    return flag(d, (F.col("n_paths") > 0) & (F.col("n_paths") < expected), "missing_path")


def diff_report(docs: DataFrame, steps: DataFrame, records: DataFrame, key: str = "ok") -> DataFrame:
    """A4: total (paths and documents in error), processed (records), skipped (paths without one), errors."""
    paths = steps.groupBy(key, "path_id").agg(F.lit(1).alias("_path"))
    done = records.select(F.col("original_line_no").alias(key), "path_id", F.lit(1).alias("_done"))
    counted = paths.join(done, [key, "path_id"], "left").agg(F.count("*").alias("paths"), F.count("_done").alias("processed"))
    errors = docs.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return counted.join(F.broadcast(errors)).select(   # one row each
        (F.col("paths") + F.col("errors")).alias("total"), "processed", (F.col("paths") - F.col("processed")).alias("skipped"), "errors")
