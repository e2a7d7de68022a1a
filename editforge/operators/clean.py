"""Merge and clean stages: S2, P1, P2, P7, P8/P9 keys, F1, D1-D3, A1, A2.

Records are JSON objects with an open schema; fields are read from a VARIANT
(``try_parse_json``), so no schema is imposed and unknown fields pass through
in ``raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def parse_records(scan: DataFrame) -> DataFrame:
    """Add ``v`` (VARIANT or null) and ``status`` in blank / bad_json / not_object / ok."""
    v = F.try_parse_json("raw")
    stripped = T.strip_ws(F.col("raw"))
    status = (F.when(stripped == "", F.lit("blank"))
              .when(F.col("v").isNull(), F.lit("bad_json"))
              .when(~stripped.startswith("{"), F.lit("not_object"))
              .otherwise(F.lit("ok")))
    return scan.withColumn("v", v).withColumn("status", status)


def bad_record_route(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects). Blank lines are neither. Rejects keep (file_ord, line_no, reason)."""
    p = parse_records(scan)
    good = p.where(F.col("status") == "ok").drop("status")
    rejects = p.where(F.col("status").isin("bad_json", "not_object")).select(
        "file_ord", "line_no", F.col("status").alias("reason"))
    return good, rejects


#: Lines of a file come before those of the next one in one numbering.
PLACE = 1 << 40


def reject_examples(rejects: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rejects as ``file:line`` (a report: the limit is the feature)."""
    return (rejects.orderBy("file_ord", "line_no").limit(n)
            .select(F.concat_ws(":", "file_ord", "line_no").alias("loc")))


def with_fields(good: DataFrame, names=("contract_address", "func_name", "file_path", "class_code",
                                        "func_code", "contract")) -> DataFrame:
    return good.select("*", *[field(F.col("v"), n).alias(n) for n in names])


def merge_key_of(df: DataFrame) -> Column:
    """P9 read from the VARIANT of parsed records."""
    v = F.col("v")
    return T.stable_key(field(v, "contract_address"), field(v, "func_name"), field(v, "file_path"),
                        T.falsy_coalesce(field(v, "class_code"), field(v, "func_code")))


def merge_key(df: DataFrame) -> DataFrame:
    """P9 on parsed records (class_code, then func_code for the hash)."""
    return df.withColumn("key", T.stable_key(F.col("contract_address"), F.col("func_name"), F.col("file_path"),
                                             T.falsy_coalesce(F.col("class_code"), F.col("func_code"))))


def merge_keep(df: DataFrame, keep: str = "first") -> DataFrame:
    """One row per ``key``, first (or last) in ``(file_ord, line_no)`` order.

    A partial aggregate (``min_by``/``max_by`` of the whole record) before the
    shuffle: a key holding a large share of rows is reduced map-side.
    """
    cols = [c for c in df.columns if c != "key"]
    rec = F.struct(*cols)
    order = F.struct("file_ord", "line_no")
    pick = F.min_by(rec, order) if keep == "first" else F.max_by(rec, order)
    return df.groupBy("key").agg(pick.alias("r")).select("key", "r.*")


def code_field(df: DataFrame) -> Column:
    """P1 (clean stage): ``class_code or contract or ""``."""
    return T.falsy_coalesce(F.col("class_code"), F.col("contract"))


def version_field(v: Column) -> Column:
    """``compiler_version or original_meta.version or version or ""``."""
    return T.falsy_coalesce(field(v, "compiler_version"), field(v, "original_meta.version"), field(v, "version"))


def clean_code(df: DataFrame, code: str, raw_ver: str, out: str = "contract", compat: bool = False) -> DataFrame:
    """P4 -> P5 -> P6 into column ``out`` (empty stays empty).

    The cleaned body gets its own projection: it is referenced several times
    inside CASE branches, where code generation would evaluate it again.
    """
    d = df.withColumn("_body", T.strip_comments(F.col(code), compat))
    d = d.withColumn("_body", T.normalise_lines(F.col("_body")))
    d = d.withColumn(out, F.when(F.col("_body") == "", F.lit("")).otherwise(
        T.ensure_header(F.col("_body"), T.extract_version(F.col(raw_ver)))))
    return d.drop("_body")


def clean_records(merged: DataFrame) -> DataFrame:
    """F1 + P1-P6 on merged records: (file_ord, line_no, contract, reason)."""
    code = code_field(merged)
    c = merged.select("file_ord", "line_no", code.alias("code"), version_field(F.col("v")).alias("raw_ver"))
    c = clean_code(c, "code", "raw_ver")
    return c.select("file_ord", "line_no", "contract",
                    F.when(F.col("code") == "", F.lit("no_code"))
                    .when(F.col("contract") == "", F.lit("empty_after_clean"))
                    .otherwise(F.lit("ok")).alias("reason"))


def content_dedup(cleaned: DataFrame) -> DataFrame:
    """D3 (+P7): one row per exact cleaned text, first in input order -> (contract, file_ord, line_no).

    Grouping on the text itself (not a 64-bit hash) so distinct texts never
    collide. The place is one number (files below 2^23, lines below 2^40), so a
    hash aggregate drops copies before the shuffle, without sorting texts.
    """
    place = F.col("file_ord").cast("bigint") * PLACE + F.col("line_no")
    return (cleaned.groupBy("contract").agg(F.min(F.when(F.col("reason") == "ok", place)).alias("first")).where(F.col("first").isNotNull())
            .select("contract", F.expr(f"first div {PLACE}").alias("file_ord"), (F.col("first") % PLACE).alias("line_no")))


def merge_report(parsed: DataFrame, merged_count_col: str = "key") -> DataFrame:
    """A1: files, lines, records_in, bad_json, not_object, records_out, dups in one pass."""
    st = F.col("status")
    return parsed.agg(
        F.count_distinct("file_ord").alias("files"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(st == "ok").alias("records_in"),
        F.count_if(st == "bad_json").alias("bad_json"),
        F.count_if(st == "not_object").alias("not_object"),
        F.count_distinct(F.when(st == "ok", F.col(merged_count_col))).alias("records_out"),
    ).withColumn("dups", F.col("records_in") - F.col("records_out"))


def clean_report(cleaned: DataFrame) -> DataFrame:
    """A2: kept, duplicates, rejected (no code or empty after cleaning), in one aggregate."""
    ok = F.col("reason") == "ok"
    return cleaned.agg(F.count_distinct(F.when(ok, F.col("contract"))).alias("kept"),
                       F.count_if(ok).alias("n_ok"),
                       F.count_if(~ok).alias("rejected")) \
        .select("kept", (F.col("n_ok") - F.col("kept")).alias("duplicates"), "rejected")
