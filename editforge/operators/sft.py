"""Instruction-tuning assembly: P15, F4, D5, G1-G3, S7, A3-A5, M1-M3, D4.

Text generation itself stays outside Spark: ``prompt_table`` writes one
prompt per contract, and ``responses`` (original_line_no, instruction) comes
back as an input table that is joined to every path of its contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

# --- fixed values (reference settings and prompt text) --------------------------------
PROMPT_CHARS = 4096
MIN_FINAL_CHARS = 20
SYSTEM_PROMPT = """You are an expert Smart Contract Auditor.
Analyze the provided Solidity code and generate a User Instruction.

REQUIREMENTS:
1. **Goal**: Briefly summarize what this function/contract does.
2. **Security**: Explicitly mention specific security patterns used in the code (e.g., "Use SafeMath", "Prevent reentrancy", "Check ownership").
3. **Format**: Output ONLY the instruction text.
"""
USER_PREFIX = "Code:\n```solidity\n"
USER_SUFFIX = "\n```\n\nInstruction:"
STATUSES = ["success", "skipped_too_short", "failed_logic", "empty_code", "error"]
# ---------------------------------------------------------------------------------------


def instruct_eligible(records: DataFrame) -> DataFrame:
    """rows with a line number and at least 20 characters of final code."""
    return records.where(F.col("original_line_no").isNotNull() & (F.length("final_code") >= MIN_FINAL_CHARS))


def instruction_once(records: DataFrame) -> DataFrame:
    """One representative row per contract (first path) -> (original_line_no, path_id, final_code)."""
    return (records.groupBy("original_line_no")
            .agg(F.min_by(F.struct("path_id", "final_code"), F.col("path_id")).alias("r"))
            .select("original_line_no", "r.path_id", "r.final_code"))


def prompt_messages(code: Column, system_prompt: str = SYSTEM_PROMPT, max_chars: int | None = None) -> Column:
    """The chat messages as a JSON array string.

    The whole code goes in; the reference cuts it at ``PROMPT_CHARS`` (``max_chars``).
    """
    shown = code if max_chars is None else F.substring(code, 1, max_chars)
    user = F.concat(F.lit(USER_PREFIX), shown, F.lit(USER_SUFFIX))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.to_json(msgs)


def prompt_table(records: DataFrame, max_chars: int | None = None) -> DataFrame:
    """P15 over D5: (original_line_no, messages) one prompt per contract."""
    once = instruction_once(instruct_eligible(records))
    return once.select("original_line_no", prompt_messages(F.col("final_code"), max_chars=max_chars).alias("messages"))


def attach_instruction(records: DataFrame, responses: DataFrame, key: str = "original_line_no") -> DataFrame:
    """G1: every eligible path gets its contract's (stripped) instruction; unmatched rows drop.

    ``records`` may be documents by ``key`` as well, which have no final code yet: then each document gets the instruction that
    all its records are to carry, and ``instruct_eligible`` is up to the records (``corpus.document_records``). So a join moves a document once
    at most, and not its edit sequences.
    """
    r = responses.select(F.col("original_line_no").alias(key), T.strip_ws(F.col("instruction")).alias("instruction"))
    rows = instruct_eligible(records) if "final_code" in records.columns else records
    # A planner that sees a file of keys takes the instructions for small: each is as long as its text.
    return rows.join(r.hint("merge"), key)


def sft_edit_set(sft: DataFrame) -> DataFrame:
    """{original_line_no, path_id, steps_count, instruction, input, output=edit_sequence}."""
    return sft.select("original_line_no", "path_id", "steps_count", "instruction", F.lit("").alias("input"),
                      F.col("edit_sequence").alias("output"))


def sft_control_set(sft: DataFrame) -> DataFrame:
    """{original_line_no, path_id, instruction, input, output=final_code}."""
    return sft.select("original_line_no", "path_id", "instruction", F.lit("").alias("input"),
                      F.col("final_code").alias("output"))


def dual_sink(sft: DataFrame, edit_path: str, control_path: str) -> DataFrame:
    """Two row-aligned JSONL outputs from one computation; returns the invariant row
    (n_edit, n_control, key_sym_diff) read back from what was written."""
    from ..sources import jsonl
    base = materialize(sft, "sft", "zstd")   # computed once, read by both sinks; a lost executor loses nothing
    # Both repeat a document's text and instruction for each path: as plain text they would be many times the input.
    jsonl.jsonl_write(sft_edit_set(base), edit_path, compression="gzip")
    jsonl.jsonl_write(sft_control_set(base), control_path, compression="gzip")
    spark = sft.sparkSession
    schema = "original_line_no bigint, path_id bigint"
    a = spark.read.schema(schema).json(edit_path).withColumn("_a", F.lit(1))
    b = spark.read.schema(schema).json(control_path).withColumn("_b", F.lit(1))
    j = a.join(b, ["original_line_no", "path_id"], "full_outer")
    return j.agg(F.count("_a").alias("n_edit"), F.count("_b").alias("n_control"),
                 F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("key_sym_diff"))


def instruct_report(records: DataFrame) -> DataFrame:
    """A5: unique contracts, generation calls (exactly once per contract), cache hits."""
    e = instruct_eligible(records)
    return e.agg(F.count_distinct("original_line_no").alias("unique_contracts"), F.count(F.lit(1)).alias("rows")) \
        .select("unique_contracts", F.col("unique_contracts").alias("calls"),
                (F.col("rows") - F.col("unique_contracts")).alias("cache_hits"))


def status_report(spark: SparkSession, statuses: DataFrame) -> DataFrame:
    """A3: documents and paths per status; every known status shows, zeros included."""
    agg = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_paths").alias("n_paths"))
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(agg, "status", "left").select(
        "status", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"),
        F.coalesce("n_paths", F.lit(0)).cast("bigint").alias("n_paths"))


def sample_exact(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """M1: exactly ``min(n, rows)`` rows without replacement, reproducible for a seed.

    ``orderBy(..).limit(n)`` plans as TakeOrderedAndProject: a per-partition
    top-n, never a full sort.
    """
    k = T.md5_order_key(F.lit(seed), *[F.col(c) for c in key])
    return df.orderBy(k, *key).limit(n)


def first_n_valid(df: DataFrame, n: int, *order: str) -> DataFrame:
    """M2: the first ``n`` rows (in input order) of an already filtered DataFrame."""
    return df.orderBy(*order).limit(n)


def first_n_contracts(df: DataFrame, n: int, order: list[str], contract: str = "original_line_no") -> DataFrame:
    """M3: rows before the first row of the (n+1)-th distinct contract, in ``order``.

    Later rows of already seen contracts are dropped too (the reference stops
    reading there). Spark's top-n finds the cut-off position, the one value
    that reaches the driver; with at most ``n`` contracts there is no cut.
    """
    df = materialize(df, "contracts")   # computed once, read for the cut-off and for the rows before it
    first = df.groupBy(contract).agg(F.min(F.struct(*order)).alias("p"))
    found = first.orderBy("p").limit(n + 1).agg(F.count("*").alias("n"), F.max("p").alias("cut")).first()
    if found["n"] <= n:
        return df
    lit = F.struct(*[F.lit(found["cut"][i]).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(order)])
    return df.where(F.struct(*order) < lit)


def differs(first: Column, prev: Column, value: Column) -> Column:
    """D4's test: a row stays if it is the first or its value is not that of the row before."""
    return first | ~prev.eqNullSafe(value)


def consecutive_dedup(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Drop a row whose ``value`` equals the previous row's within ``part``."""
    w = Window.partitionBy(*part).orderBy(order)
    return (df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_prev", F.lag(value).over(w))
            .where(differs(F.col("_first"), F.col("_prev"), F.col(value))).drop("_first", "_prev"))
