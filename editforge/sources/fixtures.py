"""Fixture views derived from the driver's tables (Spark spelling).

Each view has a twin in ``plans/oracle.py`` (DuckDB spelling) built from the
same column expressions, so that every query can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbering import block_row_number, tasks_for
from ..session import materialize
from .tables import table

# --- fixed values: the fixture definitions ----------------------------------
PRAGMA_EXPRS = ["^0.4.3", "0.4.11", ">=0.4.2 <0.6.0", ">=0.4.0", "<=0.5.3",
                "~0.4.1", "=0.4.9", ">= 0.4.5", "^9.9.9", None,
                "^0.4", "^0", "^0.4.3-nightly", "^ 0.4.3", "0.4.*", ">=0.4.22 <0.9.0"]   # by c_custkey % 16
CATALOGUE = [(0, 4, 26), (0, 5, 17), (0, 6, 12)]                  # (major, minor, last patch)
# -----------------------------------------------------------------------------


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, line_no, contract_address, func_name, file_path, class_code)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    m4 = F.col("doc_id") % 4
    d = d.select(
        (F.col("doc_id") % 3).alias("file_ord"), "doc_id",
        F.when(m4 < 2, F.concat(F.lit("0x"), F.substring(F.md5("text"), 1, 8))).alias("contract_address"),
        F.when(m4.isin(0, 2), F.concat(F.lit("f_"), F.col("lang"))).alias("func_name"),
        F.when(m4 >= 2, F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.expr("doc_id div 64").cast("string"),
                                 F.lit(".sol"))).alias("file_path"),
        F.col("text").alias("class_code"))
    d = block_row_number(d, ["file_ord"], ["doc_id"], F.col("doc_id"), out="line_no")
    return d.select("file_ord", "line_no", "doc_id", "contract_address", "func_name",
                    "file_path", "class_code")


def record_json(df: DataFrame) -> DataFrame:
    """Add ``json``: the record as one JSON object (fixed key order, nulls kept)."""
    fields = ["contract_address", "func_name", "file_path", "class_code"]
    parts = []
    for i, f in enumerate(fields):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{f}":'), T.json_quote(F.col(f))]
    return df.withColumn("json", F.concat(*parts, F.lit("}")))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, line_no, raw): JSONL text lines. Every record has its line; behind some stand
    a blank line, the record cut in half, and the record under other field names."""
    r = record_json(raw_records(spark, sf_dir))
    other = F.concat(F.lit('{"func_code":'), T.json_quote(F.col("class_code")), F.lit(',"contract":'), T.json_quote(F.concat(F.lit("C"), F.col("doc_id").cast("string"))),
                     F.lit(',"class_code":"","original_meta":{"version":"v0.5.'), (F.col("doc_id") % 10).cast("string"), F.lit('"}}'))
    some = F.array(F.col("json"), F.when(F.col("doc_id") % 77 == 0, F.lit("")),
                   F.when(F.col("doc_id") % 50 == 0, F.expr("substring(json, 1, length(json) div 2)")),
                   F.when(F.col("doc_id") % 40 == 0, other),
                   F.when(F.col("doc_id") % 90 == 0, F.lit('{"class_code":"// a comment","version":"0.6.1"}')))
    rows = r.select("file_ord", "doc_id", F.posexplode(some).alias("k", "raw")).where(F.col("raw").isNotNull())
    numbered = block_row_number(rows, ["file_ord"], ["doc_id", "k"], F.col("doc_id"), out="line_no")
    return numbered.select("file_ord", "line_no", "raw")


def code_tasks(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as the rows of line items ask for (a count of the files' footers)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey")
    return tasks_for(li, li.count())


def code_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, code): one code-shaped document per order.

    Lines, in order: header (when ``o_orderkey % 3 <> 0``), ``contract C.. {``,
    up to four lines per line item (items numbered by
    ``(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)``), ``}``.
    Built with one aggregate over lineitem (already partitioned by order key)
    and one join to orders.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
               "l_shipdate", "l_extendedprice")
    n = code_tasks(spark, sf_dir)
    li = li.repartition(n, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                 "l_extendedprice")
    li = li.withColumn("item", F.row_number().over(w))
    part = F.col("l_partkey").cast("string")
    supp = F.col("l_suppkey").cast("string")
    txt = F.concat_ws(   # up to four lines per item; concat_ws skips the absent (null) ones
        "\n",
        F.concat(F.lit("  uint p"), part, F.lit(" = "), F.col("l_quantity").cast("bigint").cast("string"),
                 F.lit("; // "), F.col("l_returnflag")),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  string s"), supp, F.lit(' = "http://x/'),
                                                      supp, F.lit('";'))),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("  function f"), F.col("item").cast("string"),
                                                      F.lit("() { /* "), F.col("l_returnflag"))),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("  */ total += p"), part, F.lit("; }"))))
    # Same key as the window above: the aggregate needs no further shuffle.
    per_order = (li.groupBy("l_orderkey")
                 .agg(F.array_join(F.sort_array(F.collect_list(F.struct("item", txt.alias("txt")))).getField("txt"),
                                   "\n").alias("body"))
                 .withColumnRenamed("l_orderkey", "ok"))
    # Hash-partitioned on the join key: the exchange a sort-merge join needs anyway;
    # it also keeps the per-document text work spread when the other side is broadcast.
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    ok = F.col("o_orderkey")
    header = F.when(ok % 3 != 0, F.concat(
        F.lit("pragma solidity ^0."), (F.lit(4) + F.col("o_custkey") % 3).cast("string"), F.lit("."),
        (F.col("o_custkey") % 10).cast("string"), F.lit(";")))
    opener = F.concat(F.lit("contract C"), ok.cast("string"), F.lit(" {"))
    return (o.join(per_order, o.o_orderkey == per_order.ok, "left")
            .select(ok.alias("ok"), F.concat_ws("\n", header, opener, F.nullif("body", F.lit("")), F.lit("}"))
                    .alias("code")))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, t): the code documents, one row per line."""
    return lines_of(code_docs(spark, sf_dir))


def lines_of(docs: DataFrame, key: str = "ok", code: str = "code") -> DataFrame:
    """(key, ln, t) from ``\\n``-joined documents (1-based line numbers)."""
    return (docs.select(key, F.posexplode(F.split(F.col(code), "\n", -1)).alias("pos", "t"))
            .where(F.col("t") != "")
            .select(key, (F.col("pos") + 1).cast("bigint").alias("ln"), "t"))


def documents_of(lines: DataFrame, key: str = "ok", ln: str = "ln", t: str = "t",
                 out: str = "code") -> DataFrame:
    """Lines -> one text per document (joined by ``\\n`` in line order)."""
    return lines.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct(F.col(ln).alias("k"), F.col(t).alias("v"))))
                     .getField("v"), "\n").alias(out))


def meta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code, compiler_version, original_version, version)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    m4 = F.col("o_orderkey") % 4
    minor = (F.col("o_custkey") % 27).cast("string")
    o = o.select(F.col("o_orderkey").alias("id"),
                 F.when(m4 == 0, F.concat(F.lit("v0.4."), minor, F.lit("+commit"))).alias("compiler_version"),
                 F.when(m4 == 1, F.concat(F.lit("v0.5."), minor, F.lit("+commit"))).alias("original_version"),
                 F.when(m4 == 2, F.lit("0.6")).alias("version"))
    docs = code_docs(spark, sf_dir).withColumnRenamed("ok", "id")
    return docs.join(o, "id").select("id", "code", "compiler_version", "original_version", "version")


def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, code): code documents after comment stripping (P4) and line normalisation (P5)."""
    stripped = code_docs(spark, sf_dir).select("ok", T.strip_comments(F.col("code")).alias("code"))
    return stripped.select("ok", T.normalise_lines(F.col("code")).alias("code"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, raw): clean_docs as JSONL; some lines are cut in half, hold a number, a list or null in place of the text, or lack it."""
    d, ok = clean_docs(spark, sf_dir), F.col("ok")
    # Inside the function the text is a variable: its cleaning is worked out once.
    def raw(quoted):
        line = F.concat(F.lit('{"contract":'), quoted, F.lit("}"))
        return (F.when(ok % 97 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int")))
                .when(ok % 101 == 0, F.concat(F.lit('{"contract":'), ok.cast("string"), F.lit("}")))
                .when(ok % 103 == 0, F.concat(F.lit("["), quoted, F.lit("]")))
                .when(ok % 107 == 0, F.lit('{"contract":null}'))
                .when(ok % 109 == 0, F.lit('{"other":1}')).otherwise(line))
    return d.select("ok", F.element_at(F.transform(F.array(T.json_quote(F.col("code"))), raw), 1).alias("raw"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, t): code_lines after comment stripping and line normalisation."""
    return lines_of(clean_docs(spark, sf_dir))


def pragma_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, expr) from customer keys."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    choices = F.array(*[F.lit(e).cast("string") for e in PRAGMA_EXPRS])
    return c.select(F.col("c_custkey").alias("id"),
                    F.element_at(choices, (F.col("c_custkey") % len(PRAGMA_EXPRS) + 1).cast("int")).alias("expr"))


def versions(spark: SparkSession) -> DataFrame:
    """(major, minor, patch): the compiler catalogue, generated from ranges."""
    rows = [(ma, mi, p) for ma, mi, last in CATALOGUE for p in range(last + 1)]
    return spark.createDataFrame(rows, "major int, minor int, patch int")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, t): compiler-log-shaped lines from events, per user."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    e = block_row_number(e.withColumnRenamed("user_id", "doc"), ["doc"], ["ts", "event_id"],
                         F.unix_micros(F.col("ts").cast("timestamp")), out="pos")
    loc = (F.col("event_id") % 40 + 1).cast("string")
    et = F.col("event_type")
    t = (F.when((et == "error") & (F.col("event_id") % 2 == 0), F.lit("Error: v"))
         .when(et == "error", F.concat(F.lit("a.sol:"), loc, F.lit(":5: Error: x")))
         .when(et == "view", F.concat(F.lit("--> a.sol:"), loc, F.lit(":7:")))
         .when(et == "click", F.lit("Warning: w"))
         .when(et == "signup", F.lit("TypeError: t"))
         .when(et == "purchase", F.lit("  |")))
    return e.select("doc", "pos", t.alias("t"))


#: Characters of first turns that are sent to every task; more of them are shuffled.
TURNS_SENT = 1 << 24


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(original_line_no, instruction): first assistant turn of the conversation that the order
    key leaves when divided by the number of conversations.

    Order keys are brought to the tasks of ``code_docs`` before their texts are: the texts need no shuffle
    by order where those of all conversations fit in every task.
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    n = conv.agg(F.max("conv_id") + 1).scalar()
    first = materialize(conv.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.min_by("text", "turn").alias("instruction")), "first_turns")
    if (first.agg(F.sum(F.length("instruction") + 64)).first()[0] or 0) <= TURNS_SENT:
        first = F.broadcast(first)
    o = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("original_line_no"))
    o = o.repartition(code_tasks(spark, sf_dir), "original_line_no")
    return o.withColumn("conv_id", F.col("original_line_no") % n).join(first, "conv_id").select("original_line_no", "instruction")


def done_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey")
    return o.where(F.col("o_orderkey") % 5 == 0).select(F.col("o_orderkey").alias("original_line_no"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, t): one code-shaped document per text of ``documents``, two lines per line of the
    text: a declaration that uses the one before (so requirements chain through the whole
    document) and one that stands alone."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.select(F.col("doc_id").alias("ok"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    i, prev = F.col("i").cast("string"), (F.col("i") - 1).cast("string")
    chained = F.when(F.col("i") == 0, F.lit("uint v0 = 1;")).otherwise(F.concat(F.lit("uint v"), i, F.lit(" = v"), prev, F.lit(";")))
    alone = F.concat(F.lit("string s"), i, F.lit(' = "'), F.md5("line"), F.lit('";'))
    return d.select("ok", F.posexplode(F.array(chained, alone)).alias("k", "t"), "i").select(
        "ok", (F.col("i") * 2 + F.col("k") + 1).cast("bigint").alias("ln"), "t")


def _renumbered(rows: DataFrame) -> DataFrame:
    """(ok, ln, t) from (ok, ln, k, t): lines numbered anew in the order of (ln, k)."""
    w = Window.partitionBy("ok").orderBy("ln", "k")
    return rows.select("ok", F.row_number().over(w).cast("bigint").alias("new"), "t").withColumnRenamed("new", "ln")


def scoped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, t): the cleaned code with ``total`` declared in the contract and, on every other line that has a
    function, in the function as well; functions have a line of their own for each statement."""
    c = clean_lines(spark, sf_dir)
    used = F.regexp_extract("t", "(p[0-9]+);", 1)
    function = F.array_compact(F.array(
        F.concat(F.lit("  function g"), F.col("ln").cast("string"), F.lit("() {")), F.when(F.col("ln") % 2 == 0, F.lit("    uint total = 1;")),
        F.concat(F.lit("    total += "), used, F.lit(";")), F.lit("  }")))
    parts = (F.when(F.contains("t", F.lit("function f")), function)
             .when(F.startswith("t", F.lit("contract C")), F.array(F.col("t"), F.lit("  uint total = 0;"))).otherwise(F.array("t")))
    return _renumbered(c.select("ok", "ln", F.posexplode(parts).alias("k", "t")))


#: Lines before a document that has its header inside a block and another one behind it.
TWO_HEADERS = ["library L {", "  pragma solidity ^0.4.9;", "  uint h = 1;", "}", "pragma solidity ^0.5.0;"]


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, t): the cleaned code without its header behind ``TWO_HEADERS``."""
    c = clean_lines(spark, sf_dir)
    row = lambda ln, k, t: F.struct(ln.cast("bigint").alias("ln"), F.lit(k).alias("k"), t.alias("t"))
    head = F.when(F.col("ln") == 1, F.array(*(row(F.lit(0), k, F.lit(t)) for k, t in enumerate(TWO_HEADERS)))).otherwise(F.array())
    body = F.when(~F.startswith("t", F.lit("pragma solidity")), F.array(row(F.col("ln"), 0, F.col("t")))).otherwise(F.array())
    return _renumbered(c.select("ok", F.explode(F.concat(head, body)).alias("r")).select("ok", "r.*"))
