"""Scalar text functions against Python's own string semantics."""

import hashlib
import random

from pyspark.sql import functions as F

from editforge.functions import text as T

ALPHABET = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85",
            " ", " ", "\xa0", "　", "x", "é"]


def test_lines_and_strip_match_python(spark):
    rnd = random.Random(7)
    strs = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(strs)), "i int, s string")
    rows = df.select("i", T.splitlines(F.col("s")).alias("sl"), T.rstrip_ws(F.col("s")).alias("rs"),
                     T.strip_ws(F.col("s")).alias("st"), T.normalise_lines(F.col("s")).alias("nl")).collect()
    for r in rows:
        s = strs[r.i]
        assert list(r.sl) == s.splitlines(), repr(s)
        assert r.rs == s.rstrip() and r.st == s.strip(), repr(s)
        assert r.nl == "\n".join(x.rstrip() for x in s.splitlines() if x.strip()), repr(s)


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("o")).first().o


def test_strip_comments_default_and_compat(spark):
    src = "a = 'x'; // keep?\nb = 'y'; // gone"
    assert _one(spark, T.strip_comments(F.col("s")), src) == "a = 'x'; \nb = 'y'; "
    # compat: the single-quoted literal runs to the last ' before a ", so the first comment survives
    assert _one(spark, T.strip_comments(F.col("s"), compat=True), src) == "a = 'x'; // keep?\nb = 'y'; "
    s = 'x = "http://keep"; /* c1\n c2 */ y = 1; // t'
    assert _one(spark, T.strip_comments(F.col("s")), s) == 'x = "http://keep";  y = 1; '


def test_strip_comments_long_literal_no_stack_overflow(spark):
    big = 'string s = "' + ("ab\\\"c" * 40000) + '"; // tail'
    out = _one(spark, T.strip_comments(F.col("s")), big)
    assert out == big[: -len(" // tail")] + " "


def test_extract_version_and_header(spark):
    df = spark.createDataFrame([("v0.4.24+commit",), ("0.6",), (None,)], "s string")
    got = [r.v for r in df.select(T.extract_version(F.col("s")).alias("v")).collect()]
    assert got == ["0.4.24", None, None]
    h = _one(spark, T.ensure_header(F.col("s"), F.lit(None).cast("string")), "contract A {\n}")
    assert h == "pragma solidity ^0.4.0;\ncontract A {\n}"
    assert _one(spark, T.ensure_header(F.col("s"), F.lit("0.5.1")), "PRAGMA Solidity ^0.4.2;\nx") \
        == "PRAGMA Solidity ^0.4.2;\nx"


def test_stable_key_and_hash(spark):
    rows = [("  0xAB ", "f", None, "c"), (None, "f", "p.sol", "c"), (None, None, None, " code\r\nx ")]
    df = spark.createDataFrame(rows, "a string, f string, p string, c string")
    got = [r.k for r in df.select(T.stable_key(F.col("a"), F.col("f"), F.col("p"), F.col("c")).alias("k")).collect()]
    assert got[0] == "addr:0xab::fn:f"
    assert got[1] == "file:p.sol::fn:f"
    assert got[2] == "codehash:" + hashlib.sha256("code\nx".encode()).hexdigest()


def test_normalise_is_linear_in_long_blank_runs(spark):
    import time
    from editforge.functions import text as T
    text = "a" + " " * 1_000_000 + "b  \n\n" + "\u00a0" * 1000 + "\nc"
    df = spark.createDataFrame([(text,), ("x \t y\t \n z",)], "c string").select(T.normalise_lines(F.col("c")).alias("c"))
    t0 = time.time()
    got = [r[0] for r in df.collect()]
    assert time.time() - t0 < 20
    assert got == ["a" + " " * 1_000_000 + "b\nc", "x \t y\n z"]


def test_cleaning_in_runs_equals_plain_python(spark):
    """Comments, literals that do not close and blanks at line ends, of ASCII alone and with rare breaks; runs of any length."""
    import random
    import re
    rng = random.Random(9)
    parts = ["//", "/*", "*/", "/", "\"", "'", "\\", "\n", "\r\n", "\r", " ", "\t", "\x0b", "\x1f", "\x85", " ", "　", "a", "é", "x y", "\"u\"", "'v//'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)] + ["ab\"c/*d*/\" " * 100_000 + "//e", " a" * 200_000 + "  \n" * 100_000 + "\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = df.select("i", T.strip_comments(F.col("c")).alias("s"), T.normalise_lines(F.col("c")).alias("n")).orderBy("i").collect()
    plain = r"""("(?:[^"\\]++|\\[^\n])*+"|'(?:[^'\\]++|\\[^\n])*+')|(?://[^\r\n]*+|/\*[\s\S]*?\*/)"""
    for t, r in zip(texts, got):
        assert r["s"] == re.sub(plain, lambda m: m.group(1) or "", t)
        assert r["n"] == "\n".join(x for x in (x.rstrip() for x in t.splitlines()) if x)
    # A text of ASCII alone is not translated letter by letter.
    assert spark.sql("select 'a\\rb' c").select(T._has_any(F.col("c"), T._RARE_BREAKS)).first()[0]
