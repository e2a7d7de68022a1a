"""Scalar text functions on Columns (P3-P6, P8, P9, P11 helpers).

Everything here returns a ``Column`` built from JVM-side functions, so it stays
inside whole-stage code generation; there is no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must match the reference's behaviour) -------------------
# Python's str.splitlines() terminators: \r\n \n \r \v \f \x1c \x1d \x1e \x85 U+2028 U+2029.
SPLITLINES_RE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
# Python's str.strip()/rstrip() whitespace: every code point with str.isspace()
# (29 of them: \t \n \v \f \r \x1c-\x1f space \x85 \xa0 U+1680 U+2000-U+200A U+2028
# U+2029 U+202F U+205F U+3000), derived by rule rather than listed.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Whitespace left inside a line once every line break is a plain \n: the
# Python whitespace set minus the characters that splitlines() breaks on.
_INLINE_WS = "".join(ch for ch in PY_WHITESPACE if len(("a" + ch + "a").splitlines()) == 1) \
    .replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-")
_RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_RARE_WS = "".join(ch for ch in PY_WHITESPACE if ch not in " \t" and len(("a" + ch + "a").splitlines()) == 1)
# First d.d.d version in a text.
VERSION_RE = "(\\d+\\.\\d+\\.\\d+)"
# Comment stripping: group 1 keeps string literals and, in one go, the text around them; the rest (comments) is dropped.
# Possessive quantifiers keep the JVM regex engine from recursing on long literals.
COMMENT_RE = ("((?:[^\"'/]++|\"(?:[^\"\\\\]++|\\\\[^\\n])*+\"|'(?:[^'\\\\]++|\\\\[^\\n])*+')++)"
              "|(?://[^\\r\\n]*+|/\\*[\\s\\S]*?\\*/)")
# compat: the reference's single-quoted branch excludes '"' instead of "'", so a
# single-quoted literal runs to the last "'" before the next '"'.
COMMENT_RE_COMPAT = ("(\"(?:[^\"\\\\]++|\\\\[^\\n])*+\"|'(?:(?:[^\"'\\\\]++|\\\\[^\\n])*+')++)"
                     "|(?://[^\\r\\n]*+|/\\*[\\s\\S]*?\\*/)")
HEADER_MARKER = "pragma solidity"
DEFAULT_VERSION = "0.4.0"
# ---------------------------------------------------------------------------


def rstrip_ws(c: Column) -> Column:
    """Python ``str.rstrip()`` (a character-set trim, no regex)."""
    return F.rtrim(c, F.lit(PY_WHITESPACE))


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def nonblank(c: Column) -> Column:
    """Python truthiness of ``s.strip()``."""
    return F.length(strip_ws(c)) > 0


def falsy_coalesce(*cols: Column) -> Column:
    """``a or b or ... or ""`` for string fields."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def splitlines(c: Column) -> Column:
    """Python ``str.splitlines()`` as ARRAY<STRING> (a final terminator adds no line)."""
    body = F.regexp_replace(c, "(?:" + SPLITLINES_RE + ")\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, SPLITLINES_RE, -1))


def line_count(c: Column) -> Column:
    return F.size(splitlines(c))


def extract_version(c: Column) -> Column:
    """First ``d.d.d`` in the text, null if none."""
    return F.nullif(F.regexp_extract(c, VERSION_RE, 1), F.lit(""))


def strip_comments(c: Column, compat: bool = False) -> Column:
    """Remove ``//`` and ``/* */`` comments, keep string literals."""
    return F.regexp_replace(c, COMMENT_RE_COMPAT if compat else COMMENT_RE, "$1")


def _has_any(c: Column, chars: str) -> Column:
    """Whether the text holds one of ``chars``; texts of ASCII alone are only searched for those of them that are."""
    found = F.lit(False)
    for ch in chars:
        if ch.isascii():
            found = found | F.contains(c, F.lit(ch))
    return F.when(F.octet_length(c) == F.length(c), found).otherwise(F.length(F.translate(c, chars, "")) < F.length(c))


def _normalise(c: Column, breaks_re: str, inline_ws: str) -> Column:
    x = F.regexp_replace(c, breaks_re, "\n") if breaks_re else c
    # Group 1 takes all up to blanks at a line's end in one go, and a run of blanks is tried once: linear also on long runs inside a line.
    x = F.regexp_replace(x, "((?:[^" + inline_ws + "]++|[" + inline_ws + "]++(?!\n|\\z))++)|[" + inline_ws + "]++", "$1")
    x = F.regexp_replace(x, "\n{2,}", "\n")
    return F.trim(x, F.lit("\n"))


def normalise_lines(c: Column) -> Column:
    """P5: right-strip each line, drop blank lines, join with ``\\n``.

    Code-generated regex passes over the whole text (no per-line lambdas):
    unify line breaks, drop trailing blanks of each line, collapse runs of
    breaks (blank lines), trim breaks at both ends. Texts holding none of the
    rare break/space characters (checked with a cheap ``translate``) take an
    ASCII-only path; the full Unicode class is several times slower.
    Pass a column (not a costly expression): ``c`` is read in both branches.
    """
    rare = _RARE_BREAKS + _RARE_WS
    return F.when(_has_any(c, rare), _normalise(c, SPLITLINES_RE, _INLINE_WS)) \
        .otherwise(_normalise(c, "", " \t"))


def ensure_header(code: Column, version: Column) -> Column:
    """Prepend ``pragma solidity ^V;`` when no header is present."""
    ver = F.coalesce(version, F.lit(DEFAULT_VERSION))
    return F.when(F.lower(code).contains(HEADER_MARKER), code).otherwise(
        F.concat(F.lit("pragma solidity ^"), ver, F.lit(";\n"), code))


def code_hash(c: Column) -> Column:
    """CRLF -> LF, strip, SHA-256 hex."""
    return F.sha2(strip_ws(F.replace(c, F.lit("\r\n"), F.lit("\n"))), 256)


def stable_key(address: Column, func: Column, path: Column, code: Column) -> Column:
    """``addr:..::fn:..`` / ``file:..::fn:..`` / ``codehash:..``."""
    addr = F.lower(strip_ws(F.coalesce(address, F.lit(""))))
    fn = strip_ws(F.coalesce(func, F.lit("")))
    fp = strip_ws(F.coalesce(path, F.lit("")))
    return (F.when((addr != "") & (fn != ""), F.concat(F.lit("addr:"), addr, F.lit("::fn:"), fn))
            .when((fp != "") & (fn != ""), F.concat(F.lit("file:"), fp, F.lit("::fn:"), fn))
            .otherwise(F.concat(F.lit("codehash:"), code_hash(F.coalesce(code, F.lit(""))))))


def json_quote(c: Column) -> Column:
    """A JSON string literal for ``c`` (null -> ``null``)."""
    esc = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def md5_order_key(*parts: Column) -> Column:
    """Deterministic pseudo-random sort key: md5 of ``p1:p2:...``.

    Stable under retries and repartitioning (never ``rand()``), and equal to
    DuckDB's ``md5`` of the same text.
    """
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_pick(key: Column, n: Column) -> Column:
    """Deterministic pick in ``1..n`` from a text key (replaces random.randint)."""
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.lit(1) + F.pmod(h, n.cast("bigint"))


def filter_once(df, cond: Column):
    """``df.where(cond)`` for a condition on an expensive computed column.

    Catalyst pushes a Filter below the projection that computes the column
    and substitutes the expression, so it runs twice (once in the filter, once
    in the projection). Filtering inside a generator keeps it to one.
    """
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(0)))).alias("_keep")).drop("_keep")
