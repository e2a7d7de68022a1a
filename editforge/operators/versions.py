"""Version constraints: L3 pragma, L4 bounds, L5 catalogue resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values ------------------------------------------------------------------
PRAGMA_RE = "(?i)pragma\\s+solidity\\s+([^;]+);"
CARET_RE = "^\\^v?(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?$"
BARE_RE = "^(\\d+)\\.(\\d+)\\.(\\d+)$"
OP_RE = "^(>=|<=|>|<|=)\\s*(\\d+)\\.(\\d+)\\.(\\d+)"
# -------------------------------------------------------------------------------------


def pragma_expr(code) -> F.Column:
    """L3: first ``pragma solidity <expr>;`` (stripped), null if none."""
    return F.nullif(T.strip_ws(F.regexp_extract(code, PRAGMA_RE, 1)), F.lit(""))


def version_bounds(exprs: DataFrame, compat: bool = False) -> DataFrame:
    """L4: (expr, tok_no, side, op, major, minor, patch) for distinct ``expr``.

    ``^a[.b[.c]]`` gives ``>= a.b.c`` and ``< a.(b+1).0``; a bare version is
    ``=``; an expression with a caret token that is no version has no bounds at
    all (the newest version serves it); other unknown tokens are passed over.
    Default: ``=v`` is an exact lower bound and spaced operators (``>= v``,
    ``^ v``) are read as if joined. compat: like the reference, ``=v`` lands on the
    upper side where it is never tested, and a spaced operator stands alone.
    """
    e = exprs.select("expr").where(F.col("expr").isNotNull()).distinct()
    src = F.col("expr") if compat else F.regexp_replace("expr", "(>=|<=|>|<|=|\\^)\\s+", "$1")
    tokens = F.split(T.strip_ws(src), "\\s+")
    unread = F.exists("tokens", lambda t: t.startswith("^") & ~t.rlike(CARET_RE))
    e = e.withColumn("tokens", tokens).select("expr", F.when(unread, F.array().cast("array<string>")).otherwise(F.col("tokens")).alias("tokens"))
    toks = e.select("expr", F.posexplode("tokens").alias("tok_no", "tok"))
    caret, bare, op = F.col("tok").rlike(CARET_RE), F.col("tok").rlike(BARE_RE), F.col("tok").rlike(OP_RE)
    part = lambda pat, i: F.coalesce(F.nullif(F.regexp_extract("tok", pat, i), F.lit("")).cast("int"), F.lit(0))
    v = lambda pat, o=0: F.struct(*[part(pat, i + o).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))])
    lower_ops = ["=", ">=", ">"] if not compat else [">=", ">"]
    b = lambda side, o, ver: F.struct(F.lit(side).alias("side"), o.alias("op"), ver.alias("v"))
    up_v = F.struct(part(CARET_RE, 1).alias("major"), (part(CARET_RE, 2) + 1).alias("minor"), F.lit(0).alias("patch"))
    bounds = (F.when(caret, F.array(b("lower", F.lit(">="), v(CARET_RE)), b("upper", F.lit("<"), up_v)))
              .when(bare, F.array(b("lower", F.lit("="), v(BARE_RE))))
              .when(op, F.array(b(None, F.regexp_extract("tok", OP_RE, 1), v(OP_RE, 1))))
              .otherwise(F.array()))
    out = toks.select("expr", "tok_no", F.explode(bounds).alias("b"))
    side = F.coalesce(F.col("b.side"), F.when(F.col("b.op").isin(*lower_ops), F.lit("lower"))
                      .otherwise(F.lit("upper")))
    return out.select("expr", F.col("tok_no").cast("bigint").alias("tok_no"), side.alias("side"),
                      F.col("b.op").alias("op"), "b.v.major", "b.v.minor", "b.v.patch")


def resolve_version(exprs: DataFrame, catalogue: DataFrame, compat: bool = False) -> DataFrame:
    """(expr, version) = highest catalogue version meeting every bound;
    the newest when there is no pragma, no match or no usable bound.

    Resolved once per distinct ``expr``. The catalogue (a few hundred releases)
    is one array value, a scalar subquery; no join pairs it with expressions.
    """
    known = catalogue.agg(F.collect_set(F.struct("major", "minor", "patch")).alias("known")).scalar()
    bounds = version_bounds(exprs, compat)
    tested = bounds if not compat else bounds.where(~((F.col("side") == "upper") & (F.col("op") == "=")))
    per_expr = tested.groupBy("expr").agg(F.collect_list(F.struct("op", F.struct("major", "minor", "patch").alias("v"))).alias("bounds"))

    def meets(cv):
        return F.forall("bounds", lambda b: ((b["op"] == ">=") & (cv >= b["v"])) | ((b["op"] == ">") & (cv > b["v"])) | ((b["op"] == "=") & (cv == b["v"]))
                        | ((b["op"] == "<=") & (cv <= b["v"])) | ((b["op"] == "<") & (cv < b["v"])))

    e = exprs.select("expr").distinct().join(per_expr, "expr", "left").withColumn("known", known)
    best = F.array_max(F.filter("known", meets))
    resolved = e.select("expr", F.coalesce(F.when(F.col("bounds").isNotNull(), best), F.array_max("known"),
                                           F.raise_error(F.lit("empty compiler catalogue"))).alias("v"))
    return resolved.select("expr", F.concat_ws(".", "v.major", "v.minor", "v.patch").alias("version"))
