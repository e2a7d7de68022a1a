"""B3 with scopes: a rule beside ``deps.line_dependencies`` with the same result.

Blocks form a tree of scopes. R1 and R2 are as there; for R3 a use of a name requires the first
declaration in the innermost scope around it that declares the name, so an inner
declaration hides an outer one. Scopes of a document are nested intervals of
lines; of one name, those that declare it are nested too, so a running count of
opened less closed ones gives the depth at a use, and the last one opened at that
depth is the innermost. A line carries its own names only, and no use meets more than one declaration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .deps import DECL_RE, IDENT_RE, _blanked

USE, CLOSE, OPEN, EDGE = 0, 1, 2, 3


def _structure(lines: DataFrame, key: str) -> DataFrame:
    """(key, ln, bt, decl, d_before, d_after): brace depth before and after each line."""
    cnt = lambda ch: F.length("bt") - F.length(F.replace(F.col("bt"), F.lit(ch), F.lit("")))
    run = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    b = _blanked(lines, key).withColumn("net", cnt("{") - cnt("}")).withColumn("d_after", F.sum("net").over(run))
    return b.select(key, "ln", "bt", F.regexp_extract("bt", DECL_RE, 1).alias("decl"), (F.col("d_after") - F.col("net")).alias("d_before"), "d_after")


def _levels(b: DataFrame, key: str) -> DataFrame:
    """(key, ln, bt, decl, level, kind, closes, own, o): lines at the levels they open or belong to, with the opener of that level."""
    row = lambda lv, kind, closes, own: F.struct(lv.alias("level"), F.lit(kind).alias("kind"), closes.alias("closes"), own.alias("own"))
    no = F.lit(False)
    opens = F.when(F.col("d_after") > F.col("d_before"),
                   F.transform(F.sequence(F.col("d_before") + 1, F.greatest("d_after", F.col("d_before") + 1)), lambda lv: row(lv, 0, no, no))).otherwise(F.array())
    member = F.transform(F.sequence(F.least(F.col("d_after") + 1, F.col("d_before")), F.col("d_before")), lambda lv: row(lv, 1, lv > F.col("d_after"), lv == F.col("d_before")))
    r = b.select(key, "ln", "bt", "decl", F.explode(F.concat(opens, member)).alias("r")).select(key, "ln", "bt", "decl", "r.*")
    w = Window.partitionBy(key, "level").orderBy("ln", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("o", F.last(F.when(F.col("kind") == 0, F.col("ln")), ignorenulls=True).over(w)).where("kind = 1")


def scoped_dependencies(lines: DataFrame, key: str = "ok") -> DataFrame:
    """Distinct requirement edges (key, ln, req) with ``req != ln``; uses resolve in the innermost declaring scope.

    A declaration belongs to the block around its line (the line that opens a
    block is outside of it); one outside of all blocks is seen everywhere. A block that is never closed reaches to
    the end. Null texts are lines without braces and names; an empty table gives no edges.
    """
    b = _structure(lines.select(key, "ln", F.coalesce("t", F.lit("")).alias("t")), key)
    levels = _levels(b, key).withColumn("scope", F.coalesce("o", F.lit(0)))
    # All windows lie by key: lines spread by key are not shuffled again. A scope of a line is the opener of the
    # level it stands in, 0 outside of all blocks; its close and its first declaration of a name are on every row of it.
    declares = F.when(F.col("own") & F.col(key).isNotNull(), F.nullif("decl", F.lit("")))
    within = Window.partitionBy(key, "level", "scope")
    levels = (levels.withColumn("close", F.min(F.when(F.col("closes") & F.col("o").isNotNull(), F.col("ln"))).over(within))
              .withColumn("name", declares))
    first = Window.partitionBy(key, "level", "scope", "name").orderBy("ln")
    levels = levels.withColumn("first", F.col("name").isNotNull() & (F.row_number().over(first) == 1))
    none = F.lit(None).cast("bigint")
    event = lambda name, ln, kind, d, req: F.struct(name.alias("name"), ln.cast("bigint").alias("ln"), F.lit(kind).alias("kind"), F.lit(d).alias("d"), req.cast("bigint").alias("req"))
    ln, o, no_name = F.col("ln"), F.col("o"), F.lit(None).cast("string")
    used = F.filter(F.array_distinct(F.regexp_extract_all("bt", F.lit(IDENT_RE), 0)), lambda n: n != F.col("decl"))
    events = levels.select(key, F.explode(F.concat(
        F.array_compact(F.array(
            F.when(o.isNotNull(), event(no_name, ln, EDGE, 0, o)), F.when(o.isNotNull() & F.col("closes"), event(no_name, o, EDGE, 0, ln)),
            F.when(F.col("first"), event(F.col("name"), F.col("scope"), OPEN, 1, ln)),
            F.when(F.col("first") & F.col("close").isNotNull(), event(F.col("name"), F.col("close"), CLOSE, -1, none)))),
        F.when(F.col("own"), F.transform(used, lambda n: event(n, ln, USE, 0, none))).otherwise(F.array()))).alias("e")).select(key, "e.*")
    order = Window.partitionBy(key, "name").orderBy("ln", "kind", "req").rowsBetween(Window.unboundedPreceding, 0)
    depth = events.withColumn("depth", F.sum("d").over(order))
    at = Window.partitionBy(key, "name", "depth").orderBy("ln", "kind", "req").rowsBetween(Window.unboundedPreceding, 0)
    seen = depth.withColumn("found", F.when(F.col("kind") == EDGE, F.col("req")).otherwise(F.last("req", ignorenulls=True).over(at)))
    edges = seen.where((F.col("kind") == EDGE) | ((F.col("kind") == USE) & (F.col("depth") > 0)))
    return edges.select(key, "ln", F.col("found").alias("req")).where("req is not null and req <> ln").distinct()
