"""Order-insensitive comparison of a Spark result with a DuckDB oracle result."""

from __future__ import annotations

import hashlib
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        if math.isnan(v):
            return "\x00null"
        if v == int(v) and abs(v) < 2**53:
            return str(int(v))
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def digest(columns, rows) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\x1e".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return len(lines), cols, h


def spark_digest(df):
    cols = df.columns
    return digest(cols, [tuple(r) for r in df.collect()])


def duck_digest(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return digest(cols, res.fetchall())
