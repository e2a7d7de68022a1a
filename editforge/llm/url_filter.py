"""Operator 10: URL filter on a sorted digest array.

Rules are (host suffix, path prefix, verdict). The 64-bit xxhash of every
``host + path`` rule text is a key; keys are sorted, written once to a file
that Spark hands to every executor, and memory-mapped there, so all workers
of a machine share the pages. The keys a URL can match (each host suffix with
each rule-length path prefix) are probed together by ``numpy.searchsorted``;
every hit is confirmed on the stored rule text, so two texts with one digest
cannot be mistaken for each other.
"""

from __future__ import annotations

import tempfile
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.session import materialize

#: The rules of the registered query: rule text (host/path) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT_VERDICT = "allow"
#: Largest index that is handed to every executor; larger rule sets take the join.
MAX_INDEX_BYTES = 256 << 20
OUT = "host string, path string, rule string, verdict string"


def split_url(url):
    """(host, path) of a url; null or without ``://``: two empty strings."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((p for p in (rest.find(c) for c in "/?#") if p >= 0), default=len(rest))
    host = rest[:cut].translate(_LOWER)
    tail = rest[cut:]
    end = min((p for p in (tail.find(c) for c in "?#") if p >= 0), default=len(tail))
    return host, tail[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def digests(texts) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64)


def build_index(rules, digest=digests) -> dict:
    """Arrays of the index: sorted keys, for each the place of its rule text, texts, verdicts, path lengths."""
    texts = sorted({t for t, _ in rules})
    verdict = {}
    for t, v in rules:  # the first verdict given to a rule text holds
        verdict.setdefault(t, v)
    keys = digest(texts)
    order = np.argsort(keys, kind="stable")
    blob = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, blob)]).astype(np.int64)
    return {"keys": keys[order], "place": order.astype(np.int64), "ends": ends,
            "texts": np.frombuffer(b"".join(blob) or b"\0", np.uint8),
            "blocked": np.array([verdict[t] == "block" for t in texts], bool),
            "paths": np.array(sorted({len(t) - t.index("/") for t in texts}), np.int64)}


def candidates(host: str, path: str, lengths) -> list[str]:
    """Rule texts that would fit this URL, longest first."""
    if not host:
        return []
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1:])
        at = host.find(".", at + 1)
    out = [s + path[:n] for s in suffixes if s for n in lengths if n <= len(path)]
    return sorted(set(out), key=lambda t: (-len(t), t))


def judge(urls, index, digest=digests):
    """Rule text and verdict for each (host, path), probing all candidates at once."""
    lengths = index["paths"].tolist()
    cands = [candidates(h, p, lengths) for h, p in urls]
    flat = [c for cs in cands for c in cs]
    rules, verdicts = [None] * len(urls), [DEFAULT_VERDICT] * len(urls)
    if not flat or not len(index["keys"]):
        return rules, verdicts
    probe = digest(flat)
    keys = index["keys"]
    low, high = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
    place, ends, texts, blocked = index["place"], index["ends"], index["texts"], index["blocked"]
    at = 0
    for i, cs in enumerate(cands):
        for j, c in enumerate(cs):
            for k in range(low[at + j], high[at + j]):
                p = place[k]
                if texts[ends[p]: ends[p + 1]].tobytes() == c.encode():
                    rules[i], verdicts[i] = c, "block" if blocked[p] else "allow"
                    break
            if rules[i] is not None:
                break
        at += len(cs)
    return rules, verdicts


def filter_urls(df: DataFrame, rules=RULES, url: str = "url", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``df`` with host, path, rule, verdict appended (columns of those names are replaced).

    A rule fits its host and all subdomains when the url's path starts with
    the rule's path; of the rules that fit, the longest text wins. No rule:
    ``allow`` and a null rule. Null url or no ``://``: host and path are empty
    and no rule fits. Repeated rows are judged alike; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    rules = list(rules)
    for text, verdict in rules:
        if "/" not in text or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {text!r} {verdict!r}")
    index = build_index(rules)
    if sum(v.nbytes for v in index.values()) > max_index_bytes:
        return _by_join(df, rules, url)
    folder = tempfile.mkdtemp(prefix="url-rules-")  # on the driver only; Spark ships the file
    name = f"rules-{uuid.uuid4().hex}"
    layout, at = {}, 0
    with open(os.path.join(folder, name), "wb") as f:
        for k, v in index.items():
            layout[k] = (at, v.dtype.str, len(v))
            raw = v.tobytes() + b"\0" * (-v.nbytes % 8)
            f.write(raw)
            at += len(raw)
    spark.sparkContext.addFile(os.path.join(folder, name))
    kept = df.drop("host", "path", "rule", "verdict")

    def run(batches):
        path = SparkFiles.get(name)
        held = {k: np.memmap(path, np.dtype(t), "r", o, (n,)) if n else np.zeros(0, np.dtype(t))
                for k, (o, t, n) in layout.items()}
        for batch in batches:
            parts = [split_url(u) for u in batch.column(url).to_pylist()]
            found, verdicts = judge(parts, held)
            out = {n: batch.column(n) for n in batch.schema.names}
            out |= {"host": pa.array([h for h, _ in parts], pa.string()), "path": pa.array([p for _, p in parts], pa.string()),
                    "rule": pa.array(found, pa.string()), "verdict": pa.array(verdicts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, {OUT}")


def _by_join(df: DataFrame, rules, url: str) -> DataFrame:
    """The same answer for rule sets too large to hand out: candidates are joined on their digest and text."""
    spark = df.sparkSession
    kept = df.drop("host", "path", "rule", "verdict").withColumn("_row", F.monotonically_increasing_id())
    kept = materialize(kept, "urls")  # row numbers must not change between the two uses
    lengths = sorted({len(t) - t.index("/") for t, _ in rules})
    first = {}
    for t, v in rules:
        first.setdefault(t, v)
    table = spark.createDataFrame(list(first.items()), "rule string, verdict string").withColumn("key", F.xxhash64("rule"))

    def expand(batches):
        for batch in batches:
            rows, texts, hosts, paths = [], [], [], []
            for r, u in zip(batch.column("_row").to_pylist(), batch.column(url).to_pylist()):
                h, p = split_url(u)
                for c in candidates(h, p, lengths) or [None]:
                    rows.append(r), texts.append(c), hosts.append(h), paths.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              pa.array(texts, pa.string())], names=["_row", "host", "path", "rule"])

    probes = kept.select("_row", url).mapInArrow(expand, "_row long, host string, path string, rule string")
    hits = (probes.withColumn("key", F.xxhash64("rule")).join(table, ["key", "rule"], "left")
            .groupBy("_row").agg(F.first("host").alias("host"), F.first("path").alias("path"),
                                 F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best")))
    return (kept.join(hits, "_row").drop("_row").withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT))})
            .drop("best"))


def op10_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM u
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
