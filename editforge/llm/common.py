"""Helpers shared by the operators: word hashes on Arrow buffers, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.session import materialize

#: Bytes of text that are turned into numpy arrays at once.
CHUNK_BYTES = 1 << 21

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """An invertible scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scattered(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values without a pattern."""
    return mix64(mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15))


#: A value for each byte, and a weight for each place in a word (grown when a longer word comes).
_BYTES = scattered(256, 1 << 40)
_PLACES = [scattered(1 << 12, 1 << 41)]


def places(n: int) -> np.ndarray:
    """Weights of the first n places of a word."""
    if n > len(_PLACES[0]):
        _PLACES[0] = scattered(1 << (n - 1).bit_length(), 1 << 41)
    return _PLACES[0]


def tidy(run):
    """``run``; what its tasks freed goes back to the system then, because Python workers live on through later stages."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return wrapped


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A column as 64-bit-offset strings; null becomes empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Split a string column into runs of about ``limit`` bytes (one text is never cut).

    Yields (first row, row count, bytes, offsets from 0).
    """
    n = len(texts)
    if n == 0:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end - at, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Words (runs of bytes other than ASCII white space) of the texts of a chunk.

    Returns (hash per word, first word of each text, byte start, byte end).
    The hash is a sum of byte values times weights of their places modulo 2^64,
    scrambled together with the length. Weights have no pattern: powers of a base
    would give some pairs of long words the same sum whatever the base.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), z, z
    solid = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    place = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n, dtype=place.dtype), place, out=place)
    longest = int((ends - starts).max()) if len(starts) else 0
    value = _BYTES[LOWER[data] if lower else data]
    value *= places(longest)[np.minimum(place, max(longest - 1, 0), out=place)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = total[ends] - total[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets), starts, ends


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that begin at each word (the last k-1 are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i: i + n]
    return mix64(out)


def _forest(batches):
    """Of the edges of a task: each id's link to the least id they join it to."""
    a, b = [], []
    for batch in batches:
        a.append(np.asarray(batch.column("a"))), b.append(np.asarray(batch.column("b")))
    if not a or not sum(map(len, a)):
        return
    ids, at = np.unique(np.concatenate(a + b), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2:]
    root = np.arange(len(ids))
    while True:  # hook the larger root to the smaller, then shorten all paths
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(ids)))
    for i in range(0, len(own), 100_000):
        part = own[i: i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest id that links reach, by rounds of pointing at the least neighbour.

    ``edges`` has long columns a, b. Returns (id, component_id) for every id
    of an edge. A round is large star and small star, as joins and aggregates,
    and then the forest of what each task holds; its result is a table
    in the shared folder, and only a digest of it comes back.
    """
    now = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "edges")
    mark = None
    while True:
        # Large star: every larger neighbour is linked to the least of the neighbourhood.
        sides = now.union(now.select("b", "a"))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of an id are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.mapInArrow(_forest, "a long, b long").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    # At rest every id has one edge, to the least of its component.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it the first such name that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
