"""Operator 3: near-duplicate vectors through an inverted multi-index.

A vector's halves have a codebook each; the pairs of codes are the cells of a
product grid. A query walks the cells from the nearest on (multi-sequence
order of the two sorted distance lists) until as many are visited as a
neighbour at the threshold needs to be found at the target recall, which is
calibrated on neighbours made for the purpose. What lies in a visited cell is
compared in double precision. Both ends of a pair search, so a pair
is lost only when both miss.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.common import components
from editforge.session import materialize

MIN_COSINE = 0.9
#: Codebooks and the number of cells to visit are learnt from at most this many vectors (least hash of the id first).
SAMPLE_ROWS = 10_000
#: Share of neighbours at exactly the threshold that one of the two searches finds.
TARGET_RECALL = 0.97
#: Vectors a cell holds on average, and most codes a half has.
CELL_ROWS, MOST_CODES = 32, 256
#: Rows on either side of one block of comparisons.
BLOCK_ROWS = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, also very large and very small ones."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres, begun at rows far apart in a fixed shuffle."""
    rng = np.random.default_rng(1)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        code = squared(x, centres).argmin(1)
        count = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class Grid:
    """The two codebooks and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, n_rows: int, min_cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        k = int(min(MOST_CODES, max(1, (n_rows / CELL_ROWS) ** 0.5), len(sample)))
        self.first = codebook(sample[:, : self.half], k)
        self.second = codebook(sample[:, self.half:], k)
        self.codes = k
        # Neighbours at the threshold in random directions: how far down the walk is their cell?
        rng = np.random.default_rng(2)
        x = sample[rng.permutation(len(sample))[:1000]]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        norm = np.sqrt((side * side).sum(1, keepdims=True))
        y = min_cosine * x + (1 - min_cosine ** 2) ** 0.5 * side / np.where(norm > 0, norm, 1)
        a, b = self.distances(x)
        cell = self.cells(y)
        own = a[np.arange(len(x)), cell // k] + b[np.arange(len(x)), cell % k]
        ranks = [int((p[:, None] + q[None, :] < d).sum()) + 1 for p, q, d in zip(a, b, own)]
        self.visits = max(1, int(np.quantile(ranks, recall, method="higher"))) if ranks else 1

    def distances(self, x):
        return squared(x[:, : self.half], self.first), squared(x[:, self.half:], self.second)

    def cells(self, x) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.codes + b.argmin(1)

    def walk(self, x) -> list[list[int]]:
        """Cells each row visits, nearest first: multi-sequence traversal of the sorted half distances."""
        a, b = self.distances(x)
        first, second = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, first, 1), np.take_along_axis(b, second, 1)
        return [multi_sequence(a[i].tolist(), b[i].tolist(), first[i].tolist(), second[i].tolist(), self.visits) for i in range(len(x))]


def multi_sequence(a, b, first, second, most: int) -> list[int]:
    """The ``most`` cells of least a[i] + b[j], in order; a cell waits until its two predecessors are out."""
    k = len(b)
    heap, reached, out = [(a[0] + b[0], 0, 0)], [0] * len(a), []  # reached[i]: cells of row i that are out
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(first[i] * k + second[j])
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < k and (i == 0 or reached[i - 1] >= j + 2):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _place(sent, dims):
    """Per vector: its row in the index under its first code, and its probes, one for each first code it visits."""
    def run(batches):
        grid = sent.value
        for batch in batches:
            raw = batch.column("vector")
            v = unit(padded(raw, dims))
            cells = grid.cells(v).tolist()
            code, probe, second, row = [], [], [], []
            visited = grid.walk(v)
            for r, (cell, walk) in enumerate(zip(cells, visited)):
                code.append(cell // grid.codes), probe.append(False), second.append([cell % grid.codes]), row.append(r)
                by: dict = {}
                for c in walk:
                    by.setdefault(c // grid.codes, []).append(c % grid.codes)
                for i, js in by.items():
                    code.append(i), probe.append(True), second.append(js), row.append(r)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(code, pa.int32()), pa.array(probe, pa.bool_()), pa.array(second, pa.list_(pa.int32())), batch.column("id").take(at),
                 batch.column("copies").take(at), raw.take(at), pa.array([cells[r] for r in row], pa.int32()),
                 pa.array([None if p else visited[r] for p, r in zip(probe, row)], pa.list_(pa.int32()))],
                names=["code", "probe", "second", "id", "copies", "vector", "cell", "walk"])
    return run


def padded(arrays, dims: int) -> np.ndarray:
    """Vectors as rows of one width; what is shorter gets zeros, which change no cosine."""
    rows = arrays.to_pylist() if isinstance(arrays, (pa.Array, pa.ChunkedArray)) else list(arrays)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _compare(dims: int, min_cosine: float):
    """A block: index rows of one first code against probes of that code. Links that each end counts, and a spanning forest of the links."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["probe", "id"], ignore_index=True)
        probe = rows["probe"].to_numpy()
        v, ids, copies = unit(padded(rows["vector"], dims)), rows["id"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        width = rows["vector"].map(len).to_numpy()
        index, queries = np.flatnonzero(~probe), np.flatnonzero(probe)
        credit, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        spot = {i: [] for i in set(int(s[0]) for s in rows["second"][~probe])}
        for r in index.tolist():
            spot[int(rows["second"][r][0])].append(r)
        asks: dict = {}
        for r in queries.tolist():
            for j in rows["second"][r]:
                if int(j) in spot:
                    asks.setdefault(int(j), []).append(r)
        cell = rows["cell"].to_numpy()
        for j, asking in asks.items():
            held = np.array(spot[j])
            walks = np.array([list(w) for w in rows["walk"][held]])
            for a in range(0, len(asking), 1024):
                q = np.array(asking[a: a + 1024])
                hit = (v[q] @ v[held].T >= min_cosine) & (ids[q][:, None] != ids[held][None, :]) & (width[q][:, None] == width[held][None, :])
                if not hit.any():
                    continue
                credit[q] += hit @ copies[held]
                # The other end counts the link here when its own walk does not come by.
                kinds, at = np.unique(cell[q], return_inverse=True)
                comes = np.stack([(walks == c).any(1) for c in kinds])[at]
                credit[held] += (hit & ~comes).T @ copies[q]
                for r, h in zip(q[hit.any(1)].tolist(), hit[hit.any(1)]):
                    roots = np.unique(np.append(label[held[h]], label[r]))
                    if len(roots) > 1:
                        label[np.isin(label, roots[1:])] = roots[0]
        some = np.flatnonzero((credit > 0) | (label != np.arange(len(rows))) | (np.bincount(label, minlength=len(rows)) > 1))
        return pd.DataFrame({"id": ids[some], "links": credit[some], "root": ids[label[some]]})
    return run


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE,
                 sample_rows: int = SAMPLE_ROWS, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different length. n_links counts the
    other rows at a cosine of ``min_cosine`` or more, copies included;
    component_id is the least key that links reach; kept marks the row whose
    key that is. Rows with a null key link with nothing (their component_id is
    null, kept false); rows that repeat key and vector are one vector, given
    once for each row; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    sound = F.expr("id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vector, x -> x <> 0)")
    rows = rows.withColumns({"sound": F.coalesce(sound, F.lit(False)), "sig1": F.xxhash64("vector"), "sig2": F.xxhash64(F.lit(7), "vector")})
    live = rows.where("sound")
    # Equal vectors are one class: its least id stands for all of them.
    classes = materialize(live.select("id", "sig1", "sig2").distinct().groupBy("sig1", "sig2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = materialize(live.join(classes.withColumnRenamed("rep", "id"), ["id", "sig1", "sig2"]).dropDuplicates(["id"]).select("id", "copies", "vector"), "vectors")
    n, dims = reps.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sample = unit(padded([r[0] for r in reps.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()], dims))
    grid = spark.sparkContext.broadcast(Grid(sample, n, min_cosine, recall))  # at most 2 * MOST_CODES half vectors
    kind = reps.schema["vector"].dataType.simpleString()
    placed = materialize(reps.mapInArrow(_place(grid, dims), f"code int, probe boolean, second array<int>, id long, copies long, vector {kind}, cell int, walk array<int>"), "placed")
    # Each code's index rows and probes are cut into blocks; every block of one meets every block of the other.
    sizes = (placed.groupBy("code").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("probe")) / BLOCK_ROWS)).cast("int").alias("ni"),
                                        F.greatest(F.lit(1), F.ceil(F.count_if("probe") / BLOCK_ROWS)).cast("int").alias("np")))
    dealt = (placed.join(F.broadcast(sizes), "code")  # at most MOST_CODES rows
             .withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("np")).otherwise(F.col("ni"))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("ni")).otherwise(F.col("np")) - 1)))
             .withColumns({"bi": F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")), "bp": F.when(F.col("probe"), F.col("own")).otherwise(F.col("other"))}))
    found = materialize(dealt.select("code", "bi", "bp", "probe", "second", "id", "copies", "vector", "cell", "walk")
                        .groupBy("code", "bi", "bp").applyInPandas(_compare(dims, min_cosine), "id long, links long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    return (rows.join(classes.withColumn("sound", F.lit(True)), ["sound", "sig1", "sig2"], "left").join(counts, "rep", "left").join(groups, "rep", "left")
            .select(F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
                    F.coalesce("component_id", "rep", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))


def op3_multi_index(spark, sf_dir):
    return link_vectors(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
