"""Operator 11: nearest neighbours by inner product through randomly rotated one-bit codes.

A vector is kept as the offset from the centre of its cell, turned by a random
rotation, and of that one bit a dimension: its sign. The code with two scalars (length of the
offset; how well the signs point along it) gives an estimate of the inner
product with any query and a bound of the estimate's error. A query walks the
cells of the largest centre products, as many as neighbours of the sample needed; in a
cell only vectors whose upper bound reaches the query's 20th best lower
bound are multiplied out in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editforge.session import materialize

NEIGHBOURS = 20
#: Ids that this divides are queries.
QUERY_STEP = 20
#: Centres, number of cells to visit and first thresholds are learnt from at most this many vectors (least hash of the id
#: first), or ROWS_A_CELL for each cell where that is more, within SAMPLE_BYTES.
SAMPLE_ROWS, ROWS_A_CELL, SAMPLE_BYTES = 10_000, 32, 256 << 20
#: Share of the nearest neighbours of the sample that lie in the visited cells.
TARGET_RECALL = 0.98
#: Width of the error bound in deviations of a random direction's estimate.
DEVIATIONS = 3.0
#: Bits of a query's rotated entries.
QUERY_BITS = 6
#: Index rows and queries on either side of one block of comparisons.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
#: Estimates held at once.
ESTIMATES = 1 << 21


def matrix(arrays, dims: int) -> np.ndarray:
    """Vectors as rows of one width in double precision; shorter ones get zeros."""
    if isinstance(arrays, pa.Array) and (np.asarray(arrays.value_lengths()) == dims).all():
        return np.asarray(arrays.flatten(), np.float64).reshape(-1, dims)
    rows = arrays.to_pylist() if isinstance(arrays, (pa.Array, pa.ChunkedArray)) else list(arrays)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def centres_of(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means centres, begun at rows of a fixed shuffle."""
    centres = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        code = nearest(x, centres)
        count = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.zeros(len(x), np.int64), (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i: i + 4096] = (half[None, :] - x[i: i + 4096] @ centres.T).argmin(1)
    return out


class Coder:
    """Rotation, centres and number of visited cells."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, n_rows: int, k: int, recall: float):
        dims = sample.shape[1]
        rng = np.random.default_rng(7)
        turn, upper = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.turn = turn * np.sign(np.diag(upper))  # uniform among rotations and reflections
        self.dims, self.words = dims, -(-dims // 64)
        self.sample, self.ids = sample.astype(np.float32), ids
        self.centres = centres_of(sample, max(1, min(int(n_rows ** 0.5 / 4), len(sample) // ROWS_A_CELL)))
        asking = rng.permutation(len(sample))[:500]
        score = sample[asking] @ sample.T
        score[np.arange(len(asking)), asking] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        rank = np.argsort(np.argsort(-(sample[asking] @ self.centres.T), axis=1, kind="stable"), axis=1, kind="stable")
        ranks = np.take_along_axis(rank, nearest(sample, self.centres)[best], 1) + 1
        self.visits = int(np.quantile(ranks, recall, method="higher")) if ranks.size else 1

    def encode(self, v: np.ndarray):
        """(cell, packed signs, length of the offset, share of it along its signs) of each row."""
        cell = nearest(v, self.centres)
        rest = v - self.centres[cell]
        length = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.where(length > 0, length, 1)[:, None]) @ self.turn
        bits = np.zeros((len(v), self.words * 64), np.uint8)
        bits[:, : self.dims] = turned > 0
        along = np.abs(turned).sum(1) / self.dims ** 0.5
        return cell, np.packbits(bits, axis=1, bitorder="little").view(np.uint64), length, along

    def planes(self, q: np.ndarray):
        """Rotated queries as whole numbers of QUERY_BITS bits: (bit planes, least entry, step, their sum, length of what rounding left)."""
        turned = q @ self.turn
        low = turned.min(1)
        step = (turned.max(1) - low) / ((1 << QUERY_BITS) - 1)
        step = np.where(step > 0, step, 1)
        whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        back = low[:, None] + step[:, None] * whole
        planes = np.zeros((QUERY_BITS, len(q), self.words), np.uint64)
        for p in range(QUERY_BITS):
            bits = np.zeros((len(q), self.words * 64), np.uint8)
            bits[:, : self.dims] = whole >> p & 1
            planes[p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        return planes, low, step, back.sum(1), np.sqrt(((turned - back) ** 2).sum(1))

    def estimate(self, planes, codes, length, along, centre: np.ndarray, q: np.ndarray):
        """(estimates, error bounds) of the inner products of queries (rows) with the coded vectors of one cell (columns)."""
        bits, low, step, total, lost = planes
        ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        picked = np.zeros((len(low), len(codes)), np.float32)
        for p in range(QUERY_BITS):
            for w in range(self.words):
                picked += np.bitwise_count(bits[p][:, w, None] & codes[None, :, w]) * np.float32(1 << p)
        root = self.dims ** 0.5
        signed = (2 * (low[:, None].astype(np.float32) * ones[None, :] + step[:, None].astype(np.float32) * picked) - total[:, None].astype(np.float32)) / np.float32(root)
        some = along > 0
        factor = np.where(some, length / np.where(some, along, 1), 0)
        norm = np.sqrt((q * q).sum(1))
        slope = np.sqrt(np.maximum(1 - along ** 2, 0)) * DEVIATIONS / max(self.dims - 1, 1) ** 0.5
        error = (norm[:, None] * slope[None, :] + lost[:, None]) * factor[None, :]
        middle = q @ centre
        # Rounding of the single-precision sums above.
        return middle[:, None] + signed * factor[None, :], error + 1e-5 * (np.abs(middle)[:, None] + norm[:, None] * (length + np.sqrt(centre @ centre))[None, :])

    def thresholds(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """A score that k vectors other than the query are known to reach: the k-th best in the sample, less rounding."""
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        norm = np.sqrt((q * q).sum(1)) * np.sqrt((self.sample.astype(np.float64) ** 2).sum(1).max())
        out = np.zeros(len(q))
        for i in range(0, len(q), 256):
            score = q[i: i + 256] @ self.sample.T.astype(np.float64)
            score[ids[i: i + 256, None] == self.ids[None, :]] = -np.inf
            out[i: i + 256] = np.partition(score, len(self.sample) - k, axis=1)[:, len(self.sample) - k]
        return out - 1e-5 * norm


def _index(sent):
    def run(batches):
        for batch in batches:
            v = matrix(batch.column("vector"), sent.value.dims)
            cell, codes, length, along = sent.value.encode(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column("id"), batch.column("vector"), pa.array(codes.view(np.int64).tolist(), pa.list_(pa.int64())),
                 pa.array(length), pa.array(along)], names=["cell", "id", "vector", "code", "length", "along"])
    return run


def _ask(sent, rows_in: np.ndarray, k: int):
    """Each query once for every cell that it visits: the calibrated number, and on until they hold k vectors beside its own."""
    def run(batches):
        coder = sent.value
        for batch in batches:
            q, ids = matrix(batch.column("vector"), coder.dims), np.asarray(batch.column("id"))
            if not len(q):
                continue
            walk = np.argsort(-(q @ coder.centres.T), axis=1, kind="stable")
            enough = (np.cumsum(rows_in[walk], axis=1) < k + 1).sum(1) + 1
            visits = np.minimum(np.maximum(coder.visits, enough), len(coder.centres))
            row = pa.array(np.repeat(np.arange(len(q)), visits))
            cell = np.concatenate([w[:n] for w, n in zip(walk, visits)])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id").take(row), batch.column("vector").take(row),
                                              pa.array(coder.thresholds(q, ids, k)).take(row)], names=["cell", "id", "vector", "reach"])
    return run


def _compare(sent, k: int):
    """A block: vectors of one cell against queries that visit it. The best k of the block for each query, exactly."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        coder = sent.value
        asked = rows["reach"].notna().to_numpy()
        held = rows[~asked].sort_values("id", ignore_index=True)
        asking = rows[asked]
        out = []
        if len(held) and len(asking):
            v, ids = matrix(held["vector"], coder.dims), held["id"].to_numpy(np.int64)
            codes = np.array(held["code"].tolist(), np.int64).view(np.uint64)
            length, along = held["length"].to_numpy(), held["along"].to_numpy()
            centre = coder.centres[int(rows["cell"].iloc[0])]
            size = max(1, ESTIMATES // len(held))
            for i in range(0, len(asking), size):
                part = asking.iloc[i: i + size]
                q, own, reach = matrix(part["vector"], coder.dims), part["id"].to_numpy(np.int64), part["reach"].to_numpy()
                guess, error = coder.estimate(coder.planes(q), codes, length, along, centre, q)
                other = own[:, None] != ids[None, :]
                if len(held) > k:
                    least = np.where(other, guess - error, -np.inf)
                    reach = np.maximum(reach, np.partition(least, len(held) - k, axis=1)[:, len(held) - k])
                x, y = np.nonzero((guess + error >= reach[:, None]) & other)
                out += _best(q, own, v, ids, x, y, k)
        if not out:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True)
    return run


def _best(q, own, v, ids, x, y, k):
    """Exact scores of the pairs (x, y) in turns; of each query the k best, ties to the smaller id."""
    out, at = [], 0
    while at < len(x):
        stop = min(at + (1 << 17), len(x))
        if stop < len(x):  # a query's pairs stay together
            stop = int(np.searchsorted(x, x[stop], "left"))
            if stop <= at:
                stop = int(np.searchsorted(x, x[at], "right"))
        a, b = x[at:stop], y[at:stop]
        score = np.concatenate([(q[a[i: i + 8192]] * v[b[i: i + 8192]]).sum(1) for i in range(0, len(a), 8192)])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
        top = rank < k
        out.append(pd.DataFrame({"query_id": own[a[top]], "vec_id": ids[b[top]], "score": score[top]}))
        at = stop
    return out


def nearest_vectors(df: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding",
                    sample_rows: int = SAMPLE_ROWS, recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``df`` of largest inner product with each row of ``queries``.

    Both tables have ``key`` and ``vector``; a query's own key is no candidate. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a
    null key, take no part; shorter vectors have zeros in the missing places.
    Rows that repeat a key are taken once, with the least of its vectors. A
    query gets all candidates if there are fewer than k; ties go to the smaller key; other
    columns are left out; empty tables give an empty result.
    """
    spark = df.sparkSession
    index = _sound(df, key, vector)
    # Of equal vectors only the k + 1 of least key can be among anybody's k nearest.
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    index = materialize(index.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = _sound(queries, key, vector)
    n, dims = index.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(1, min(max(sample_rows, int(n ** 0.5 / 4) * ROWS_A_CELL), SAMPLE_BYTES // (4 * dims)))
    sample = index.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vector").toArrow()
    coder = Coder(matrix(sample["vector"], dims), sample["id"].to_numpy(), n, k, recall)
    sent = spark.sparkContext.broadcast(coder)  # at most SAMPLE_BYTES and as many bytes of centres and rotation
    kind = index.schema["vector"].dataType.simpleString()
    placed = materialize(index.mapInArrow(_index(sent), f"cell int, id long, vector {kind}, code array<long>, length double, along double"), "codes")
    rows_in = np.zeros(len(coder.centres), np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        rows_in[r["cell"]] = r["count"]
    asking = materialize(asked.mapInArrow(_ask(sent, rows_in, k), f"cell int, id long, vector {asked.schema['vector'].dataType.simpleString()}, reach double"), "asking")
    sizes = (placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("ni"))
             .join(asking.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq")), "cell"))
    none = {"code": F.lit(None).cast("array<long>"), "length": F.lit(None).cast("double"), "along": F.lit(None).cast("double")}
    left = (placed.withColumn("reach", F.lit(None).cast("double")).join(F.broadcast(sizes), "cell")  # a row a cell
            .withColumn("bi", F.pmod(F.xxhash64("id"), "ni").cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))))
    right = (asking.withColumns(none).join(F.broadcast(sizes), "cell")
             .withColumn("bq", F.pmod(F.xxhash64("id"), "nq").cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))))
    columns = ["cell", "bi", "bq", "id", F.col("vector").cast("array<double>").alias("vector"), "code", "length", "along", "reach"]
    found = left.select(*columns).union(right.select(*columns)).groupBy("cell", "bi", "bq").applyInPandas(_compare(sent, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    sound = F.expr("id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vector, x -> x <> 0)")
    return rows.where(sound).groupBy("id").agg(F.min("vector").alias("vector"))


def op11_one_bit_codes(spark, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return nearest_vectors(embeddings, embeddings.where(F.col("vec_id") % QUERY_STEP == 0))
