"""Operator 12: whitening of embeddings by mixed-precision eigenvectors.

Vectors are rounded down to a grid of integers, every distinct one is fitted
once, and the sums and products that the covariance needs are added up in the
tasks that hold the rows. Its eigenvectors are found in single precision
and then corrected by Ogita-Aishima steps, which consist of matrix products in
extended precision only; eigenvalues that lie too close together for a step to
part them are a cluster, whose small eigenproblem is solved on its own.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.session import materialize

#: Grid steps in a unit of an embedding's entry.
SCALE = 256
COMPONENTS = 4
#: Eigenvalues below this share of the largest are taken as zero: rounding of the covariance reaches there.
NOTHING = 1e-13
#: Correction steps at most; each doubles the number of right digits, and single precision gives seven.
STEPS = 12
#: Largest sum of squares that doubles and 64-bit integers hold exactly.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.dot(a.astype(np.longdouble), b.astype(np.longdouble))


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Places of ascending ``values`` in runs whose neighbours are at most ``width`` apart."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > width) + 1)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal columns, by Newton-Schulz steps from one that is nearly so."""
    eye = np.eye(x.shape[1], dtype=np.longdouble)
    for _ in range(6):
        r = eye - _product(x.T, x)
        x = x + _product(x, r) / 2
        if np.abs(r).max() < 1e-18:
            break
    return x


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from single precision. A step measures the residual of
    orthogonality R = I - X'X and S = X'AX; a pair of columns with eigenvalues
    apart is corrected by (s + lambda r) / (difference), another by r / 2.
    Columns of one cluster are first turned by the eigenvectors of their own
    small block X'(A - mu)X, in double precision, where the shift by their mean mu
    makes the differences between them large against rounding.
    """
    a = np.asarray(matrix, np.longdouble)
    d = len(a)
    scale = float(np.abs(a).max()) if d else 0.0
    if not scale or not np.isfinite(scale):
        return np.zeros(d), np.eye(d)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = _orthonormal(start.astype(np.longdouble))
    eye, before = np.eye(d, dtype=np.longdouble), np.inf
    for _ in range(STEPS):
        r = eye - _product(x.T, x)
        s = _product(x.T, _product(a, x))
        value = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(value, kind="stable")
        x, value, r, s = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        rest = s - np.diag(value)
        wide = 2 * (np.sqrt((rest * rest).sum()) + np.abs(value).max() * np.sqrt((r * r).sum()))
        together = np.zeros((d, d), bool)
        turned = False
        for run in _clusters(value, wide):
            together[np.ix_(run, run)] = True
            if len(run) > 1:
                mean = value[run].mean()
                part = _product(x[:, run].T, _product(a - mean * eye, x[:, run])).astype(np.float64)
                size = np.abs(part).max()
                if size > 0:
                    _, turn = np.linalg.eigh((part + part.T) / (2 * size))
                    x[:, run] = _product(x[:, run], _orthonormal(turn.astype(np.longdouble)))
                    turned = True
        if turned:  # the corrections belong to the turned columns
            r = eye - _product(x.T, x)
            s = _product(x.T, _product(a, x))
            value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        # Inside a cluster the turn has made the block diagonal; what differs there is left to orthogonality.
        e = np.where(together | (gap == 0), r / 2, (s + value[None, :] * r) / np.where(gap == 0, 1, gap))
        x = x + _product(x, e)
        change = np.abs(e).max()
        if change < 1e-18 or (change < 1e-15 and change >= before):
            break
        before = change
    x = _orthonormal(x)
    value = np.diag(_product(x.T, _product(a, x)))
    order = np.argsort(-value, kind="stable")
    return np.maximum(value[order] * scale, 0).astype(np.float64), x[:, order].astype(np.float64)


def _grid(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), np.int64).reshape(-1, dims)


def _decimal(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(dims: int):
    """A task's count and per-dimension sums, exact."""
    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            x = _grid(batch, "x", dims)
            n += len(x)
            if len(x):
                safe = max(int(x.max()), -int(x.min())) * len(x) <= LONGEST
                total = [a + int(b) for a, b in zip(total, x.sum(0) if safe else x.astype(object).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), _decimal([n, *total])], names=["i", "v"])
    return run


def _products(dims: int, middle: list[int]):
    """A task's sums of products of entries less the whole number next to their mean (upper triangle)."""
    up = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims), np.longdouble)
        for batch in batches:
            y = _centred(_grid(batch, "x", dims), middle).astype(np.float64)
            for i in range(0, len(y), 4096):
                part = y[i: i + 4096]
                if len(part) * np.abs(part).max(initial=0.0) ** 2 < EXACT:
                    total += part.T @ part
                else:
                    total += _product(part.T, part)
        yield pa.RecordBatch.from_arrays([pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), pa.array(total[up].astype(np.float64))], names=["i", "j", "v"])
    return run


def _centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle; as whole numbers where they fit, else as Python integers."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, middle), default=0) > LONGEST:
        return x.astype(object) - np.array(middle, object)
    return x - np.array(middle, np.int64)


class Whitener:
    """What is fitted: count, sums, eigenvalues and eigenvectors, and the projection."""

    def __init__(self, n: int, total: list[int], products: np.ndarray, middle: list[int], components: int):
        self.n, self.total, self.middle = n, total, middle
        # With y = x - middle: the mean of y is at most one half, so nothing cancels in taking it off.
        self.rest = np.array([t - n * m for t, m in zip(total, middle)], object)
        mean = np.array([np.longdouble(int(r)) / n for r in self.rest], np.longdouble)
        cov = products.astype(np.longdouble) / n - np.outer(mean, mean)
        self.values, vectors = eigen((cov + cov.T) / 2)
        self.trace = float(np.trace(cov)) if len(cov) else 0.0
        self.kept = min(components, len(self.values))
        self.vectors = vectors[:, : self.kept]
        self.live = self.values[: self.kept] > NOTHING * max(self.values.max(initial=0.0), 0.0)
        self.mean = mean.astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components in units of their spread; a component of no spread gives NaN."""
        y = _centred(x, self.middle).astype(np.float64) - self.mean
        root = np.sqrt(np.where(self.live, self.values[: self.kept], np.nan))
        return y @ self.vectors / root

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        y = _centred(x, self.middle)
        top = max((abs(int(y.max())), abs(int(y.min())))) if y.size else 0
        if x.shape[1] * (self.n * (top + 1)) ** 2 <= LONGEST:
            z = self.n * y.astype(np.int64) - self.rest.astype(np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - self.rest
        return [int(v) for v in (z * z).sum(1)]


def to_grid(vector: str, scale: int = SCALE):
    """The long vector floor(scale * c) + 0 of a column of numbers."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per remaining row of ``df`` and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left
    out. Every distinct grid vector is fitted once, so repeated rows weigh
    nothing more; each repeated row gets its own results, a null key stays null.
    Vectors shorter than the longest have zeros in the missing places.
    A component without spread (one distinct vector; constant or dependent
    dimensions beyond the rank) has a null ``whitened``; ``identity_error``
    is over the components with spread, and null where there is none;
    ``explained`` is null where the covariance is zero. A deviation beyond a long is null.
    A table without rows or dimensions gives an empty result. Only the two columns are read.
    """
    spark = df.sparkSession
    sound = F.expr("v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('Infinity'))")
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(sound).select("id", to_grid("v", scale).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fitted = materialize(rows.select("x").distinct(), "fit")
    sums = {r["i"]: int(r["v"]) for r in fitted.mapInArrow(_sums(dims), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    n, total = sums[-1], [sums[i] for i in range(dims)]
    middle = [(2 * t + n) // (2 * n) for t in total]
    products = np.zeros((dims, dims))
    for r in fitted.mapInArrow(_products(dims, middle), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["v"]
    model = spark.sparkContext.broadcast(Whitener(n, total, products, middle, components))  # dims x components numbers
    kept = model.value.kept
    error = _identity_error(fitted, model, dims, kept)

    def run(batches):
        w = model.value
        share = w.values[:kept] / w.trace if w.trace > 0 else np.full(kept, np.nan)
        for batch in batches:
            x = _grid(batch, "x", dims)
            deviation = [v if v <= LONGEST else None for v in w.deviation(x)]
            row = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(row)),
                pa.array(w.whitened(x).ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(share, len(x)), pa.float64(), from_pandas=True),
                pa.array([error] * len(row), pa.float64())],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def _identity_error(fitted: DataFrame, model, dims: int, kept: int) -> float | None:
    """Largest entry of the covariance of the fitted list's whitened vectors, less the identity."""
    def run(batches):
        n, first, second = 0, np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = model.value.whitened(_grid(batch, "x", dims))
            n += len(w)
            first += w.sum(0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first.tolist()], pa.list_(pa.float64())), pa.array([second.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "a", "b"])

    live = np.flatnonzero(model.value.live)
    if not len(live):
        return None
    parts = fitted.mapInArrow(run, "n long, a array<double>, b array<double>")
    sums = parts.agg(F.sum("n"), *(F.sum(F.col("a")[i]) for i in range(kept)), *(F.sum(F.col("b")[i]) for i in range(kept * kept))).first()
    n, mean = sums[0], np.array(sums[1: kept + 1], float) / sums[0]
    cov = np.array(sums[kept + 1:], float).reshape(kept, kept) / n - np.outer(mean, mean)
    return float(np.abs(cov[np.ix_(live, live)] - np.eye(len(live))).max())


def op12_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
