"""Whitening of embeddings from a covariance that is recovered by polarisation.

For whole numbers ``x`` the squares of every centred dimension and of every centred sum of two
dimensions are added up exactly; ``2 cov(a, b) = var(a + b) - var(a) - var(b)`` then gives all cross-covariances
without a product of two dimensions. The tasks centre at the whole number next to the mean, which keeps squares small;
the rest of the mean (below one half) is taken out exactly afterwards. The driver gets one row for each dimension and pair of dimensions,
whatever the number of rows, and solves the eigenproblem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 32
#: Components whose eigenvalue is a smaller part of the largest one have no variance and are left out.
LEAST_VARIANCE = 1e-12
#: Entries of this size and more (about 1.7e10) take no part: sums of their squares would not fit in 38 digits.
MOST_ENTRY = float(1 << 34)
_SAFE = float(1 << 62)


@dataclass
class Fit:
    """Exact moments of the fit list and its leading components."""

    n: int
    sums: list[int]  # per dimension, of x
    middle: np.ndarray  # whole number next to each mean
    rest: list[int]  # sums - n * middle
    covariance: np.ndarray
    values: np.ndarray  # falling eigenvalues of the components
    axes: np.ndarray  # (dimensions, components)

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x array<long>``: rows whose vector is whole and finite, as whole numbers.

    Vectors that are null, empty or hold null, non-finite or excessive entries (``MOST_ENTRY``) are dropped, and so are those of another
    length than the most frequent one (ties: the longer one).
    """
    c = F.col(vector_col)
    good = c.isNotNull() & (F.size(c) > 0) & ~F.exists(
        c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) >= MOST_ENTRY))
    found = rows.where(good).select(F.col(id_col).alias("vec_id"), F.transform(
        c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    sizes = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    return found.where(F.size("x") == (most.d if most else 0))


def _matrix(column) -> np.ndarray:
    """Rows of whole vectors of one Arrow column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pair_squares(middle: np.ndarray):
    """Vectors to sums of squares ``(i, j, q)`` of the centred ``x_i + x_j``; ``j = i`` is dimension ``i`` alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, d = None, len(middle)
        for b in batches:
            if not len(b):
                continue
            z = np.ascontiguousarray((_matrix(b["x"]) - middle).T)
            if 4.0 * float(np.abs(z).max()) ** 2 * z.shape[1] >= _SAFE:
                z = z.astype(object)  # whole numbers of any size
            total = np.zeros((d, d), object) if total is None else total
            for i in range(d):
                total[i, i] += int((z[i] * z[i]).sum())
                both = z[i + 1 :] + z[i]
                total[i, i + 1 :] += (both * both).sum(axis=1)
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "q": pa.array([str(q) for q in total[i, j]], pa.string())})

    return rows


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Moments and components of ``vectors (x)``; None if there is no row.

    Two passes: sums of each dimension, then the squares. Sums over tasks are decimals of 38 digits.
    """
    place = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    first = sorted((r.i, r.n, int(r.s)) for r in place.collect())  # one row per dimension
    if not first:
        return None
    n, sums = first[0][1], [s for _, _, s in first]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    d = len(sums)
    parts = vectors.select("x").mapInArrow(_pair_squares(np.array(middle, np.int64)), "i int, j int, q string")
    squares = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect():  # d * (d + 1) / 2 rows
        # exact sum of squares of n * x - S, for a dimension or the sum of two
        away = rest[r.i] + (rest[r.j] if r.j != r.i else 0)
        squares[r.i, r.j] = n * n * int(r.q) - n * away * away
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = squares[i, i] / n**3
        for j in range(i + 1, d):
            # difference of variances: whole numbers until the one division, which rounds once
            covariance[i, j] = covariance[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    some = int((values > LEAST_VARIANCE * max(float(values[0]), 0.0)).sum()) if values[0] > 0 else 0
    k = min(components, some)
    return Fit(n, sums, np.array(middle, np.int64), rest, covariance, values[:k].copy(), np.ascontiguousarray(axes[:, :k]))


def project(x: np.ndarray, found: Fit) -> np.ndarray:
    """Whitened values, one row per vector."""
    centred = (x - found.middle) - np.array(found.rest, float) / found.n
    return centred @ found.axes / np.sqrt(found.values)


def deviations(x: np.ndarray, found: Fit) -> list[int | None]:
    """Exact ``sum((n * x - S) ** 2)`` of each vector; None where it needs more than 64 bits."""
    z, rest = x - found.middle, np.array(found.rest, np.int64)
    y = z.astype(float) * found.n - rest
    size = (y * y).sum(axis=1)
    small = size < _SAFE
    y = z[small] * found.n - rest
    out = np.full(len(x), None, object)
    out[small] = (y * y).sum(axis=1)
    for i in np.flatnonzero(~small & (size < 4 * _SAFE)).tolist():  # near the limit
        exact = sum((v * found.n - s) ** 2 for v, s in zip(z[i].tolist(), found.rest, strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return out.tolist()


def identity_error(vectors: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured on all rows."""
    k = len(found.values)
    if not k:
        return 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                w = project(_matrix(b["x"]), found)
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(k * (k + 1)), pa.int32()), "v": pa.array(np.r_[first, second.ravel()], pa.float64())})

    parts = vectors.select("x").mapInArrow(rows, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (k + 1))
    for r in parts:  # k * (k + 1) rows
        total[r.i] = r.v
    mean = total[:k] / found.n
    return float(np.abs(total[k:].reshape(k, k) / found.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Which vectors take part: see ``whole_vectors``. Components without variance are left out (``LEAST_VARIANCE``), so that equal vectors, a
    single one or none give no rows. Ids may be null or repeat; other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = stored(whole_vectors(rows, id_col, vector_col), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors, components)
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    error, explained, k = identity_error(vectors, found), found.values / found.trace, len(found.values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = len(b)
            if not m:
                continue
            x = _matrix(b["x"])
            each = np.repeat(np.arange(m), k)
            deviation = pa.array(deviations(x, found), pa.int64())
            yield pa.RecordBatch.from_pydict({
                "vec_id": b["vec_id"].take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, found.n, np.int64)), "deviation": deviation.take(pa.array(each)),
                "whitened": pa.array(project(x, found).ravel()), "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * k, error))})

    return vectors.mapInArrow(out, schema)
