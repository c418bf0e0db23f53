"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The scatter of the centred vectors is summed over the whole table, exactly, in whole numbers.
Its pivoted Cholesky factor is a triangle of the vectors' dimension. One-sided Jacobi turns
the factor's columns until they stand at right angles; their squared norms are then the
eigenvalues of the covariance and the columns, at unit length, its components.

Tasks send sums of the dimension squared, whatever the number of rows. The driver holds
one matrix of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
SWEEPS = 60  # Jacobi takes six to ten; more would be a defect
BLOCK = 4096  # rows whose products are summed in one matrix product
_EXACT = 2.0**53
_LONG = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """What one fit gives; ``components`` has a column for each eigenvalue, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with matrix[order][:, order] = factor @ factor.T, factor lower triangular.

    The largest diagonal entry left is the next pivot. It ends when that is within rounding of
    zero, so the factor has as many columns as the matrix has rank.
    """
    left = matrix.astype(float).copy()
    size = len(left)
    order = np.arange(size)
    factor = np.zeros((size, size))
    least = size * np.finfo(float).eps * max(left.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(np.argmax(left.diagonal()[k:]))
        if left[pivot, pivot] <= least:
            return factor[:, :k], order
        if pivot != k:
            left[[k, pivot]] = left[[pivot, k]]
            left[:, [k, pivot]] = left[:, [pivot, k]]
            factor[[k, pivot]] = factor[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns turned, two at a time, until all are at right angles."""
    turned = factor.T.copy()  # a row for each column
    size = len(turned)
    tolerance = np.finfo(float).eps * max(size, 1)
    for _ in range(SWEEPS):
        still = False
        for p in range(size - 1):
            for q in range(p + 1, size):
                a, b, c = turned[p] @ turned[p], turned[q] @ turned[q], turned[p] @ turned[q]
                if abs(c) <= tolerance * np.sqrt(a * b):
                    continue
                still = True
                zeta = (b - a) / (2 * c)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, t)
                sine = cosine * t
                turned[p], turned[q] = cosine * turned[p] - sine * turned[q], sine * turned[p] + cosine * turned[q]
        if not still:
            return turned.T
    raise ArithmeticError("the rotations do not settle")


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a covariance, falling, and a unit column for each.

    Of equal eigenvalues the order is that of the columns. A component's largest entry is positive.
    """
    factor, order = pivoted_cholesky(matrix)
    turned = one_sided_jacobi(factor)
    values = (turned**2).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    columns = np.zeros_like(turned)
    columns[order] = turned / np.sqrt(values)
    columns = columns[:, rank]
    if columns.size:
        top = columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])]
        columns = columns * np.where(top < 0, -1.0, 1.0)
    return values[rank], columns


def _valid(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors of ``size`` finite numbers, and these as a matrix of doubles."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(vectors.take(pa.array(rows)))
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    finite = np.isfinite(entries).all(axis=1)
    return rows[finite], entries[finite]


def _whole(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of all entries, as Python's whole numbers where 64 bits do not hold them."""
    scaled = np.floor(SCALE * entries)
    if not scaled.size or np.abs(scaled).max() < _LONG:
        return scaled.astype(np.int64)
    exact = [int(v) if np.isfinite(v) else SCALE * int(c) for v, c in zip(scaled.ravel(), entries.ravel(), strict=True)]
    return np.array(exact, object).reshape(scaled.shape)


def _column_sums(whole: np.ndarray) -> list[int]:
    if whole.dtype != object and np.abs(whole).max(initial=0) * float(len(whole)) < _LONG:
        return [int(v) for v in whole.sum(axis=0)]
    return [sum(map(int, column)) for column in whole.T]


def _products(centred: np.ndarray) -> list[list[int]]:
    """centred.T @ centred, exact: in doubles where every sum fits their 53 bits."""
    if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * len(centred) < _EXACT:
        as_double = centred.astype(float)
        return [[int(v) for v in row] for row in as_double.T @ as_double]
    exact = centred.astype(object)
    return [[int(v) for v in row] for row in exact.T @ exact]


def _summed(size: int):
    """One row a task: the number of vectors and the sums of their entries, as digits."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            _, entries = _valid(batch.column("embedding"), size)
            n += len(entries)
            sums = [a + b for a, b in zip(sums, _column_sums(_whole(entries)), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"]
            )

    return summed


def _scattered(size: int, near: list[int]):
    """One row a task: the scatter around the whole numbers nearest to the means, as digits."""
    middle = np.array(near, object if max(map(abs, near), default=0) >= _LONG else np.int64)

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * size for _ in range(size)]
        found = False
        for batch in batches:
            _, entries = _valid(batch.column("embedding"), size)
            for at in range(0, len(entries), BLOCK):
                found = True
                part = _products(_whole(entries[at : at + BLOCK]) - middle)
                total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(total, part, strict=True)]
        if found:
            digits = [str(v) for row in total for v in row]
            yield pa.RecordBatch.from_arrays([pa.array([digits], pa.list_(pa.string()))], ["scatter"])

    return scattered


def _added(rows: DataFrame, column: str) -> list[int]:
    """The sums over all tasks of lists of digits, place by place; one row a place."""
    places = (
        rows.select(F.posexplode(column).alias("place", "digits"))
        .groupBy("place")
        .agg(F.sum(F.col("digits").cast("decimal(38,0)")).alias("total"))
    )
    return [int(r["total"]) for r in places.orderBy("place").collect()]


def vector_size(vectors: DataFrame) -> int:
    """The length of most vectors, of equally frequent lengths the greatest; 0 without any."""
    row = (
        vectors.where(F.col("embedding").isNotNull())
        .groupBy(F.size("embedding").alias("size"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("size").desc())
        .first()
    )
    return row["size"] if row else 0


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over all valid rows of ``embedding``; None where there are none."""
    size = vector_size(vectors)
    if not size:
        return None
    only = vectors.select("embedding")
    parts = only.mapInArrow(_summed(size), "n long, sums array<string>")
    totals = _added(parts.select(F.concat(F.array(F.col("n").cast("string")), "sums").alias("all")), "all")
    if not totals:
        return None
    n, sums = totals[0], totals[1:]
    near = [(2 * s + n) // (2 * n) for s in sums]
    scatter = _added(only.mapInArrow(_scattered(size, near), "scatter array<string>"), "scatter")
    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    # The mean is off the nearest whole number by rest / n, which leaves this exact term.
    matrix = np.array(
        [[float(Fraction(n * scatter[i * size + j] - rest[i] * rest[j], n * n)) for j in range(size)] for i in range(size)]
    )
    values, columns = eigen(matrix)
    kept = min(components, len(values))
    shifted = [s + n * SHIFT for s in sums]
    return Whitening(n, shifted, columns[:, :kept], values[:kept], float(matrix.trace()))


def _deviation(n: int, whole: np.ndarray, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exact; both without the shift."""
    largest = max(float(np.abs(whole).max(initial=0)) * n, max((abs(float(s)) for s in sums), default=0.0))
    if whole.dtype != object and whole.shape[1] * (2 * largest) ** 2 < _LONG:
        apart = whole * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    return [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in whole.tolist()]


def _project(fit: Whitening, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of the vectors, and the vectors whitened."""
    whole = _whole(entries)
    plain = [s - fit.n * SHIFT for s in fit.sums]
    near = [(2 * s + fit.n) // (2 * fit.n) for s in plain]
    rest = np.array([float(Fraction(s - fit.n * m, fit.n)) for s, m in zip(plain, near, strict=True)])
    middle = np.array(near, object if whole.dtype == object else np.int64)
    centred = (whole - middle).astype(float) - rest
    return whole, centred @ fit.components / np.sqrt(fit.eigenvalues)


def _white_sums(fit: Whitening):
    """One row a task: count, sums and products of whitened vectors, around zero."""
    size, kept = fit.components.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            _, entries = _valid(batch.column("embedding"), size)
            _, white = _project(fit, entries)
            first += white.sum(axis=0)
            second += white.T @ white
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.float64()))], ["sums"])

    return sums


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """The largest entry, in size, of the whitened vectors' covariance minus the identity.

    It is measured on all whitened vectors. Their mean is zero but for rounding, so
    the products are of centred values.
    """
    kept = fit.components.shape[1]
    rows = vectors.select("embedding").mapInArrow(_white_sums(fit), "sums array<double>")
    total = (
        rows.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("total"))
    )
    values = np.array([r["total"] for r in total.orderBy("place").collect()]) / fit.n  # one row a place
    mean = values[:kept]
    covariance = values[kept:].reshape(kept, kept) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(kept)).max())


def _whitened(fit: Whitening, error: float):
    size, kept = fit.components.shape
    plain = [s - fit.n * SHIFT for s in fit.sums]
    explained = fit.eigenvalues / fit.trace

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, entries = _valid(part.column("embedding"), size)
                whole, white = _project(fit, entries)
                m = len(rows)
                apart = pa.array([str(v) for v in _deviation(fit.n, whole, plain)], pa.string())
                every = pa.array(np.repeat(np.arange(m), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(rows)).take(every),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * kept, fit.n, np.int64)),
                        apart.take(every),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * kept, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whitened


_COLUMNS = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every valid row of (vec_id, embedding) on the first components of all of them.

    An entry c becomes x = floor(1024 * c) + 100000. Returns vec_id, component (from 1, by falling
    eigenvalue), n (valid rows), deviation (sum of (n * x - S)^2, exact, as decimal(38,0)), whitened,
    explained (the eigenvalue's share of the trace) and identity_error (one value).

    A row is left out when its vector is null, has a null or non-finite entry, or another length
    than most vectors (of equally frequent lengths the greatest counts). Repeated rows and ids, and
    null ids, are rows of their own. Sums beyond 38 digits raise an error. A covariance of lower rank has fewer components; rows that
    are all equal, a single row and an empty table give no rows. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = fit_whitening(rows, components)
    if fit is None or not len(fit.eigenvalues):
        return rows.sparkSession.createDataFrame([], _COLUMNS).withColumn(
            "deviation", F.col("deviation").cast("decimal(38,0)")
        )
    out = rows.mapInArrow(_whitened(fit, identity_error(rows, fit)), _COLUMNS)
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
