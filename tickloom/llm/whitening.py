r"""Embedding whitening by spectrum slicing.

Tasks sum the vectors and the products of the centred vectors exactly, in whole numbers; the driver gets one matrix of
``dims * dims`` sums, whatever the number of vectors. There the number of positive pivots of an LDLᵀ factorisation of the
covariance minus a shift counts the eigenvalues above the shift (inertia). Bisection by such counts gives every leading
eigenvalue an interval of its own, Rayleigh quotient iteration finds it and its vector from there, and counts just
below and just above certify its number. Tasks then project the centred vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.workers import ship, tidied
from tickloom.session import written

COMPONENTS = 32
#: The covariance is the one thing that comes to the driver: dims * dims numbers.
MAX_DIMS = 2048
SCALE, SHIFT = 64, 1_000_000
_EXACT = 1 << 53
_EPS = float(np.finfo(float).eps)
_PIVOT = (1 + math.sqrt(17)) / 8
_SUMS = "i int, j int, s decimal(38,0)"


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, x`` of the rows whose vector has entries, none of them null, infinite or no number."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, own in enumerate(batch.column(1)):
                if not own.is_valid or not len(own.values) or own.values.null_count:
                    continue
                entries = own.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(entries).all():
                    continue
                scaled = np.floor(entries * SCALE)
                if np.abs(scaled).max() >= _EXACT:
                    raise OverflowError("an entry is too large for a whole number")
                rows.append(i)
                found.append(scaled.astype(np.int64) + SHIFT)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["key", "x"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("x", T.ArrayType(T.LongType()))])
    return df.select(df[key].alias("key"), df[vector].alias("vector")).mapInArrow(tidied(convert), schema)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact_products(z: np.ndarray) -> np.ndarray:
    """Sums of products of all columns, exact: blocks of rows in which no sum passes 2**53."""
    most = int(np.abs(z).max(initial=0)) ** 2
    if most >= _EXACT:
        own = z.astype(object)
        return own.T @ own
    rows = _EXACT // max(1, most)
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for begin in range(0, len(z), rows):
        block = z[begin : begin + rows].astype(float)
        total = total + (block.T @ block).astype(np.int64)
    return total


def _sums(vectors: DataFrame, dims: int, centre: np.ndarray, products: bool) -> dict[tuple[int, int], int]:
    """Sums over all rows of ``x - centre`` (at ``(i, -1)``) and of its products; the count at ``(-1, -1)``."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first = 0, np.zeros(dims, object)
        second = np.zeros((dims, dims), object)
        for batch in batches:
            z = _matrix(batch.column(0), dims) - centre
            count += len(z)
            first = first + z.sum(axis=0) if np.abs(z).max(initial=0) < 1 << 40 else first + z.astype(object).sum(axis=0)
            if products:
                second = second + _exact_products(z)
        if count:
            i, j = np.triu_indices(dims) if products else (np.empty(0, int), np.empty(0, int))
            numbers = [count, *first.tolist(), *second[i, j].tolist()]
            at = [[-1, *range(dims), *i.tolist()], [-1] * (dims + 1) + j.tolist()]
            columns = [pa.array(own, pa.int32()) for own in at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(Decimal, numbers), pa.decimal128(38, 0))], ["i", "j", "s"])

    parts = vectors.select("x").mapInArrow(tidied(add_up), _SUMS)
    return {(row.i, row.j): int(row.s) for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator()}


def covariance(n: int, dims: int, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance with divisor n; every entry is the exact fraction, rounded once."""
    result = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            result[i, j] = result[j, i] = (n * sums[i, j] - sums[i, -1] * sums[j, -1]) / (n * n)
    return result


def positive_pivots(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: inertia of its LDLᵀ factorisation with Bunch-Kaufman pivots."""
    a = matrix.copy()
    positive = 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while len(a):
        below = np.abs(a[1:, 0])
        most = below.max(initial=0.0)
        wide = False
        if abs(a[0, 0]) < _PIVOT * most:
            r = int(below.argmax()) + 1
            row = np.abs(a[r])
            row[r] = 0
            if abs(a[0, 0]) * row.max() < _PIVOT * most * most:
                wide = abs(a[r, r]) < _PIVOT * row.max()
                swap(int(wide), r)
        if wide:
            pivot, side = a[:2, :2], a[2:, :2]
            # Such a pivot has a negative determinant: one eigenvalue of either sign.
            positive += 1
            a = a[2:, 2:] - side @ np.linalg.solve(pivot, side.T)
        else:
            pivot, side = a[0, 0], a[1:, 0]
            positive += int(pivot > 0)
            a = a[1:, 1:] - np.outer(side, side) / pivot if pivot else a[1:, 1:]
    return positive


def leading_components(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; those that are zero to double precision are left out.

    Eigenvalues too close for any shift between them share an interval; their vectors are an orthogonal basis of it.
    """
    dims = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    least = 8 * dims * _EPS * size
    if size == 0:
        return np.empty(0), np.empty((dims, 0))
    above = lambda shift: positive_pivots(matrix - shift * np.eye(dims))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # Intervals (low, high] with the counts above either end, highest on top.
    intervals = [(least, size * (1 + 4 * _EPS), above(least), 0)]
    while intervals and len(values) < count:
        low, high, from_low, from_high = intervals.pop()
        within = from_low - from_high
        if not within:
            continue
        middle = (low + high) / 2
        if within == 1 and high - low > least:
            found = _iterated(matrix, low, high, vectors, least)
            if found is not None:
                values.append(found[0])
                vectors.append(found[1])
                continue
        if high - low > least:
            from_middle = above(middle)
            intervals += [(low, middle, from_low, from_middle), (middle, high, from_middle, from_high)]
        else:
            for value, vector in _cluster(matrix, middle, within, vectors, least):
                values.append(value)
                vectors.append(vector)
    values, vectors = values[:count], vectors[:count]
    for number, value in enumerate(values, 1):
        if not above(value + 2 * least) < number <= above(value - 2 * least):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the inertia counts")
    return np.array(values), np.array(vectors).reshape(-1, dims).T


def _apart(x: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    for vector in vectors:
        x = x - (vector @ x) * vector
    return x / np.linalg.norm(x)


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray, least: float) -> np.ndarray:
    try:
        y = np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(matrix - (shift + least / 8) * np.eye(len(matrix)), x)
    return y / np.linalg.norm(y)


def _start(dims: int, number: int) -> np.ndarray:
    return np.random.default_rng(number).standard_normal(dims)


def _iterated(matrix: np.ndarray, low: float, high: float, vectors: list[np.ndarray], least: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue in (low, high]; None if it leaves the interval."""
    x = _apart(_start(len(matrix), len(vectors)), vectors)
    for _ in range(2):
        x = _apart(_solved(matrix, (low + high) / 2, x, least), vectors)
    value, rest = float(x @ matrix @ x), math.inf
    for _ in range(12):
        if not low < value <= high:
            return None
        y = _apart(_solved(matrix, value, x, least), vectors)
        new = float(y @ matrix @ y)
        left = float(np.linalg.norm(matrix @ y - new * y))
        if left >= rest:
            break
        x, value, rest = y, new, left
    return (value, x) if rest <= least and low < value <= high else None


def _cluster(matrix: np.ndarray, middle: float, count: int, before: list[np.ndarray], least: float) -> list[tuple[float, np.ndarray]]:
    """An orthogonal basis for eigenvalues that lie within rounding of one another, by inverse iteration beside those found."""
    found: list[np.ndarray] = []
    for k in range(count):
        x = _apart(_start(len(matrix), 1000 + len(before) + k), [*before, *found])
        for _ in range(6):
            x = _apart(_solved(matrix, middle, x, least), [*before, *found])
        found.append(x)
    return sorted(((float(x @ matrix @ x), x) for x in found), key=lambda pair: -pair[0])


def whitened_embeddings(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per remaining row and component: key, ``component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or empty, or holds nulls, infinities or NaN, are left out, and of vectors of several lengths
    those of the most frequent one remain (the longer of equally frequent ones). An entry c becomes
    ``x = floor(64 * c) + 1000000``. ``n`` vectors with sums S remain; ``deviation`` is the sum of ``(n * x - S) ** 2``, exact;
    ``whitened`` is ``x - S / n`` on the unit eigenvector, over the root of its eigenvalue; ``explained`` its share of the
    trace; ``identity_error`` the largest entry of the whitened vectors' covariance minus the identity, measured in another
    pass. Directions without variance cannot be whitened and give no component, so equal vectors alone give no rows.
    Rows that repeat and rows with a null key count as any other. Other columns are not read.
    """
    ship(df.sparkSession)
    every = written(whole_vectors(df, key, vector), "vectors")
    by_size = every.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = by_size.dims if by_size else 1
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are supported")
    vectors = every.filter(F.size("x") == dims)
    totals = _sums(vectors, dims, np.full(dims, SHIFT, np.int64), products=False)
    n = totals.get((-1, -1), 0)
    sums = [totals.get((i, -1), 0) + n * SHIFT for i in range(dims)]
    centre = np.array([(2 * s + n) // (2 * n) if n else 0 for s in sums], np.int64)
    values, axes = np.empty(0), np.empty((dims, 0))
    trace = 0.0
    if n:
        matrix = covariance(n, dims, _sums(vectors, dims, centre, products=True))
        values, axes = leading_components(matrix, components)
        trace = float(np.trace(matrix))
    rest = [s - n * c for s, c in zip(sums, centre.tolist())]
    project = Projection(n, centre, rest, axes / np.sqrt(values))
    error = _identity_error(vectors, dims, project) if len(values) else 0.0
    shares = values / trace if trace else values

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(values)
        for batch in batches:
            exact = project.exact(_matrix(batch.column(1), dims))
            deviation = project.deviations(exact)
            rows = np.repeat(np.arange(batch.num_rows), width)
            columns = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), batch.num_rows)),
                pa.array(deviation[rows]),
                pa.array(project.whitened(exact).reshape(-1)),
                pa.array(np.tile(shares, batch.num_rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "deviation", "whitened", "explained"])

    schema = T.StructType([every.schema["key"], *T.StructType.fromDDL("component int, deviation bigint, whitened double, explained double").fields])
    found = vectors.select("key", "x").mapInArrow(tidied(spread), schema)
    return found.select(
        F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )


class Projection:
    """Centred vectors and their projections; ``n * x - S`` is exact."""

    def __init__(self, n: int, centre: np.ndarray, rest: list[int], axes: np.ndarray) -> None:
        self.n, self.centre, self.rest, self.axes = n, centre, rest, axes

    def exact(self, x: np.ndarray) -> np.ndarray:
        z = x - self.centre
        if int(np.abs(z).max(initial=0)) * self.n + self.n < 1 << 62:
            return z * self.n - np.array(self.rest, np.int64)
        return z.astype(object) * self.n - np.array(self.rest, object)

    def deviations(self, exact: np.ndarray) -> np.ndarray:
        most = int(np.abs(exact).max(initial=0))
        if most * most * exact.shape[1] < 1 << 63:
            return (exact.astype(np.int64) ** 2).sum(axis=1)
        found = [sum(int(v) ** 2 for v in row) for row in exact]
        if max(found) >= 1 << 63:
            raise OverflowError("a deviation is too large for a long")
        return np.array(found, np.int64)

    def whitened(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(float) @ self.axes


def _identity_error(vectors: DataFrame, dims: int, project: Projection) -> float:
    """Largest entry of the covariance of all whitened vectors minus the identity."""
    width = project.axes.shape[1]
    i, j = np.triu_indices(width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = project.whitened(project.exact(_matrix(batch.column(0), dims)))
            first += w.sum(axis=0)
            second += w.T @ w
        at = [[*range(width), *i.tolist()], [-1] * width + j.tolist()]
        columns = [pa.array(own, pa.int32()) for own in at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([*first, *second[i, j]])], ["i", "j", "s"])

    parts = vectors.select("x").mapInArrow(tidied(add_up), "i int, j int, s double")
    sums = {(row.i, row.j): row.s for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator()}
    n = project.n
    return max(abs(sums[a, b] / n - sums[a, -1] * sums[b, -1] / n / n - (a == b)) for a, b in zip(i.tolist(), j.tolist()))
