"""Embedding whitening: vectors on their principal axes, each axis scaled to variance one.

Entries become whole numbers first, x = floor(SCALE * c) + SHIFT, so that all sums are exact and do not depend on how rows
are dealt. One pass gives the count n, the sums S and the extremes of each dimension; a second the scatter of y = x - m,
m the mean rounded to a whole number, so products are of centred values; the rounding is taken out of the totals exactly:
n * n * V = n * Y'Y - D D' with D = S - n * m. Each task sums its own rows and hands on one number a dimension (or pair of
dimensions), which Spark adds. Only totals come to the driver, whose size is that of the matrix: dimensions squared.

There jacobi() turns the covariance matrix V by plane rotations, all pairs of axes in each sweep, in rounds of disjoint
pairs, until every entry off the diagonal is below rounding beside its two diagonal ones. Measured so, and not by the largest
entry, small eigenvalues of positive definite matrices come out to full relative precision. The whitening matrix, a
vector for each component, is broadcast; its size is dimensions times components. Whitened values are written, and their
covariance is taken from what was written.

Defined results: a vector that is null, empty, or holds null or non-finite entries is left out; vectors of different lengths
are an error, as are entries whose x is beyond a long; null and repeated ids are kept, row by row; components whose
eigenvalue is zero beside rounding have no whitened value and are left out, so equal vectors, or a single one, give an
empty result, as an empty table does; of equal eigenvalues the one of the smaller axis comes first; an eigenvector's
largest entry is positive; deviations are exact decimals; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.operators.storage import materialise

from .batches import bound_batches, fresh, struct_of

SCALE, SHIFT = 1024, 100_000
SWEEPS = 60
#: Rows whose scatter is taken at once.
ROWS = 1 << 12
_EXACT, _LONG = 1 << 53, 1 << 63


def usable(vector: str) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def whole(vectors: pa.Array) -> np.ndarray:
    """x of each entry, a row for each vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry is beyond a long")
    return scaled.astype(np.int64).reshape(len(vectors), -1) + SHIFT


@dataclass(frozen=True)
class Totals:
    """Over all vectors: their number, and the sum, smallest and largest x of each dimension."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    @property
    def centre(self) -> list[int]:
        """The means, rounded to whole numbers."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def reach(self) -> int:
        """The largest |y|."""
        return max(max(h - m, m - w) for m, w, h in zip(self.centre, self.low, self.high, strict=True))


def totals(vectors: DataFrame) -> Totals | None:
    """Totals of the column v; None without rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(0))
            if sums is not None and x.shape[1] != len(sums):
                raise ValueError(f"vectors of different lengths: {[len(sums), x.shape[1]]}")
            least, most = x.min(0), x.max(0)
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
            add = x.sum(0) if len(x) * max(abs(int(least.min())), abs(int(most.max()))) < _LONG else x.astype(object).sum(0)
            sums = add.astype(object) if sums is None else sums + add
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]]), pa.array([low.tolist()]), pa.array([high.tolist()])], ["n", "sums", "low", "high"])

    parts = vectors.mapInArrow(work, "n long, sums array<string>, low array<long>, high array<long>")
    each = parts.select("n", F.posexplode(F.arrays_zip("sums", "low", "high")).alias("at", "x"))
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("x.sums").cast("decimal(38,0)")).alias("sum"), F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r["at"])
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return Totals(found[0]["n"], [int(r["sum"]) for r in found], [r["low"] for r in found], [r["high"] for r in found])


def scatter(vectors: DataFrame, t: Totals) -> np.ndarray:
    """Y'Y of the column v, as Python's whole numbers."""
    d, centre, reach = len(t.sums), t.centre, t.reach()
    upper = np.triu_indices(d)
    # sums of so many products are exact as doubles
    rows = max(1, min(ROWS, _EXACT // max(1, reach * reach)))
    exact = reach * reach < _EXACT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = whole(batch.column(0)) - np.array(centre, np.int64) if batch.num_rows else []
            for i in range(0, len(y), rows):
                part = y[i : i + rows]
                part = part.astype(np.float64) if exact else part.astype(object)
                product = (part.T @ part)[upper]
                product = product.astype(np.int64) if exact else product
                fits = total is None or (exact and total.dtype == np.int64 and np.abs(total).max() < _LONG - _EXACT)
                total = product if total is None else total + product if fits else total.astype(object) + product.astype(object)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[str(s) for s in total.tolist()]])], ["products"])

    parts = vectors.mapInArrow(work, "products array<string>").select(F.posexplode("products").alias("at", "product"))
    found = parts.groupBy("at").agg(F.sum(F.col("product").cast("decimal(38,0)")).alias("sum")).collect()  # a row for each pair of dimensions
    out = np.zeros((d, d), object)
    for r in found:
        i, j = int(upper[0][r["at"]]), int(upper[1][r["at"]])
        out[i, j] = out[j, i] = int(r["sum"])
    return out


def covariance(products: np.ndarray, t: Totals) -> np.ndarray:
    """V, each entry rounded once."""
    shift = [s - t.n * m for s, m in zip(t.sums, t.centre, strict=True)]
    d, square = len(shift), t.n * t.n
    return np.array([[(t.n * products[i, j] - shift[i] * shift[j]) / square for j in range(d)] for i in range(d)], np.float64)


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d axes, in rounds of disjoint pairs (each axis in turn stands still, the others move round it)."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < d]
        out.append((np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix without negative eigenvalues, by cyclic rotations."""
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors, rounds = np.eye(d), _rounds(d)
    floor = np.finfo(float).eps * np.finfo(float).eps * np.abs(np.diag(a)).max(initial=0.0)
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            some = np.abs(apq) > np.maximum(np.finfo(float).eps * np.sqrt(np.abs(app * aqq)), floor)
            if not some.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[some], q[some], app[some], aqq[some], apq[some]
            tau = (aqq - app) / (2 * apq)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            # what the rotation gives exactly
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
            cols_p, cols_q = vectors[:, p], vectors[:, q]
            vectors[:, p], vectors[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
        if not turned:
            return np.diag(a).copy(), vectors
    raise RuntimeError(f"rotations did not settle in {sweeps} sweeps")


@dataclass(frozen=True)
class Axes:
    """Components by falling eigenvalue: values, unit vectors (a column each), and the trace of the covariance."""

    totals: Totals
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def principal_axes(docs: DataFrame, vector: str, components: int) -> Axes | None:
    """None without usable rows."""
    own = docs.where(usable(vector)).select(F.col(f"`{vector}`").alias("v"))
    t = totals(own)
    if t is None:
        return None
    v = covariance(scatter(own, t), t)
    values, vectors = jacobi(v)
    order = np.argsort(-values, kind="stable")
    some = [i for i in order[:components] if values[i] > len(values) * np.finfo(float).eps * values[order[0]]]
    chosen = vectors[:, some]
    if len(some):
        chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), np.arange(len(some))])
    return Axes(t, values[some], chosen, float(np.trace(v)))


def _deviations(y: np.ndarray, n: int, shift: list[int], reach: int) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 for each row, in whole numbers."""
    most = max(map(abs, shift))
    fits = y.shape[1] * max(reach, 1) * max(reach, most, 1) < _LONG
    y = y if fits else y.astype(object)
    squares, mixed = (y * y).sum(1).tolist(), (y * np.array(shift, y.dtype)).sum(1).tolist()
    own = sum(s * s for s in shift)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed, strict=True)]


def whitened_vectors(docs: DataFrame, vector: str, axes: Axes, keep: list[str]) -> DataFrame:
    """The kept columns, deviation (exact) and whitened (a value for each component) of each usable row."""
    spark, t = docs.sparkSession, axes.totals
    bound_batches(spark)
    name = fresh(docs, "_v")
    rows = docs.where(usable(vector)).select(*keep, F.col(f"`{vector}`").alias(name))
    centre, reach, n = t.centre, t.reach(), t.n
    shift = [s - n * m for s, m in zip(t.sums, centre, strict=True)]
    matrix = spark.sparkContext.broadcast(axes.vectors / np.sqrt(axes.values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                y = whole(part.column(name)) - np.array(centre, np.int64)
                out = (y - np.array([s / n for s in shift])) @ matrix.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                deviation = pa.array([str(x) for x in _deviations(y, n, shift, reach)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), deviation, lists], [*keep, "deviation", "whitened"])

    found = rows.mapInArrow(work, struct_of(docs, keep, ("deviation", "string"), ("whitened", "array<double>")))
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of the column whitened minus the identity."""
    w = lambda i: F.col("whitened")[i]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(found, pairs, strict=True))


def whiten(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error for each usable row and component."""
    axes = principal_axes(docs, vector, components)
    some = 0 if axes is None else len(axes.values)
    if not some:
        kind = struct_of(docs, [key], ("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), *((c, "double") for c in ("whitened", "explained", "identity_error")))
        return docs.sparkSession.createDataFrame([], kind)
    found = materialise(whitened_vectors(docs, vector, axes, [key]), "whitened")
    error = identity_error(found, some)
    explained = F.array(*[F.lit(float(e / axes.trace)) for e in axes.values])
    each = found.select(key, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        key,
        (F.col("_at") + 1).alias("component"),
        F.lit(axes.totals.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("_at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
