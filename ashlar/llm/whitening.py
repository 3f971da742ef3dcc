"""Embedding whitening: an exact distributed scatter, and cyclic Jacobi rotations on the driver.

Components become integers, so that sums and the scatter around integer centres
are exact whatever the order in which tasks add: the covariance is one correctly
rounded division of integers, with no cancellation. Integers that may exceed 64 bits
travel as two limbs of 32 bits and more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

SCALE, SHIFT = 1024, 100_000
#: Components that are returned.
TOP = 8
#: First-level groups in which the partial sums of tasks are added.
PARTS = 32
#: Vectors multiplied at a time.
BLOCK = 4096
#: A component counts as without variance below this share of the trace, times the dimension.
NO_VARIANCE = 2.0**-48
LONG = 2**63 - 1
#: Entries from here on do not become longs.
BEYOND = float(2**63 - 2**18)


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty, and holds only finite entries that become longs."""
    scaled = f"abs({SCALE} * cast(x as double))"
    return F.expr(f"coalesce(size(`{vector}`) > 0 and forall(`{vector}`, x -> coalesce({scaled} < {BEYOND!r}D, false)), false)")


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as integers, one after another, and their lengths (usable vectors only)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT, np.diff(column.offsets.to_numpy())


def limbs(values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Integers of any size as high and low limbs."""
    whole = values.ravel().astype(object)
    return pa.array([int(v) >> 32 for v in whole], pa.int64()), pa.array([int(v) & 0xFFFFFFFF for v in whole], pa.int64())


def whole(high: list[int], low: list[int]) -> np.ndarray:
    return np.array([(int(h) << 32) + int(x) for h, x in zip(high, low)], object)


class Sum:
    """A growing exact sum of integer matrices: in longs while they are sure to hold it."""

    def __init__(self, shape: tuple[int, ...]):
        self.total, self.part, self.room = np.zeros(shape, object), np.zeros(shape, np.int64), LONG

    def add(self, matrix: np.ndarray, bound: int) -> None:
        """``bound``: no entry of ``matrix`` is larger."""
        if bound > self.room:
            self.total, self.part, self.room = self.total + self.part.astype(object), np.zeros_like(self.part), LONG
        if bound > self.room:
            self.total = self.total + matrix.astype(object)
        else:
            self.part += matrix.astype(np.int64)
            self.room -= bound

    def value(self) -> np.ndarray:
        return self.total + self.part.astype(object)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Length and matrix of the vectors of each batch, by length."""
    for batch in batches:
        flat, size = integers(batch.column(0))
        start = np.cumsum(size) - size
        for d in np.unique(size):
            yield int(d), flat[start[size == d][:, None] + np.arange(d)]


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every length of vectors of a task: how many, and their sums."""
    found: dict[int, tuple[list[int], Sum]] = {}
    for d, rows in _by_length(batches):
        count, total = found.setdefault(d, ([0], Sum((d,))))
        count[0] += len(rows)
        total.add(rows.sum(axis=0) if int(np.abs(rows).max()) * len(rows) <= LONG else rows.astype(object).sum(axis=0), int(np.abs(rows).max()) * len(rows))
    for d, (count, total) in found.items():
        yield _partial(d, count[0], total.value())


PARTIAL = "place int, n long, high array<long>, low array<long>"


def _partial(place: int, n: int, values: np.ndarray) -> pa.RecordBatch:
    high, low = limbs(values)
    one = pa.array([0, len(high)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(one, high), pa.ListArray.from_arrays(one, low)], ["place", "n", "high", "low"])


def _add(table: pa.Table) -> pa.Table:
    """One row for the rows of one place."""
    rows, d = table.num_rows, len(table["high"][0])
    high, low = (table[c].combine_chunks().flatten().to_numpy().reshape(rows, d).sum(axis=0) for c in ("high", "low"))
    carried = high + (low >> 32), low & 0xFFFFFFFF
    one = pa.array([0, d], pa.int32())
    return pa.table([table["place"][:1], pa.array([int(table["n"].to_numpy().sum())], pa.int64()), *(pa.ListArray.from_arrays(one, pa.array(x)) for x in carried)], names=["place", "n", "high", "low"])


def added(partials: DataFrame) -> DataFrame:
    """The partial sums of tasks added by place, in two levels: no task reads what all tasks have sent."""
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    some = partials.select("*", part).groupBy("place", "part").applyInArrow(lambda t: _add(t), PARTIAL)
    return some.groupBy("place").applyInArrow(lambda t: _add(t), PARTIAL)


def gram(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """The exact sum of the outer products of a block's rows, and a bound of its entries."""
    most = int(np.abs(rows).max(initial=0))
    bound = most * most * len(rows)
    if bound < 2**53:
        real = rows.astype(np.float64)
        return real.T @ real, bound
    return rows.astype(object).T.dot(rows.astype(object)), bound


def _scatter_batches(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Sum((len(centre), len(centre))), 0
        for d, rows in _by_length(batches):
            if d != len(centre):
                continue
            for at in range(0, len(rows), BLOCK):
                block = rows[at : at + BLOCK] - centre
                total.add(*gram(block))
                n += len(block)
        if n:
            for place, row in enumerate(total.value()):
                yield _partial(place, n, row)

    return run


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; largest entry positive) of a symmetric matrix by cyclic Jacobi.

    A sweep meets every pair once, in rounds of disjoint pairs, so that a round is a
    few vector operations. A pair is rotated until its entry is negligible beside
    *its own* diagonal entries, which is what keeps small eigenvalues accurate.
    """
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    v = np.eye(d)
    seats = np.arange(d + d % 2)
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        rotated = 0
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]), np.maximum(seats[: len(seats) // 2], seats[::-1][: len(seats) // 2])
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            p, q = p[q < d], q[q < d]
            off = a[p, q]
            turn = np.abs(off) > tiny * np.sqrt(np.abs(a[p, p] * a[q, q]))
            turn &= np.abs(off) > np.finfo(float).tiny
            p, q, off = p[turn], q[turn], off[turn]
            if not len(p):
                continue
            rotated += len(p)
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            rows = a[p], a[q]
            a[p], a[q] = c[:, None] * rows[0] - s[:, None] * rows[1], s[:, None] * rows[0] + c[:, None] * rows[1]
            columns = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * columns[0] - s * columns[1], s * columns[0] + c * columns[1]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = diagonal
            columns = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * columns[0] - s * columns[1], s * columns[0] + c * columns[1]
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], v[:, order]
    sign = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values, vectors * sign


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of the fit, their ``sums``, ``matrix`` (dimension x components; a component without variance is zero) and each component's share of the variance."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        most = max(int(np.abs(rows).max(initial=0)) * self.n, max((abs(int(s)) for s in self.sums), default=0))
        if 2 * most <= LONG:
            return rows * np.int64(self.n) - self.sums.astype(np.int64)
        return rows.astype(object) * self.n - self.sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.matrix


def fit(vectors: DataFrame, vector: str, top: int = TOP) -> Whitening | None:
    """Two passes: counts and sums by length of vectors; the scatter of the most frequent length (of several the longest). None without vectors."""
    held = vectors.where(usable(vector)).select(vector)
    sums = added(held.mapInArrow(_sum_batches, PARTIAL)).orderBy(F.col("n").desc(), F.col("place").desc()).first()
    if sums is None:
        return None
    n, total = sums["n"], whole(sums["high"], sums["low"])
    centre = np.array([int(s) // n for s in total], np.int64)
    rows = added(held.where(F.size(vector) == len(centre)).mapInArrow(_scatter_batches(centre), PARTIAL)).orderBy("place").collect()
    scatter = np.array([whole(r["high"], r["low"]) for r in rows], object)
    rest = total - centre.astype(object) * n
    covariance = np.array((scatter * n - np.outer(rest, rest)) / (n * n), np.float64)
    values, axes = jacobi(covariance)
    trace = float(np.trace(covariance))
    values, axes = values[:top], axes[:, :top]
    varies = values > NO_VARIANCE * len(centre) * trace
    matrix = np.where(varies, axes / np.sqrt(np.where(varies, values, 1)), 0)
    return Whitening(n, total, matrix, np.maximum(values, 0) / trace if trace else np.zeros(len(values)))


def identity_error(vectors: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance, from the vectors themselves."""
    size = model.matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, rows in _by_length(batches):
            for at in range(0, len(rows), BLOCK):
                white = model.whitened(model.deviations(rows[at : at + BLOCK]))
                total += white.T @ white
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = vectors.where(usable(vector) & (F.size(vector) == len(model.sums))).select(vector).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    varies = model.matrix.any(axis=0)
    return max((abs(r["v"] / model.n - (r["i"] == r["j"])) for r in sums if varies[r["i"]] and varies[r["j"]]), default=0.0)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every usable row of ``rows``.

    Rows whose vector is null, empty, or holds null, not finite entries or such as do
    not become longs take no part. Vectors of several lengths: those of the most
    frequent one (of several the longest) are fitted and returned. Repeated rows and
    null keys are rows like others. A component without variance (one vector, equal
    vectors, fewer vectors than dimensions) is 0 in every row and takes no part in
    identity_error. A deviation that exceeds a long is null. There are as many
    components as dimensions, ``top`` at most. An empty table gives an empty result.
    """
    tune(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, vector, top)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector, model)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        size = own.matrix.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, _ = integers(batch.column(1))
            away = own.deviations(flat.reshape(batch.num_rows, -1))
            white = own.whitened(away)
            wide = away.dtype == object or int(np.abs(away).max()) ** 2 * away.shape[1] > LONG
            square = (away.astype(object) if wide else away) ** 2
            deviation = [int(x) if x <= LONG else None for x in square.sum(axis=1)]
            each = pa.array(np.repeat(np.arange(batch.num_rows), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(each), own.n)),
                    pa.array(deviation, pa.int64()).take(each), pa.array(white.ravel()), pa.array(np.tile(own.explained, batch.num_rows)), pa.array(np.full(len(each), error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(usable(vector) & (F.size(vector) == len(model.sums))).select(key, vector).mapInArrow(run, schema)
