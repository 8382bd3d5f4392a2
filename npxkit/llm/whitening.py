"""Whitened leading components of vectors, by spectrum slicing.

Each component c becomes the whole number floor(256 c). The fit list is each distinct such vector
once; the covariance is taken over it, centred before multiplying, divisor its length.

The spectrum is sliced: the LDL' factors of the covariance less a shift have as many positive
pivots as eigenvalues lie above the shift (inertia), so counts at a few shifts bracket the j-th
largest eigenvalue alone. From its bracket's middle, inverse and then Rayleigh quotient iteration
converges cubically; an iterate that leaves the bracket is thrown away and the bracket halved
again. Counts just below and just above the value found certify that it is the j-th one. Values
closer than rounding are taken as one bracket and their vectors kept orthogonal.

Spark does all work on rows: it finds the distinct vectors, sums them and the centred products
(every task adds its rows to one matrix, these are added row by row), and projects all vectors.
The driver holds one matrix of d x d for each length d of the vectors, at most ``MAX_DIM``.

A vector that is null or holds null or non-finite components is dropped; an empty one has no
components and gives no row. Vectors of different lengths are fitted apart. Repeated rows and null
ids are whitened as they stand. Where a component's eigenvalue is zero to rounding (one vector,
or fewer different ones than components), ``whitened`` is null; ``explained`` is null where all
variance is zero; ``identity_error`` covers the components that have a variance and is null if
there is none. A whole number beyond 64 bits is held at their limit; a ``deviation`` beyond them
is null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

COMPONENTS = 4
SCALE = 256
MAX_DIM = 4096
_LIMIT = float(2**63 - 1024)  # the largest double below 2^63
_BATCH = 4096
_EPS = np.finfo(float).eps


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, negative and zero eigenvalues of a symmetric matrix, from the pivots of its
    LDL' factors (blocks of one or two, with row and column exchanges)."""
    a = np.array(a, dtype=float)
    n = len(a)
    alpha = (1.0 + np.sqrt(17.0)) / 8.0
    signs = [0, 0, 0]

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], :] = a[[j, i], :]
            a[:, [i, j]] = a[:, [j, i]]

    k = 0
    while k < n:
        column = np.abs(a[k + 1 :, k])
        below = column.max(initial=0.0)
        block = 1
        if max(abs(a[k, k]), below) > 0 and abs(a[k, k]) < alpha * below:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest >= alpha * below * below:
                pass
            elif abs(a[r, r]) >= alpha * widest:
                swap(k, r)
            else:
                swap(k + 1, r)
                block = 2
        if block == 1:
            pivot = a[k, k]
            signs[0 if pivot > 0 else 1 if pivot < 0 else 2] += 1
            if pivot != 0 and k + 1 < n:
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c / pivot, c)
        else:
            # Such a block always has one positive and one negative eigenvalue.
            signs[0] += 1
            signs[1] += 1
            if k + 2 < n:
                c = a[k + 2 :, k : k + 2].copy()
                step = c @ np.linalg.inv(a[k : k + 2, k : k + 2]) @ c.T
                a[k + 2 :, k + 2 :] -= (step + step.T) / 2
        k += block
    return signs[0], signs[1], signs[2]


class Slicer:
    """Leading eigenpairs of a symmetric matrix without negative eigenvalues."""

    def __init__(self, v: np.ndarray, seed: int = 0):
        self.v = v
        self.norm = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
        self.near = 8 * _EPS * max(self.norm, np.finfo(float).tiny)
        self.counts: dict[float, int] = {}
        self._rng = np.random.default_rng(seed)

    def above(self, shift: float) -> int:
        """Number of eigenvalues above the shift."""
        if shift not in self.counts:
            self.counts[shift] = inertia(self.v - shift * np.eye(len(self.v)))[0]
        return self.counts[shift]

    def bracket(self, j: int) -> tuple[float, float]:
        """low < high with fewer than j eigenvalues above ``high`` and j or more above ``low``, only the j-th
        between them unless it is within rounding of others."""
        low = max((s for s, c in self.counts.items() if c >= j), default=-self.near)
        high = min((s for s, c in self.counts.items() if c < j), default=self.norm + self.near)
        while high - low > self.near and (self.above(low) > j or self.above(high) < j - 1):
            low, high = self.halved(low, high, j)
        return low, high

    def halved(self, low: float, high: float, j: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= j else (low, middle)

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for wider in (0.0, 1.0, 4.0, 16.0):
            try:
                y = np.linalg.solve(self.v - (shift + wider * self.near) * np.eye(len(x)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y
        return x

    def pair(self, j: int, before: np.ndarray) -> tuple[float, np.ndarray]:
        """The j-th largest eigenvalue and its vector, orthogonal to the rows ``before``."""
        low, high = self.bracket(j)

        def unit(x: np.ndarray) -> np.ndarray:
            x = x / np.abs(x).max()
            for _ in range(2):
                x = x - before.T @ (before @ x)
            return x / np.linalg.norm(x)

        while True:
            x = unit(self._rng.normal(size=len(self.v)))
            shift = (low + high) / 2
            for _ in range(3):  # towards the vectors of the bracket
                x = unit(self._solve(shift, x))
            value = float(x @ self.v @ x)
            for _ in range(12):
                if np.linalg.norm(self.v @ x - value * x) <= len(x) * self.near / 8:
                    break
                x = unit(self._solve(value, x))
                value = float(x @ self.v @ x)
            small = high - low <= self.near
            settled = np.linalg.norm(self.v @ x - value * x) <= len(x) * self.near
            if small or (settled and low - self.near <= value <= high + self.near and self.certified(j, value)):
                return value, x
            low, high = self.halved(low, high, j)

    def certified(self, j: int, value: float) -> bool:
        """Counts beside the value: it is the j-th largest eigenvalue."""
        apart = 2 * len(self.v) * self.near
        return self.above(value + apart) < j <= self.above(value - apart)

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = [], np.zeros((0, len(self.v)))
        for j in range(1, min(k, len(self.v)) + 1):
            value, x = self.pair(j, vectors)
            values.append(max(value, 0.0))
            vectors = np.vstack([vectors, x])
        return np.array(values), vectors


@dataclass
class Fit:
    """The fit of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > 8 * len(self.sums) * _EPS * max(self.trace, 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of whole-number vectors, NaN where there is no variance."""
        scale = np.where(self.has_variance, np.sqrt(self.values, where=self.values > 0, out=np.ones_like(self.values)), np.nan)
        return ((x - self.mean) @ self.axes.T) / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2, None beyond 64 bits."""
        top = self.n * float(np.abs(x).max(initial=0.0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * top * top < 2.0**62:
            apart = self.n * x.astype(np.int64) - np.array(self.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [e if e < 2**63 else None for e in exact]


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, dim) of the rows that remain; x as doubles that are whole numbers."""
    c = F.col("embedding")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fine = vectors.select("vec_id", c.cast("array<double>").alias("embedding")).where(~F.coalesce(bad, F.lit(True)))

    def whole(v):
        big = v * F.lit(float(SCALE))
        held = F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), big))
        # The floor of a double, as a double: beyond 2^52 it is one already.
        return F.when(F.abs(held) < F.lit(2.0**52), F.floor(held).cast("double")).otherwise(held) + F.lit(0.0)

    return fine.select("vec_id", F.transform("embedding", whole).alias("x"), F.size("embedding").alias("dim")).where("dim > 0")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one length at a time, a bounded number."""
    for batch in batches:
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            for begin in range(0, part.num_rows, _BATCH):
                some = part.slice(begin, _BATCH)
                x = some.column(some.schema.get_field_index("x"))
                yield int(dim), x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), some


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    total: dict[int, list[int]] = {}
    for dim, x, _ in _matrices(batches):
        if np.abs(x).max() * len(x) < 2.0**53:
            part = [int(s) for s in x.sum(axis=0)]
        else:
            part = [sum(int(c) for c in column) for column in x.T]
        n[dim] = n.get(dim, 0) + len(x)
        total[dim] = [a + b for a, b in zip(total.get(dim, [0] * dim), part)]
    for dim in n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()), pa.array([Decimal(s) for s in total[dim]], pa.decimal128(38, 0))],
            names=["dim", "place", "n", "s"],
        )


def _products(means: dict[int, np.ndarray]):
    """Rows (dim, place, row) of each task's matrix of centred products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, x, _ in _matrices(batches):
            if dim not in means:
                continue
            apart = x - means[dim]
            total[dim] = total.get(dim, 0.0) + apart.T @ apart
        for dim, v in total.items():
            for begin in range(0, dim, 256):
                rows = v[begin : begin + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(rows), pa.int32()), pa.array(range(begin, begin + len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))],
                    names=["dim", "place", "row"],
                )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of a place, of a partition sorted by place: one array for each."""
    last: tuple[int, int] | None = None
    total: np.ndarray | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["dim", "place", "row"])

    for batch in batches:
        dims, places, rows = (batch.column(batch.schema.get_field_index(c)) for c in ("dim", "place", "row"))
        for at in range(batch.num_rows):
            here = (dims[at].as_py(), places[at].as_py())
            row = rows[at].values.to_numpy(zero_copy_only=False)
            if here != last:
                if last is not None:
                    yield out()
                last, total = here, row.copy()
            else:
                total += row
    if last is not None:
        yield out()


def _spread(fits: dict[int, Fit]):
    """Per task and length: sums of the whitened components and of their products, for the lengths' fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, x, _ in _matrices(batches):
            if dim in fits:
                w = np.nan_to_num(fits[dim].whitened(x))
                total[dim] = total.get(dim, 0.0) + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        for dim, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(t), pa.int32()), pa.array(range(len(t)), pa.int32()), pa.array(t)], names=["dim", "place", "s"])

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fits by vector length, over the distinct vectors of ``rows`` (x, dim)."""
    listed = materialize(rows.select("dim", "x").distinct())
    sums = listed.mapInArrow(_sums, "dim int, place int, n long, s decimal(38,0)").groupBy("dim", "place")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    number: dict[int, int] = {}
    total: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # one row per component of a length
        number[r["dim"]] = r["n"]
        total.setdefault(r["dim"], {})[r["place"]] = int(r["s"])
    wide = [d for d in number if d > MAX_DIM]
    if wide:
        raise ValueError(f"vectors of {max(wide)} components: the covariance is held on the driver up to {MAX_DIM}")
    sums_of = {d: [total[d][i] for i in range(d)] for d in number}
    means = {d: np.array([s / number[d] for s in sums_of[d]], dtype=float) for d in number}
    schema = "dim int, place int, row array<double>"
    parts = listed.mapInArrow(_products(means), schema).repartition("dim", "place").sortWithinPartitions("dim", "place")
    matrix = {d: np.zeros((d, d)) for d in number}
    for dim, place, row in parts.mapInArrow(_added, schema).toLocalIterator():
        matrix[dim][place] = np.array(row) / number[dim]
    fits = {}
    for d in sorted(number):
        v = (matrix[d] + matrix[d].T) / 2
        values, axes = Slicer(v).leading(components)
        fits[d] = Fit(number[d], sums_of[d], values, axes, float(np.trace(v)))
    spread = listed.mapInArrow(_spread(fits), "dim int, place int, s double").groupBy("dim", "place").agg(F.sum("s").alias("s"))
    found: dict[int, dict[int, float]] = {}
    for r in spread.collect():  # a few rows per length
        found.setdefault(r["dim"], {})[r["place"]] = r["s"]
    for d, f in fits.items():
        some = f.has_variance
        if some.any():
            k = len(f.values)
            t = np.array([found[d][i] for i in range(k + k * k)]) / f.n
            cov = t[k:].reshape(k, k) - np.outer(t[:k], t[:k])
            f.identity_error = float(np.abs(cov - np.eye(k))[np.ix_(some, some)].max())
    return fits


def _applied(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, some in _matrices(batches):
            f = fits[dim]
            k = len(f.values)
            w = f.whitened(x).ravel()
            many = len(x) * k
            part = [v / f.trace if f.trace > 0 else None for v in f.values]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(some.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(many, f.n, dtype=np.int64)),
                    pa.array(f.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(part * len(x), pa.float64()),
                    pa.array([f.identity_error] * many, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component."""
    rows = whole_numbers(vectors.withColumn("vec_id", F.col("vec_id").cast("bigint")))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_applied(fit(rows, components)), schema)


def query(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
