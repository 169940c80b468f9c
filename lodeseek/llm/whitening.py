"""Whitening of embeddings by a one-sided Jacobi SVD of the triangular factor of all rows.

A vector's entries become integers (``SCALE`` times the entry, rounded down, plus
``SHIFT``), so sums and deviations are exact. Rows are centred before anything is
multiplied, and no covariance matrix is formed: each task compresses its centred rows
block by block to a triangular factor R (TSQR), and the tasks' factors are merged in a
tree of small groups. Plane rotations then make the columns of the last R orthogonal;
their norms over the root of n are the standard deviations along the components, which
are the product of the rotations. What reaches the driver are sums and one R of
dims * dims numbers.

Vectors that are null or empty, or hold null or non-finite entries, are dropped. Vectors
of unlike lengths are fitted apart, each length by itself; there is a model of dims * dims
numbers for each. Entries beyond ``BOUND`` in size count as ``BOUND``. A component along
which the rows don't vary has null for whitened; explained is null where no component has
any variance. Rows with equal or null keys are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Largest size of an entry; beyond it counts as this.
BOUND = float(1 << 30)
#: Rows that are brought to a triangular factor at once, at least (and twice the length of a vector).
BLOCK = 4096
#: Factors of tasks that are merged at once.
FAN = 32

_PART = "dims int, id long, part binary"


def _clean(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, x): vectors as integers."""
    inside = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(embedding, lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double"))) * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & inside).select(F.col(key).alias("key"), x.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, their integers) for each length in the batch."""
    lists = batch.column("x")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


class Centre:
    """n and S of the vectors of one length, and rows without their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]  # S is n * whole + rest
        self.fraction = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, exactly."""
        y = x - self.whole
        largest, dims = int(np.abs(y).max(initial=0)), y.shape[1]
        if max(largest, self.n).bit_length() + largest.bit_length() + dims.bit_length() > 62:
            y = y.astype(object)
        squares, products = (y * y).sum(1), (y * np.array(self.rest, y.dtype)).sum(1)
        least = sum(r * r for r in self.rest)
        return [self.n * self.n * a - 2 * self.n * b + least for a, b in zip(squares.tolist(), products.tolist(), strict=True)]


def _centres(rows: DataFrame) -> dict[int, Centre]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in _matrices(batch):
                n, s = found.get(d, (0, 0))
                found[d] = [n + len(rows), s + x.sum(0)]
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s)], names=["dims", "i", "n", "s"])

    each = rows.mapInArrow(sums, "dims int, i int, n long, s long")
    total = each.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dims", "i").collect()
    by: dict[int, list] = {}
    for r in total:
        by.setdefault(r.dims, []).append(r)
    return {d: Centre(some[0].n, [int(r.s) for r in some]) for d, some in by.items()}


def _tree(rows: DataFrame, leaf: Callable, merge: Callable) -> dict[int, np.ndarray]:
    """One array for each length: ``leaf`` (of a task's batches: pairs of length and array), merged in groups of ``FAN``."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for d, part in leaf(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([task], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["dims", "id", "part"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, parts = key[0].as_py(), sorted((i, p) for b in batches for i, p in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), strict=True))
        part = merge(d, [np.frombuffer(p) for _, p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["dims", "id", "part"])

    low = cut(rows.mapInArrow(leaves, _PART))
    top, level = low.agg(F.max("id")).first()[0] or 0, low
    while True:
        level = level.groupBy("dims", F.expr(f"id div {FAN}").alias("at")).applyInArrow(merged, _PART)
        top //= FAN
        if not top:
            break
    out = {r.dims: np.frombuffer(r.part) for r in level.collect()}
    release(low)
    return out


def _factors(rows: DataFrame, centres) -> dict[int, np.ndarray]:
    """The triangular factor of all centred rows of each length."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                some = held.setdefault(d, [])
                some.append(centres.value[d].rows(x))
                if sum(map(len, some)) >= max(BLOCK, 2 * d):
                    held[d] = [np.linalg.qr(np.vstack(some), "r")]
        for d, some in held.items():
            yield d, np.linalg.qr(np.vstack(some), "r")

    def merge(d: int, parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack([p.reshape(-1, d) for p in parts]), "r")

    return {d: r.reshape(-1, d) for d, r in _tree(rows, leaf, merge).items()}


def jacobi(r: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) by plane rotations of the columns of ``r``.

    Pairs of columns are rotated until all are orthogonal to rounding; the pairs of a
    round have no column in common and are rotated together. Each vector's entry of the
    largest size is positive.
    """
    dims = r.shape[1]
    a, v = r.astype(np.float64), np.eye(dims)
    ring = np.arange(dims + dims % 2)
    half = len(ring) // 2
    tiny = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[:half], ring[: half - 1 : -1]
            some = (p < dims) & (q < dims)
            p, q = np.minimum(p, q)[some], np.maximum(p, q)[some]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > tiny * np.sqrt(xx * yy)
            if on.any():
                turned = True
                p, q, x, y = p[on], q[on], x[:, on], y[:, on]
                with np.errstate(over="ignore"):  # then there is nothing to turn: t is 0
                    zeta = (yy[on] - xx[on]) / (2 * xy[on])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[order], v[:, order]
    return sigma, v * np.where(v[np.abs(v).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)


class Whitener:
    """The whitening of the vectors of one length."""

    def __init__(self, centre: Centre, r: np.ndarray, components: int):
        sigma, v = jacobi(r)
        k = min(components, len(sigma))
        varies = sigma[:k] > sigma[0] * len(sigma) * np.finfo(float).eps
        self.centre, self.n, self.varies = centre, centre.n, varies
        self.deviation = sigma[:k] / np.sqrt(centre.n)
        self.scaled = v[:, :k] / np.where(varies, self.deviation, 1.0)
        total = (sigma * sigma).sum()
        self.explained = (sigma[:k] ** 2 / total).tolist() if total > 0 else [None] * k
        self.identity_error: float | None = None

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.scaled


def _measure(rows: DataFrame, models) -> dict[int, np.ndarray]:
    """Of the whitened rows of each length: number, mean and summed products about the mean, as one array."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.shape[1]
        n, m = a[0, 0], b[0, 0]
        apart = b[1] - a[1]
        mean = a[1] + apart * (m / (n + m))
        return np.vstack([np.full(k, n + m), mean, a[2:] + b[2:] + np.outer(apart, apart) * (n * m / (n + m))])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                z = models.value[d].rows(x)
                mean = z.mean(0)
                one = np.vstack([np.full(z.shape[1], len(z)), mean, (z - mean).T @ (z - mean)])
                found[d] = joined(found[d], one) if d in found else one
        yield from found.items()

    def merge(d: int, parts: list[np.ndarray]) -> np.ndarray:
        k = models.value[d].scaled.shape[1]
        out = parts[0].reshape(-1, k)
        for p in parts[1:]:
            out = joined(out, p.reshape(-1, k))
        return out

    return {d: m.reshape(-1, models.value[d].scaled.shape[1]) for d, m in _tree(rows, leaf, merge).items()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length of the vectors in ``rows`` (key, x), with its measured error."""
    spark = rows.sparkSession
    centres = _centres(rows)
    sent = spark.sparkContext.broadcast(centres)
    models = {d: Whitener(centres[d], r, components) for d, r in _factors(rows, sent).items()}
    for d, m in _measure(rows, spark.sparkContext.broadcast(models)).items():
        on = models[d].varies
        off = np.abs(m[2:] / m[0, 0] - np.eye(m.shape[1]))[np.ix_(on, on)]
        models[d].identity_error = float(off.max()) if on.any() else None
    return models


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    deviation: the sum over dimensions of (n * x - S) ** 2, a decimal. explained: the
    component's share of the variance. identity_error: how far the covariance of the
    whitened rows is from the identity, at most, over the components that vary.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = cut(_clean(vectors, key, embedding))
    models = vectors.sparkSession.sparkContext.broadcast(fit(rows, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch):
                model = models.value[d]
                k, z = model.scaled.shape[1], model.rows(x)
                deviation = pa.array([Decimal(v) for v in model.centre.deviations(x)], pa.decimal128(38, 0))
                each = np.repeat(np.arange(len(at)), k)
                columns = [batch.column("key").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)), pa.array(z.reshape(-1), mask=np.tile(~model.varies, len(at))), pa.array(model.explained * len(at), pa.float64()), pa.array([model.identity_error] * len(each), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
