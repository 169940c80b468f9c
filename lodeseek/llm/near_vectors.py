"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with cosine t or more are at most eps = sqrt(2 - 2 t) apart. They
are rotated to their leading principal axes (from sums over all vectors), put into grid
cells of width eps there, and sorted by cell. The sequence is cut into intervals and
blocks with bounding boxes; the norm outside the leading axes is one more axis, since the
distance is at least the difference of those norms as well. Pairs of intervals, then of blocks
in them, then of halves of the two blocks, are skipped where the boxes are provably
further apart than eps; what is left is compared by matrix products, and what is within
rounding of the threshold in double precision.

Equal vectors are collapsed first. A block pair returns one row for each of its linked
vectors (how many links, and one vector of its component), never pairs of vectors, so a
group of m near copies costs no m * m rows.

Null, zero and ragged vectors: one that is null, zero or holds a null or non-finite
component links with nothing, and only vectors of one length are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import connected_components

#: Leading principal axes of the grid.
AXES = 8
#: Vectors of a block, and vectors that are compared at once.
BLOCK, LEAF = 4096, 512
#: Intervals of the sequence; beyond their square in blocks, as many as the root of the blocks.
INTERVALS = 256
_SLACK = 1e-6


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _clean(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, str]:
    """(key, dims, packed): packed is null for a vector that links with nothing."""
    kind = "<f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(lengths)
            packed = []
            for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                v = values[a:b].astype(np.float64)
                packed.append((values[a:b] + 0).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32)), pa.array(packed, pa.binary())], names=["key", "dims", "packed"])

    type_ = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, embedding).mapInArrow(run, f"key {type_}, dims int, packed binary"), kind


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _principal_axes(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each vector length, the leading eigenvectors of the covariance of all unit vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = _unit(_matrix(batch.column(1).filter(pa.array(dims == d)), d, kind))
                x = np.hstack([x, np.ones((len(x), 1))])
                found[d] = found.get(d, 0) + x.T @ x
        for d, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["dims", "i", "row"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer()) for part in parts for x in part.column("row"))
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["dims", "i", "row"])

    kinds = "dims int, i int, row binary"
    rows = nodes.select("dims", "packed").mapInArrow(sums, kinds).groupBy("dims", "i").applyInArrow(add, kinds).collect()
    out = {}
    for d in {r.dims for r in rows}:
        m = np.array([np.frombuffer(r.row) for r in sorted((r for r in rows if r.dims == d), key=lambda r: r.i)])
        mean = m[:d, d] / m[d, d]
        _, axes = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    return out


def _places(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on ``AXES`` leading axes (0 beyond), and the norm outside them."""
    y = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
    return np.hstack([y, np.zeros((len(x), AXES - y.shape[1])), rest[:, None]])


def _blocks(nodes: DataFrame, axes, kind: str, eps: float, intervals: int, block: int) -> DataFrame:
    """The grid order in blocks: (dims, part, idx, lo, hi, ids, weights, vectors)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            cell = np.zeros((len(dims), AXES), np.int64)
            for d in np.unique(dims).tolist():
                some = dims == d
                cell[some] = np.floor(_places(_unit(_matrix(batch.column(1).filter(pa.array(some)), d, kind)), axes.value[d])[:, :AXES] / eps)
            code = ((cell + 64) << (7 * np.arange(AXES)[::-1])).sum(1)  # cells by the first axis, then the next
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "cell"])

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        idx = 0

        def blocks(rows: pa.Table, last: bool):
            nonlocal idx
            at = 0
            dims = rows.column("dims").to_numpy()
            while at < len(dims):
                end = int(min(at + block, np.searchsorted(dims, dims[at], "right")))
                if end == len(dims) and end - at < block and not last:
                    break
                one = rows.slice(at, end - at)
                d = int(dims[at])
                places = _places(_unit(_matrix(one.column("packed"), d, kind)), axes.value[d])
                lo, hi = places.min(0), places.max(0)
                row = [[d], [int(one.column("part")[0].as_py())], [idx], [lo.tolist()], [hi.tolist()], [one.column("node").to_numpy().tobytes()], [one.column("copies").to_numpy().tobytes()], [b"".join(one.column("packed").to_pylist())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["dims", "part", "idx", "lo", "hi", "ids", "weights", "vectors"])
                idx, at = idx + 1, end
            held[:] = rows.slice(at).to_batches()

        for batch in batches:
            held.append(batch)
            yield from blocks(pa.Table.from_batches(held), False)
        if held:
            yield from blocks(pa.Table.from_batches(held), True)

    placed = nodes.select("dims", "packed", "node", "copies").mapInArrow(cells, "dims int, packed binary, node long, copies long, cell long")
    order = ["dims", "cell", "node"]
    ranged = placed.repartitionByRange(intervals, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return ranged.mapInArrow(cutting, "dims int, part int, idx int, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary")


def _gap(a: str, b: str) -> str:
    """The squared distance of two boxes."""
    each = [f"pow(greatest(0D, {a}lo[{k}] - {b}hi[{k}], {b}lo[{k}] - {a}hi[{k}]), 2)" for k in range(AXES + 1)]
    return " + ".join(each)


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(dims, pa, ia, pb, ib): pairs of blocks that are not provably distant, by way of their intervals."""
    within = f" <= {(eps + _SLACK) ** 2!r}"
    meta = blocks.select("dims", "part", "idx", "lo", "hi")
    box = [F.array(*[f(F.col(c)[k]) for k in range(AXES + 1)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    whole = meta.groupBy("dims", "part").agg(*box)
    last = whole.groupBy("dims").agg(F.max("part").alias("last"))
    left = whole.join(last, "dims").select("dims", F.col("part").alias("pa"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(F.sequence("part", "last")).alias("pb"))
    right = whole.select("dims", F.col("part").alias("pb"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    parts = left.join(right, ["dims", "pb"]).where(_gap("a_", "b_") + within).select("dims", "pa", "pb")
    a = meta.select("dims", F.col("part").alias("pa"), F.col("idx").alias("ia"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = meta.select("dims", F.col("part").alias("pb"), F.col("idx").alias("ib"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return parts.join(a, ["dims", "pa"]).join(b, ["dims", "pb"]).where("pa < pb or ia <= ib").where(_gap("a_", "b_") + within).select("dims", "pa", "ia", "pb", "ib")


class _Forest:
    """Components of local nodes under vectorised unions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.up[i], self.up[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = self.up[self.up]
                if np.array_equal(up, self.up):
                    break
                self.up = up


def _leaf(a: dict, b: dict, i: slice, j: slice, least: float, same: bool):
    """Index pairs (in a, in b) of linked vectors; of a block with itself, each pair once."""
    near = a["single"][i] @ b["single"][j].T
    margin = 4e-7 * math.sqrt(a["x"].shape[1]) + 1e-6
    p, q = np.nonzero(near >= least - margin)
    if same:
        keep = p + i.start < q + j.start
        p, q = p[keep], q[keep]
    unsure = near[p, q] < least + margin
    p, q = p + i.start, q + j.start
    if unsure.any():
        ok = ~unsure
        x, y = a["x"][p[unsure]].astype(np.float64), b["x"][q[unsure]].astype(np.float64)
        ok[unsure] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least
        p, q = p[ok], q[ok]
    return p, q


def _join(a: dict, b: dict, i: slice, j: slice, eps: float, same: bool, leaf: int):
    """The leaves of the recursion that are not provably distant."""
    if same and j.stop <= i.start:
        return
    gap = np.maximum(0, np.maximum(a["at"][i].min(0) - b["at"][j].max(0), b["at"][j].min(0) - a["at"][i].max(0)))
    if (gap * gap).sum() > (eps + _SLACK) ** 2:
        return
    n, m = i.stop - i.start, j.stop - j.start
    if max(n, m) <= leaf:
        yield i, j
    elif n >= m:
        for half in (slice(i.start, i.start + n // 2), slice(i.start + n // 2, i.stop)):
            yield from _join(a, b, half, j, eps, same, leaf)
    else:
        for half in (slice(j.start, j.start + m // 2), slice(j.start + m // 2, j.stop)):
            yield from _join(a, b, i, half, eps, same, leaf)


def _links(pairs: DataFrame, blocks: DataFrame, axes, kind: str, least: float, eps: float, leaf: int) -> DataFrame:
    """(node, links, root): for each vector of a block pair with links, how many vectors, and one of its component."""

    def side(row: pa.RecordBatch, letter: str, d: int) -> dict:
        x = np.frombuffer(row.column(f"{letter}_vectors")[0].as_buffer(), kind).reshape(-1, d)
        unit = _unit(x)
        return {"x": x, "single": unit.astype(np.float32), "at": _places(unit, axes.value[d]), "ids": np.frombuffer(row.column(f"{letter}_ids")[0].as_buffer(), np.int64), "w": np.frombuffer(row.column(f"{letter}_weights")[0].as_buffer(), np.int64)}

    def pair(row: pa.RecordBatch) -> pa.RecordBatch:
        d, same = int(row.column("dims")[0].as_py()), row.column("pa")[0] == row.column("pb")[0] and row.column("ia")[0] == row.column("ib")[0]
        a, b = side(row, "a", d), side(row, "b", d)
        n, m = len(a["ids"]), 0 if same else len(b["ids"])
        forest, links = _Forest(n + m), np.zeros(n + m)
        for i, j in _join(a, b, slice(0, n), slice(0, len(b["ids"])), eps, same, leaf):
            p, q = _leaf(a, b, i, j, least, same)
            if len(p):
                at = q if same else q + n
                forest.add(p, at)
                links += np.bincount(p, b["w"][q], n + m) + np.bincount(at, a["w"][p], n + m)
        ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[forest.up[some]])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of bounded bytes (spark.sql.execution.arrow.maxBytesPerBatch), whatever the size of a row
            for n in range(batch.num_rows):
                yield pair(batch.slice(n, 1))

    data = blocks.select("dims", "part", "idx", "ids", "weights", "vectors")
    a = data.withColumnsRenamed({"part": "pa", "idx": "ia", "ids": "a_ids", "weights": "a_weights", "vectors": "a_vectors"})
    b = data.withColumnsRenamed({"part": "pb", "idx": "ib", "ids": "b_ids", "weights": "b_weights", "vectors": "b_vectors"})
    met = pairs.join(a, ["dims", "pa", "ia"]).join(b, ["dims", "pb", "ib"])
    return met.mapInArrow(run, "node long, links long, root long")


def near_components(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.9, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    n_links: other rows with a cosine of ``least`` or more. component_id: the smallest key
    reachable by links, the row's own included (a null key counts as none; a row that
    reaches no key has null). kept: key = component_id. ``least`` is over 0. ``block`` and
    ``leaf`` are how many vectors stand in a block and are compared at once.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    clean, kind = _clean(vectors, key, embedding)
    rows = cut(clean.withColumn("node", F.when(F.col("packed").isNotNull(), F.xxhash64("dims", "packed"))))
    nodes = cut(rows.where("packed is not null").groupBy("dims", "packed", "node").agg(F.count("*").alias("copies"), F.min("key").alias("low")))
    n = nodes.count()
    spark = vectors.sparkSession
    axes = spark.sparkContext.broadcast(_principal_axes(nodes, kind))
    blocks = cut(_blocks(nodes, axes, kind, max(eps, 1e-3), max(1, min(max(INTERVALS, math.isqrt(n // block)), n // block)), block))
    pairs = cut(_block_pairs(blocks, eps))
    found = cut(_links(pairs, blocks, axes, kind, least, eps, leaf))
    of = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "node", "component": "c"})
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = cut(nodes.select("node", "copies", "low").join(counts, "node", "left").join(of, "node", "left").withColumn("c", F.coalesce("c", "node")))
    least_key = told.groupBy("c").agg(F.min("low").alias("component_id"))
    told = told.join(least_key, "c").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("key", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
