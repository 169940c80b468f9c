"""Top-k of queries against points tile by tile: both sides are dealt by tile, and points of one tile fit a task.

Rows of a tile come sorted, points first, so a task holds one tile's points and streams its
queries past them; each query sends on its best k of the tile only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the unit vectors of a tile's points, and scores that are held at once.
TILE_BYTES, SCORES = 32 << 20, 1 << 21


def unit(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of length 1 (zero vectors stay); an error unless all have ``dims`` components."""
    lengths = vectors.value_lengths()
    if lengths.null_count or vectors.flatten().null_count or (lengths.to_numpy() != dims).any():
        raise ValueError(f"every vector has to have {dims} components, none of them null")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best rows of each column, and of all as good as the k-th, so that ties are decided later."""
    n = len(score)
    if n > k:
        return np.nonzero(score >= np.partition(score, n - k, 0)[n - k])
    return np.divmod(np.arange(score.size), score.shape[1])


def scored(ids: pa.Array, points: np.ndarray, qid: np.ndarray, variant: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(qid, variant, id, score) of the best points of each query, scores rounded to nine places."""
    step = max(1, SCORES // max(1, len(points)))
    for at in range(0, len(qid), step):
        score = np.round(points @ asked[at : at + step].T, 9)
        row, col = best(score, k)
        yield pa.RecordBatch.from_arrays([pa.array(qid[at : at + step][col]), pa.array(variant[at : at + step][col].astype(np.int32)), ids.take(pa.array(row)), pa.array(score[row, col])], names=["qid", "variant", "id", "score"])


def stripes_of(points: int, dims: int) -> int:
    """In how many tiles so many points are dealt."""
    return max(1, -(-points * dims * 8 // TILE_BYTES))


def tile_top_k(points: DataFrame, asked: DataFrame, k: int, on: list[str], dims: int) -> DataFrame:
    """(qid, variant, id, score): the best ``k`` points that a query meets in each of its tiles.

    points (on..., id, embedding) and asked (on..., qid, variant, embedding), each in the
    tiles that it is to meet; on: integer columns.
    """
    kind = points.schema["id"].dataType.simpleString()
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    left = points.select(*on, F.lit(0).alias("side"), "id", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("int").alias("variant"), vector)
    right = asked.select(*on, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), F.col("qid").cast("long").alias("qid"), F.col("variant").cast("int").alias("variant"), vector)
    rows = left.unionByName(right).repartition(*on).sortWithinPartitions(*on, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, whole = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*on, "side"]])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                some = batch.slice(at, end - at)
                tile, side = tuple(keys[:-1, at].tolist()), int(keys[-1, at])
                if tile != now:
                    now, ids, vectors, whole = tile, [], [], None
                if side == 0:
                    ids.append(some.column("id"))
                    vectors.append(unit(some.column("embedding"), dims))
                elif ids:
                    if whole is None:
                        whole = pa.concat_arrays(ids), np.vstack(vectors)
                        vectors = []
                    yield from scored(*whole, some.column("qid").to_numpy(), some.column("variant").to_numpy(), unit(some.column("embedding"), dims), k)

    return rows.mapInArrow(run, f"qid long, variant int, id {kind}, score double")
