"""An inverted-file index: points in cells around sampled centroids, searched cell by cell with exact scores.

``build`` fits centroids on a bounded sample, puts every point into the cell of the
nearest one and writes a Parquet partition for each cell. A search probes the nearest
cells of each query; only the partitions of probed cells are read, and their points are
scored exactly. With all cells probed the result is that of ``search.top_k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators import search, tiles
from lodeseek.sources.shared import written

#: Points that centroids are fitted on (about), the most cells, queries that calibration
#: asks, and pairs of a query and a probed cell that are sent to all tasks.
SAMPLE, MOST_CELLS, CALIBRATION, PAIRS = 65_536, 4_096, 256, 1 << 21


class Ivf:
    """The index below ``root``: folders points (by cell) and cells (cell, centre, points)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        rows = spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), -1)
        self.counts = [r.points for r in rows]
        self.points = spark.read.parquet(f"{self.root}/points")

    @property
    def cells(self) -> int:
        return len(self.counts)

    def _nearest(self, queries: DataFrame, probes: int) -> DataFrame:
        """(qid, variant, embedding, order, cell): the ``probes`` nearest cells of each query."""
        centres = self.spark.sparkContext.broadcast(self.centres)
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("variant").cast("int").alias("variant"), F.col("embedding").cast("array<double>").alias("embedding"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, search.TILE) for b in batches for at in range(0, b.num_rows, search.TILE)):
                near = tiles.unit(batch.column("embedding"), centres.value.shape[1]) @ centres.value.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
                nth = np.tile(np.arange(order.shape[1], dtype=np.int32), len(order))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns], pa.array(nth), pa.array(order.reshape(-1).astype(np.int32))], names=[*batch.schema.names, "order", "cell"])

        return asked.mapInArrow(run, "qid long, variant int, embedding array<double>, order int, cell int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, variant, id, score, rank): the best ``k`` points in the ``probes`` nearest cells (None: all cells).

        Few queries go to every task with the cells that each probes, more are dealt with
        the cells in tiles.
        """
        probes = self.cells if probes is None else max(1, min(probes, self.cells))
        probed = written(self._nearest(queries, probes))
        wanted = [r.cell for r in probed.select("cell").distinct().collect()]  # MOST_CELLS at most
        points = self.points if len(wanted) == self.cells else self.points.where(F.col("cell").isin(wanted))
        most = max(1, min(search.MAX_QUERIES, PAIRS // probes))
        few = probed.where("order = 0").limit(most + 1).count() <= most
        return search.ranked((self._sent if few else self._dealt)(points, probed, k), k)

    def _sent(self, points: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        dims = self.centres.shape[1]
        asked = probed.groupBy("qid", "variant").agg(F.first("embedding").alias("embedding"), F.collect_list("cell").alias("cells")).toArrow()
        cells = asked.column("cells").combine_chunks()
        who = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
        order = np.argsort(cells.flatten().to_numpy(), kind="stable")
        bounds = np.searchsorted(cells.flatten().to_numpy()[order], np.arange(self.cells + 1))
        sent = self.spark.sparkContext.broadcast((asked.column("qid").to_numpy(), asked.column("variant").to_numpy(), tiles.unit(asked.column("embedding").combine_chunks(), dims), who[order], bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, variant, vectors, of, at = sent.value
            for batch in (b.slice(n, search.TILE) for b in batches for n in range(0, b.num_rows, search.TILE)):
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    some, asks = batch.filter(pa.array(cell == c)), of[at[c] : at[c + 1]]
                    yield from tiles.scored(some.column("id"), tiles.unit(some.column("embedding"), dims), qid[asks], variant[asks], vectors[asks], k)

        return points.mapInArrow(run, f"qid long, variant int, id {points.schema['id'].dataType.simpleString()}, score double")

    def _dealt(self, points: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        """Cells are dealt in tiles of bounded size with the queries that probe them."""
        dims = self.centres.shape[1]
        sizes = self.spark.createDataFrame([(c, tiles.stripes_of(n, dims)) for c, n in enumerate(self.counts)], "cell int, stripes int")
        left = points.join(F.broadcast(sizes), "cell").withColumn("stripe", F.pmod(F.xxhash64("id"), "stripes").cast("int"))
        right = probed.join(F.broadcast(sizes), "cell").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
        return tiles.tile_top_k(left, right, k, ["cell", "stripe"], dims)

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.9) -> int:
        """The fewest probes that find ``least`` of the true best ``k``, on about ``CALIBRATION`` of the queries."""
        some = queries.orderBy(F.xxhash64("qid", "variant")).limit(CALIBRATION)
        true = search.top_k(self.points.select("id", "embedding"), some, k).select("qid", "variant", "id")
        met = true.join(self.points.select("id", "cell"), "id").join(self._nearest(some, self.cells).select("qid", "variant", "order", "cell"), ["qid", "variant", "cell"])
        counts = {r.order: r.n for r in met.groupBy("order").agg(F.count("*").alias("n")).collect()}
        wanted, seen = least * sum(counts.values()), 0
        for order in range(self.cells):
            seen += counts.get(order, 0)
            if seen >= wanted:
                return order + 1
        return self.cells


def build(points: DataFrame, root: str, cells: int | None = None, seed: int = 7) -> Ivf:
    """Writes the index of ``points`` (id, embedding) to ``root``, a new folder that all executors reach.

    cells: about the root of the number of points, ``MOST_CELLS`` at most, unless given.
    Every point with a vector is indexed; vectors of unlike lengths are an error, as in
    ``search.top_k``.
    """
    spark = points.sparkSession
    rows = points.where("embedding is not null").select("id", "embedding")
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n or 1))
    share = min(1.0, SAMPLE / max(1, n))
    sample = rows.where((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000) & F.exists("embedding", lambda c: c != 0)).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if cells > 1 and not sample.isEmpty():
        model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        centres = np.array(model.clusterCenters(), np.float64)
        norm = np.sqrt((centres * centres).sum(1, keepdims=True))
        centres = np.divide(centres, norm, out=centres, where=norm > 0)
    else:
        first = rows.first()
        centres = np.zeros((1, len(first.embedding) if first else 1))
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, search.TILE) for b in batches for at in range(0, b.num_rows, search.TILE)):
            near = tiles.unit(batch.column("embedding"), sent.value.shape[1]) @ sent.value.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32))], names=["id", "embedding", "cell"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(run, f"{kind}, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/points")  # a large cell is split over tasks
    found = {r.cell: r.n for r in spark.read.schema(f"{kind}, cell int").parquet(f"{root}/points").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    table = [(c, centres[c].tolist(), found.get(c, 0)) for c in range(len(centres))]
    spark.createDataFrame(table, "cell int, centre array<double>, points long").coalesce(1).write.parquet(f"{root}/cells")
    return Ivf(spark, root)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(qid, wanted, hits): how many of the true best points of a query are found."""
    keys = ["qid", "variant", "id"]
    got = found.select(*keys, F.lit(1).alias("got")).distinct()
    return true.select(*keys).join(got, keys, "left").groupBy("qid").agg(F.count("*").alias("wanted"), F.count("got").alias("hits"))
