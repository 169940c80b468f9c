"""The inverted-file index and the tile join against exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import ann, search, tiles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _points(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _asked(points, every):
    return points.where(f"id % {every} = 0").select(F.col("id").alias("qid"), F.lit(0).alias("variant"), "embedding")


def _rows(df):
    return sorted(map(tuple, df.select("qid", "variant", "id", "score", "rank").collect()))


def test_many_queries_in_tiles_equal_few_sent_to_all(spark, monkeypatch):
    points = _points(spark).unionByName(_points(spark).where("id < 9").withColumn("id", F.col("id") + 9000))  # ties
    want = _rows(search.top_k(points, _asked(points, 3), 4))
    monkeypatch.setattr(search, "MAX_QUERIES", 20)
    monkeypatch.setattr(tiles, "TILE_BYTES", 20_000)
    assert _rows(search.top_k(points, _asked(points, 3), 4)) == want
    assert _rows(search.top_k(points.where("id < 3"), _asked(points, 3).withColumn("variant", F.lit(2)), 5)) == _rows(search.top_k(points.where("id < 3"), _asked(points, 3).where("qid < 0").unionByName(_asked(points, 3)).withColumn("variant", F.lit(2)), 5))
    with pytest.raises(Exception, match="components"):
        search.top_k(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), _asked(points, 3), 1).collect()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return ann.build(_points(spark), str(tmp_path_factory.mktemp("ivf")), cells=12)


def test_all_cells_give_the_exact_result(spark, index, monkeypatch):
    points = _points(spark)
    want = _rows(search.top_k(points, _asked(points, 7), 5))
    assert index.cells == 12 and sum(index.counts) == points.count()
    assert _rows(index.search(_asked(points, 7), 5)) == want
    monkeypatch.setattr(search, "MAX_QUERIES", 10)
    monkeypatch.setattr(tiles, "TILE_BYTES", 10_000)
    assert _rows(index.search(_asked(points, 7), 5)) == want


def test_few_cells_read_their_partitions_only_either_way(spark, index, monkeypatch):
    asked = _asked(_points(spark), 25)
    one = index.search(asked.where("qid = 0"), 5, 1)
    sent = _rows(index.search(asked, 5, 3))
    assert len(one.collect()) == min(5, index.counts[index._nearest(asked.where("qid = 0"), 1).first().cell])
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    monkeypatch.setattr(search, "MAX_QUERIES", 2)
    assert _rows(index.search(asked, 5, 3)) == sent


def test_calibrated_probes_reach_the_recall(spark, tmp_path):
    """On clustered vectors few cells do; on those of the table as many as calibration says."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + 0.2 * rng.normal(size=16)).tolist()) for k in range(1500)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>")
    for some, root, cells in ((points, "a", None), (_points(spark), "b", 16)):
        made = ann.build(some, str(tmp_path / root), cells)
        asked = _asked(some, 10)
        probes = made.probes_for(asked, 10)
        total = ann.recall(made.search(asked, 10, probes), search.top_k(some, asked, 10)).agg(F.sum("hits"), F.sum("wanted")).first()
        assert total[0] >= 0.9 * total[1] > 0
        if root == "a":
            assert probes <= made.cells // 3


def test_odd_points(spark, tmp_path):
    kind = "id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.5])]
    made = ann.build(spark.createDataFrame(rows, kind), str(tmp_path / "odd"), cells=3)
    asked = spark.createDataFrame([(7, 0, [2.0, 0.0])], "qid long, variant int, embedding array<float>")
    assert [(r.id, r.score) for r in made.search(asked, 3).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (3, 0.0)]
    assert made.search(asked.limit(0), 3).count() == 0
    zeros = ann.build(spark.createDataFrame([(1, [0.0, 0.0])], kind), str(tmp_path / "zero"))
    assert zeros.search(asked, 3).count() == 1
    with pytest.raises(Exception, match="components"):
        ann.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], kind), str(tmp_path / "bad"))
