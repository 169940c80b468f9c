"""Connected components of a graph that is given as a DataFrame of edges.

Alternates the large-star and small-star steps of Kiveris et al. (2014). Every step is
an aggregate and a join, the edges are written between rounds, and only a count
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, moved to the least neighbour of each node."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "node")
    met = around.join(least, around.u == least.node)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for the nodes of ``edges`` (a, b long): the least node reachable.

    The least nodes themselves and nodes without another node are left out, so the caller
    takes the node itself where a join finds nothing. Loops and repeated edges do no harm;
    null ends are ignored. It ends when a round changes nothing, after about as many rounds
    as the square of the bits of the number of nodes at most.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        before, now = now, cut(_star(_star(now, True), False))
        release(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
