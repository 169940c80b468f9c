"""Questions to a code graph of nodes (id, ...) and edges (src, dst, confidence)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.shared import forget, levels, written


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, neighbour) of the nodes in ``wanted`` (id)."""
    return undirected(edges).join(wanted.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, most: int = 10) -> DataFrame:
    """The nodes with the highest degrees, a top-k report."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(most)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and edges by confidence."""
    counted = edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    return nodes.agg(F.count("*").alias("nodes")).join(counted, F.lit(True))


def _reached(edges: DataFrame, source, most: int | None) -> DataFrame:
    """(id, via, distance): ``via`` is the least neighbour one step nearer to ``source``."""
    graph = written(undirected(edges))
    start = graph.sparkSession.range(1).select(F.lit(source).cast(graph.schema["src"].dataType).alias("id"), F.lit(None).cast(graph.schema["src"].dataType).alias("via"))

    def step(front: DataFrame) -> DataFrame:
        return graph.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))

    found = levels(start, step, ["id"], "distance", most, back=2)
    forget(graph)
    return found


def distances(edges: DataFrame, source, most: int | None = None) -> DataFrame:
    """(id, distance) of the nodes within ``most`` steps of ``source`` (None: of all that can be reached)."""
    return _reached(edges, source, most).select("id", "distance")


def path(edges: DataFrame, source, target) -> DataFrame:
    """(step, id) of a shortest way from ``source`` to ``target``, by the least nodes; no rows where there is none.

    The way back from the target is found by doubling: in each round the part that is
    known is carried on by as many steps again, so a way of n nodes takes as many rounds
    as n has bits.
    """
    found = _reached(edges, source, None)
    last = found.where(F.col("id") == F.lit(target)).select("id", "distance").first()
    if last is None:
        return found.select(F.col("distance").alias("step"), "id").limit(0)
    jump = found.where(F.col("distance") <= last.distance).select("id", F.col("via").alias("to"))
    way = found.where(F.col("id") == F.lit(target)).select(F.col("distance").alias("step"), "id")
    length, kept = 1, []
    while length <= last.distance:
        onward = way.join(jump, "id").where("to is not null").select((F.col("step") - length).alias("step"), F.col("to").alias("id"))
        way = written(way.unionByName(onward))
        length *= 2
        if length <= last.distance:
            second = jump.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jump = written(jump.join(second, "to").select("id", F.col("next").alias("to")))
            kept.append(jump)
    forget(*kept)
    return way


def reach(edges: DataFrame, wanted: DataFrame, backwards: bool = False, most: int | None = None) -> DataFrame:
    """(start, id, distance): what the nodes of ``wanted`` (id) lead to along edges, or, backwards, what leads to them.

    Backwards along calls and imports: what may break if a node changes.
    """
    ends = ("dst", "src") if backwards else ("src", "dst")
    along = written(edges.select(F.col(ends[0]).alias("from"), F.col(ends[1]).alias("to")).distinct())

    def step(front: DataFrame) -> DataFrame:
        return front.join(along, front.id == along["from"]).select("start", F.col("to").alias("id"))

    found = levels(wanted.select(F.col("id").alias("start"), "id"), step, ["start", "id"], "distance", most)
    forget(along)
    return found


@dataclass(frozen=True)
class Hop:
    """A step of a pattern: along edges of some kinds and confidences to nodes of some kinds.

    direction: out, in or any. None: whatever there is. text: part of the node's label, in any case.
    """

    edges: tuple[str, ...] | None = None
    confidence: tuple[str, ...] | None = None
    direction: str = "out"
    nodes: tuple[str, ...] | None = None
    text: str | None = None


def match(nodes: DataFrame, edges: DataFrame, start: Hop, *hops: Hop) -> DataFrame:
    """(n0, n1, ..., e1, c1, ...): the ways through nodes (id, kind, label) and edges (src, dst, kind, confidence) that fit a pattern.

    start: of it, nodes and text count. Each hop adds a node, the kind of the edge to it
    and that edge's confidence. It is a join for each hop and one for its nodes if they
    are filtered; a way may come back to a node.
    """

    def fit(hop: Hop) -> DataFrame:
        rows = nodes if hop.nodes is None else nodes.where(F.col("kind").isin(*hop.nodes))
        return (rows if hop.text is None else rows.where(F.contains(F.lower("label"), F.lit(hop.text.lower())))).select("id")

    out = fit(start).select(F.col("id").alias("n0"))
    for k, hop in enumerate(hops, 1):
        rows = edges
        for column, wanted in (("kind", hop.edges), ("confidence", hop.confidence)):
            rows = rows if wanted is None else rows.where(F.col(column).isin(*wanted))
        ways = {"out": [("src", "dst")], "in": [("dst", "src")], "any": [("src", "dst"), ("dst", "src")]}[hop.direction]
        steps = [rows.select(F.col(a).alias(f"n{k - 1}"), F.col(b).alias(f"n{k}"), F.col("kind").alias(f"e{k}"), F.col("confidence").alias(f"c{k}")) for a, b in ways]
        both = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1]).distinct()
        out = out.join(both, f"n{k - 1}")
        if hop.nodes is not None or hop.text is not None:
            out = out.join(fit(hop).withColumnRenamed("id", f"n{k}"), f"n{k}", "left_semi")
    n = range(1, len(hops) + 1)
    return out.select("n0", *[f"n{k}" for k in n], *[f"{c}{k}" for k in n for c in "ec"])


def lookup(nodes: DataFrame, text: str, columns: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """The nodes with ``text`` in one of ``columns``, in any case; those with ``exact`` first have it whole."""
    known = [F.lower(F.col(c).cast("string")) for c in columns if c in nodes.columns]
    wanted = F.lit(text.lower())
    exact = F.coalesce(F.greatest(F.lit(False), *[c == wanted for c in known]), F.lit(False))
    return nodes.where(F.greatest(F.lit(False), *[F.contains(c, wanted) for c in known])).withColumn("exact", exact)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation: in each round, the most frequent label around a node, the least in ties.

    A node starts with its own id as label, and its own label counts as one neighbour's.
    """
    graph = undirected(edges)
    around = written(graph.unionByName(graph.select("src", F.col("src").alias("dst")).distinct()))
    labels = around.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
    for n in range(rounds):
        votes = around.join(labels, around.dst == labels.id).groupBy("src", "community").agg(F.count("*").alias("votes"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "community")).alias("best"))
        before, labels = labels, written(best.select(F.col("src").alias("id"), F.col("best.community").alias("community")))
        if n:
            forget(before)
    forget(around)
    return labels
