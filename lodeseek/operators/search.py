"""Search: exact cosine top-k for batches of queries, fusion, gates, thresholds, projections.

Queries (qid, variant, embedding) go to every task, points (id, embedding) are scored where
they are read, and each batch of them sends on the best k of every query only. Too many
queries for that are joined with the points in tiles. ``operators.ann`` has an index for
searches that don't read all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.config import DEFAULTS
from lodeseek.functions.text import forward_slashes
from lodeseek.operators import tiles

#: Queries that are sent to all tasks, and points of a batch that are multiplied at once.
MAX_QUERIES, TILE = 20_000, 2_048


def clamp(top_k: int, most: int = DEFAULTS.top_k_most) -> int:
    return max(1, min(top_k, most))


def top_k(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, variant, id, score, rank): the best ``k`` points of every query, ties by id.

    Up to ``MAX_QUERIES`` queries go to every task that reads points. More are dealt with
    the points in tiles, every query to a tile of each stripe of points. Scores are rounded
    to nine places, so that they don't depend on how rows are batched. A point without a
    vector is never found; vectors of other lengths than the first query's, or with null
    components, are an error.
    """
    spark = points.sparkSession
    asked = queries.select("qid", "variant", "embedding")
    scored = points.where("embedding is not null").select("id", "embedding")
    some = asked.limit(MAX_QUERIES + 1).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], f"qid long, variant int, id {points.schema['id'].dataType.simpleString()}, score double, rank int")
    dims = len(some.column("embedding")[0])
    found = _sent(scored, some, dims, k) if some.num_rows <= MAX_QUERIES else _dealt(scored, asked, dims, k)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` (qid, variant, id, score) with rank, the best ``k`` of every query."""
    rank = F.row_number().over(Window.partitionBy("qid", "variant").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _sent(points: DataFrame, some: pa.Table, dims: int, k: int) -> DataFrame:
    """The best ``k`` of each batch of points, queries being sent to all tasks."""
    vectors = some.column("embedding").combine_chunks()
    asked = points.sparkSession.sparkContext.broadcast((some.column("qid").to_numpy(), some.column("variant").to_numpy(), tiles.unit(vectors, dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TILE) for b in batches for at in range(0, b.num_rows, TILE)):
            yield from tiles.scored(batch.column("id"), tiles.unit(batch.column("embedding"), dims), *asked.value, k)

    return points.mapInArrow(run, f"qid long, variant int, id {points.schema['id'].dataType.simpleString()}, score double")


def _dealt(points: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """The best ``k`` of each stripe of points, stripes and groups of queries being dealt in tiles."""
    stripes = tiles.stripes_of(points.count(), dims)
    groups = max(1, points.sparkSession.sparkContext.defaultParallelism // stripes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int")).select("*", every(groups).alias("part"))
    right = asked.withColumn("part", F.pmod(F.xxhash64("qid", "variant"), F.lit(groups)).cast("int")).select("*", every(stripes).alias("stripe"))
    return tiles.tile_top_k(left, right, k, ["stripe", "part"], dims)


def fuse(ranked: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(qid, id, score, rrf, place): lists of variants fused; best cosine first, then reciprocal ranks, then first seen."""
    summed = ranked.groupBy("qid", "id").agg(F.max("score").alias("score"), F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("variant", "rank")).alias("first"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("rrf"), "first.variant", "first.rank", "id")
    return summed.select("qid", "id", "score", "rrf", F.row_number().over(order).alias("place"))


def fuse_ranks(lists: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(qid, id, rrf, place): lists (qid, variant, id, rank) of unlike scores fused by their reciprocal ranks alone, ties by id."""
    summed = lists.groupBy("qid", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 12)), "id")
    return summed.withColumn("place", F.row_number().over(order))


def gated_search(points: DataFrame, queries: DataFrame, limit: int, gate: float = DEFAULTS.gate, least: float = DEFAULTS.score_least, width: int = DEFAULTS.candidates, find: Callable[[DataFrame, DataFrame, int], DataFrame] = top_k) -> DataFrame:
    """(qid, id, score, place, expanded): variants are searched only for queries whose best score is below ``gate``.

    The second pass takes ``width`` points of every variant, fuses them, cuts to
    ``width``, then drops scores below ``least`` and cuts to ``limit``. find: ``top_k``, or
    the search of an index.
    """
    first = find(points, queries.where("variant = 0"), limit)
    best = queries.where("variant = 0").select("qid").distinct().join(first.groupBy("qid").agg(F.max("score").alias("best")), "qid", "left")
    several = queries.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
    hard = best.where(F.col("best").isNull() | (F.col("best") < gate)).join(several, "qid", "left_semi").select("qid")
    easy = first.join(hard, "qid", "left_anti").select("qid", "id", "score", F.col("rank").alias("place"), F.lit(False).alias("expanded"))
    second = fuse(find(points, queries.join(hard, "qid", "left_semi"), width)).where((F.col("place") <= width) & (F.col("score") >= least) & (F.col("place") <= limit))
    return easy.unionByName(second.select("qid", "id", "score", "place", F.lit(True).alias("expanded")))


def threshold(hits: DataFrame, least: float = DEFAULTS.score_least) -> tuple[DataFrame, DataFrame]:
    """(hits of ``least`` or more, (qid, kept, dropped))."""
    stats = hits.groupBy("qid").agg(F.count_if(F.col("score") >= least).alias("kept"), F.count_if(F.col("score") < least).alias("dropped"))
    return hits.where(F.col("score") >= least), stats


def rerank(candidates: DataFrame, scores: DataFrame | None, limit: int, least: float = DEFAULTS.rerank_least, fallback: float = DEFAULTS.score_least) -> DataFrame:
    """(qid, id, score, place): candidates (qid, id, score, place) by scores (qid, id, rerank).

    A candidate without a score counts as one below ``least``. Without scores at all, or
    for a query that has none, the vector order stays, with its own threshold.
    """
    kept = lambda rows: rows.where(F.col("score") >= fallback).where(F.col("place") <= limit).select("qid", "id", "score", "place")
    if scores is None:
        return kept(candidates)
    scored = scores.select("qid").distinct()
    without = kept(candidates.join(scored, "qid", "left_anti"))
    met = candidates.join(scored, "qid", "left_semi").join(scores, ["qid", "id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(least - 1)))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank"), "place")
    fit = met.where(F.col("rerank") >= least).withColumn("at", F.row_number().over(order))
    return fit.where(F.col("at") <= limit).select("qid", "id", F.col("rerank").alias("score"), F.col("at").alias("place")).unionByName(without)


def code_top_k(points: DataFrame, queries: DataFrame, limit: int, least: float = DEFAULTS.code_score_least) -> DataFrame:
    """Code search: the limit comes first, then the threshold."""
    return top_k(points, queries, clamp(limit)).where(F.col("score") >= least)


def facets(points: DataFrame, column: str, most: int = DEFAULTS.facet_most) -> DataFrame:
    """(value, n): the most frequent values of a column, a top-k report."""
    return points.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def filtered(points: DataFrame, counts: DataFrame | None = None, /, **wanted: str | None) -> DataFrame:
    """Equality filters; an empty value asks for nothing. A value that the facets don't list is an error.

    counts: (column, value, n) as a store keeps them, so that points aren't read to know
    the values; without them, they are counted.
    """
    asked = {c: v for c, v in wanted.items() if v}
    if not asked:
        return points
    if counts is None:
        each = [facets(points, c).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value")) for c in asked]
        listed = reduce(DataFrame.unionByName, each).collect()
    else:
        order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        listed = counts.where(F.col("column").isin(*asked)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= DEFAULTS.facet_most).select("column", "value").collect()
    for column, value in asked.items():
        known = [r.value for r in listed if r.column == column]
        if known and value not in known:
            raise ValueError(f"{column} has no value {value!r}; it has {', '.join(sorted(str(k) for k in known))}")
        points = points.where(F.col(column) == value)
    return points


def concise(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "place", "text", F.col("source_id").alias("document"), F.col("url").alias("location"))


def detailed(hits: DataFrame) -> DataFrame:
    names = {"text": "text", "title": "title", "source": "source", "document": "source_id", "space": "space", "location": "url", "updated": "updated_at", "chunk": "chunk_idx"}
    return hits.select("qid", "place", *[F.col(c).alias(n) for n, c in names.items()], F.round("score", 4).alias("score"))


def code_rows(hits: DataFrame, full: bool = False, shown: int = DEFAULTS.shown_code_chars) -> DataFrame:
    """Hits in code as they are shown; signature and doc are null where empty."""
    code = F.col("text") if full else F.left("text", F.lit(shown))
    location = F.concat("repo", F.lit("/"), "path", F.lit(":"), F.col("line_start").cast("string"))
    return hits.select("qid", "place", location.alias("location"), "symbol", "kind", F.nullif("signature", F.lit("")).alias("signature"), F.nullif("doc", F.lit("")).alias("doc"), code.alias("code"))


def citations(hits: DataFrame, prefix: str = "Источник: ") -> DataFrame:
    """(qid, citation): every document of the hits once, in order, with its first location."""
    first = F.row_number().over(Window.partitionBy("qid", "source_id").orderBy("place"))
    each = hits.withColumn("nth", first).where("nth = 1").select("qid", "place", F.concat("source_id", F.lit(" ("), forward_slashes(F.col("url")), F.lit(")")).alias("one"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "one"))), lambda r: r["one"]), "; ")
    return each.groupBy("qid").agg(F.concat(F.lit(prefix), joined).alias("citation"))


def marker_hits(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, hit): whether the texts of a query's hits hold any of its markers, in any case."""
    texts = hits.groupBy("qid").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), " ")).alias("whole"))
    met = cases.join(texts, "qid", "left")
    return met.select("qid", F.coalesce(F.exists("markers", lambda m: F.contains("whole", F.lower(m))), F.lit(False)).alias("hit"))


def hit_rate(hits: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """One row over (qid, hit) and, if given, (qid, seconds): questions, hits, hit_rate and mean_seconds."""
    met = hits.withColumn("seconds", F.lit(None).cast("double")) if seconds is None else hits.join(seconds, "qid", "left")
    return met.agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("seconds").alias("mean_seconds"))


def no_hit_reason(dropped: Column, has_filter: Column) -> Column:
    """Why a query has no hits: off topic, filtered away, or worth rephrasing."""
    return F.when(dropped > 0, "below_threshold").when(has_filter, "try_without_filters").otherwise("rephrase")
