"""The two tools, over DataFrames: search in documents and in code, for batches of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.config import DEFAULTS, Settings
from lodeseek.functions.text import strip
from lodeseek.operators import search

Embedder = Callable[[DataFrame], DataFrame]
Reranker = Callable[[DataFrame], DataFrame]
Finder = Callable[[DataFrame, DataFrame, int], DataFrame]


def _questions(asked: DataFrame) -> None:
    if not asked.where(F.col("query").isNull() | (strip(F.col("query")) == "")).isEmpty():
        raise ValueError("a question is empty")


def kb_search(points: DataFrame, asked: DataFrame, embed: Embedder, top_k: int = DEFAULTS.top_k, source: str | None = None, space: str | None = None, detailed: bool = False, variants: DataFrame | None = None, rerank: Reranker | None = None, settings: Settings = DEFAULTS, facets: DataFrame | None = None, find: Finder = search.top_k) -> tuple[DataFrame, DataFrame]:
    """(hits, answers) for ``asked`` (qid, query).

    embed: gives (qid, variant, query) an ``embedding``. variants: (qid, variant, query),
    variants from 1. rerank: gives (qid, id, query, text) a ``rerank`` score. answers:
    (qid, found, dropped, reason, citation), reason being null where there are hits.
    facets: counts that a store keeps, for the filters. find: ``search.top_k`` over the
    filtered points, or another search of them.
    """
    _questions(asked)
    limit = search.clamp(top_k, settings.top_k_most)
    points = search.filtered(points, facets, source=source, space=space)
    every = asked.select("qid", F.lit(0).alias("variant"), "query")
    every = every if variants is None else every.unionByName(variants.select("qid", "variant", "query"))
    wide = settings.candidates if rerank else limit
    found = search.gated_search(points, embed(every), wide, settings.gate, settings.score_least, settings.candidates, find)
    counted = found.groupBy("qid").agg(F.count("*").alias("all"), F.count_if(F.col("score") < settings.score_least).alias("low"))
    if rerank:
        scores = rerank(found.select("qid", "id").join(points.select("id", "text"), "id").join(asked, "qid"))
        best = search.rerank(found, scores, limit, settings.rerank_least)
    else:
        best = found.where((F.col("score") >= settings.score_least) & (F.col("place") <= limit)).select("qid", "id", "score", "place")
    hits = best.join(points.drop("embedding"), "id")
    kept = hits.groupBy("qid").agg(F.count("*").alias("found"))
    stats = asked.select("qid").join(counted, "qid", "left").join(kept, "qid", "left").na.fill(0)
    dropped = (F.col("all") - F.col("found")) if rerank else F.col("low")
    reason = F.when(F.col("found") == 0, search.no_hit_reason(dropped, F.lit(bool(source or space))))
    answers = stats.select("qid", "found", dropped.alias("dropped"), reason.alias("reason")).join(search.citations(hits), "qid", "left")
    return (search.detailed if detailed else search.concise)(hits), answers


def code_search(points: DataFrame, asked: DataFrame, embed: Embedder, top_k: int = DEFAULTS.top_k, repo: str | None = None, full: bool = False, settings: Settings = DEFAULTS, facets: DataFrame | None = None) -> DataFrame:
    """Rows of code for ``asked`` (qid, query); an empty question has none."""
    asked = asked.where(strip(F.col("query")) != "").select("qid", F.lit(0).alias("variant"), "query")
    found = search.code_top_k(search.filtered(points, facets, repo=repo), embed(asked), top_k, settings.code_score_least)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return search.code_rows(found.withColumn("place", place).join(points.drop("embedding"), "id"), full)
