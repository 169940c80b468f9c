"""Vectors: an offline embedding by hashed words."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_buckets(texts: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, bucket, n, weight): words counted in hashed buckets, weights of unit length for each key.

    Words are the runs of ASCII letters and digits of the lower-cased text.
    """
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dims
    counts = words.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", "n", (F.col("n") / norm).alias("weight"))


def embed(texts: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """``texts`` with the dense ``embedding`` of ``text``; zeros for a text without words."""
    dense = word_buckets(texts, key, text, dims).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("weights"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda k: F.coalesce(F.col("weights")[k], F.lit(0.0)).cast("float"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return texts.join(dense, key, "left").withColumn("embedding", F.when(F.col("weights").isNull(), zero).otherwise(filled)).drop("weights")


def vectors_of(payload: str, dims: int, asked: int) -> list[list[float]]:
    """The vectors in the JSON answer of an embedding service, in either shape; an error unless they are as asked for.

    Shapes: ``{"data": [{"embedding": [..]}, ..]}`` and ``{"embeddings": [[..], ..]}``.
    """
    answer = json.loads(payload)
    found = [item["embedding"] for item in answer["data"]] if "data" in answer else answer.get("embeddings", [])
    return checked(found, dims, asked)


def variants_of(payload: str) -> list[str]:
    """The query variants in the JSON answer of a chat service, in either shape; none where it holds no such list."""
    try:
        answer = json.loads(payload)
        message = answer["choices"][0]["message"] if "choices" in answer else answer["message"]
        found = json.loads(message["content"]).get("queries", [])
    except (ValueError, LookupError, TypeError, AttributeError):
        return []
    return [q for q in found if isinstance(q, str)] if isinstance(found, list) else []


def checked(found: list, dims: int, asked: int) -> list:
    """``found``, if it is one vector of ``dims`` components for each text."""
    if len(found) != asked:
        raise ValueError(f"{len(found)} vectors came back for {asked} texts")
    wrong = next((len(v) for v in found if len(v) != dims), None)
    if wrong is not None:
        raise ValueError(f"a vector has {wrong} components, the table {dims}: it is another model's")
    return found


def embedder(call: Callable[[list[str]], list], dims: int, batch: int = 64) -> Callable[[Column], Column]:
    """A column function that sends texts to a model in batches, one after another in each task.

    call: gives a list of vectors for a list of texts; it is pickled to the executors. A
    null text is sent as an empty one.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(texts), batch) for v in checked(call(texts[at : at + batch]), dims, len(texts[at : at + batch]))], dtype=object)

    return run


def reranker(call: Callable[[str, list[str]], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A function from candidates (qid, id, query, text) to scores (qid, id, rerank), one call a query.

    call: gives items with the index of a text and its score. Items with an index or a
    score that isn't one, or with an index out of range, are ignored; a candidate without
    an item has no row, and a query without any keeps its order, as without a reranker.
    The candidates of a query are few (a search's width), so they fit a task.
    """

    def scores(candidates: DataFrame) -> DataFrame:
        kind = candidates.schema["id"].dataType.simpleString()

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id", kind="stable")
            items = call(rows["query"].iloc[0], rows["text"].fillna("").tolist())
            found = {}
            for item in items:
                index, score = (item.get("index"), item.get("score")) if isinstance(item, dict) else (None, None)
                if type(index) is int and 0 <= index < len(rows) and isinstance(score, int | float) and not isinstance(score, bool):
                    found[index] = float(score)
            at = sorted(found)
            return pd.DataFrame({"qid": rows["qid"].iloc[at], "id": rows["id"].iloc[at], "rerank": [found[k] for k in at]})

        return candidates.select("qid", "id", "query", "text").groupBy("qid").applyInPandas(run, f"qid long, id {kind}, rerank double")

    return scores


def input_text(heading: Column, text: Column) -> Column:
    """What is embedded of a document chunk: the heading, a blank line and the text."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def code_input_text(repo: Column, path: Column, symbol: Column, signature: Column, doc: Column, text: Column) -> Column:
    """What is embedded of a code chunk: where it is, its signature and its documentation, as far as it has them, and the code."""
    place = F.concat(repo, F.lit("/"), path, F.lit(" :: "), symbol)
    return F.concat_ws("\n", place, F.nullif(signature, F.lit("")), F.nullif(doc, F.lit("")), text)
