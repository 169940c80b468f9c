"""BM25 through postings against a plain sum over all documents."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import search, sparse


def _plain(docs, queries, k):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for some in words.values() for w in set(some))
    rows = []
    for qid, variant, text in queries:
        scores = {}
        for i, some in words.items():
            tf = collections.Counter(some)
            parts = [n * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(some) / mean)) for w, n in collections.Counter(re.findall(r"\w+", (text or "").lower())).items() if tf[w]]
            if parts:
                scores[i] = round(sum(parts), 7)
        rows += [(qid, variant, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return rows


def _case():
    rng = random.Random(9)
    pick = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    docs = [(k, pick(rng.randrange(1, 60))) for k in range(300)] + [(900, None), (901, ""), (902, "The THE the, été!"), (903, "été")]
    queries = [(k, 0, pick(rng.randrange(1, 8))) for k in range(40)] + [(50, 1, "the of and"), (51, 0, "nowhere"), (52, 0, None), (53, 0, "Été the the"), (54, 0, "w1 w1 w2 of")]
    return docs, queries


@pytest.mark.parametrize("frequent", [0.0, 0.05, 0.3, 2.0])
def test_search_equals_a_plain_sum(spark, tmp_path, frequent):
    """Whatever counts as frequent: nothing, some words, or every word."""
    docs, queries = _case()
    index = sparse.build(spark.createDataFrame(docs, "id long, text string").repartition(3), str(tmp_path / "s"))
    got = index.search(spark.createDataFrame(queries, "qid long, variant int, text string"), 5, frequent)
    assert sorted((r.qid, r.variant, r.id, round(r.score, 7), r["rank"]) for r in got.collect()) == sorted(_plain(docs, queries, 5))


def test_empty_index_and_no_queries(spark, tmp_path):
    docs, queries = _case()
    asked = spark.createDataFrame(queries, "qid long, variant int, text string")
    none = sparse.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "none"))
    assert none.search(asked, 3).count() == 0
    some = sparse.build(spark.createDataFrame(docs, "doc long, body string").withColumn("text", F.lit("own")), str(tmp_path / "some"), "doc", "body")
    assert some.search(asked.limit(0), 3).count() == 0 and some.search(asked, 3).count() > 0


def test_ranks_of_unlike_scores_are_fused(spark):
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 12, 2), (2, 0, 9, 1)], "qid long, variant int, id long, rank int")
    got = [(r.qid, r.id, r.place) for r in search.fuse_ranks(lists).orderBy("qid", "place").collect()]
    assert got == [(1, 11, 1), (1, 10, 2), (1, 12, 3), (2, 9, 1)]


def test_tiles_equal_a_plain_sum(spark, tmp_path, monkeypatch):
    """Queries dealt in tiles, ties among copies of a document, and rows that share a key: what is sent on is k a tile."""
    monkeypatch.setattr(sparse, "SENT", 10)
    monkeypatch.setattr(sparse, "ASKED", 60)
    monkeypatch.setattr(sparse, "SMALL_STRIPE", 500)
    docs, queries = _case()
    docs += [(k, docs[7][1]) for k in range(2000, 2040)]
    index = sparse.build(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "s"))
    asked = spark.createDataFrame(queries, "qid long, variant int, text string")
    for frequent in (0.0, 0.05, 2.0):
        got = sorted((r.qid, r.variant, r["rank"], r.id, r.score) for r in index.search(asked, 5, frequent).collect())
        want = sorted((q, v, n, i, s) for q, v, i, s, n in _plain(docs, queries, 5))
        assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-7)
    split = [(1, "a b"), (1, "b c"), (2, "b"), (None, "a"), (None, "d")]
    parts = sparse.build(spark.createDataFrame(split, "id long, text string"), str(tmp_path / "t"))
    whole = sparse.build(spark.createDataFrame([(1, "a b b c"), (2, "b"), (None, "a d")], "id long, text string"), str(tmp_path / "u"))
    ask = spark.createDataFrame([(0, 0, "a b"), (1, 0, "d c")], "qid long, variant int, text string")
    assert sorted(map(str, parts.search(ask, 3).collect())) == sorted(map(str, whole.search(ask, 3).collect()))
