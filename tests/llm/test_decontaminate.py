"""Benchmark passages in documents: against a plain search, with odd items, several blocks and repeated words."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import common, decontaminate


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _windows(items, window):
    out = {}
    for item, text in items:
        w = _words(text)
        size = min(len(w), window)
        for k in range(len(w) - size + 1 if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add(str(item) if item is not None else "")
    return out


def _plain(docs, items, window):
    windows = _windows(items, window)
    sizes = sorted({len(w) for w in windows})
    rows = []
    for key, text in docs:
        w, hit, found = _words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        rows.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def _case(seed):
    """Documents and items over few words, so that matches overlap, repeat and differ at their ends."""
    rng = random.Random(seed)
    text = lambda n, k=4: "".join(rng.choice("abcdé9"[:k]) + rng.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 40), 6)) for k in range(30)] + [(3, text(12)), (None, text(11)), (41, None), (42, ""), (43, " ,. "), (5, "a a a a a a a a a a a a a a")]
    docs = [(k, text(rng.randrange(0, 120), 6)) for k in range(60)] + [(100, None), (101, ""), (102, "a " * 3000), (102, "a " * 3000), (None, "x " + items[0][1].upper() + " y")]
    docs += [(200 + k, text(5) + items[k][1] + text(5)) for k in range(20)]
    return docs, items


def _frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("seed", "block", "piece"), [(1, 1 << 22, 1 << 20), (2, 300, 64), (3, 90, 1 << 20)])
def test_hits_equal_a_plain_search(spark, monkeypatch, seed, block, piece):
    """Also with a benchmark of several blocks and with texts read in small pieces."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(common, "SLICE_BYTES", piece)
    docs, items = _case(seed)
    d, b = _frames(spark, docs, items)
    assert sorted(map(tuple, decontaminate.digests(d, b).collect()), key=str) == _plain(docs, items, 10)


def test_longest_matches_equal_a_plain_search(spark):
    docs, items = _case(4)
    items = [x for x in items if x[0] not in (3, 5, None)]
    d, b = _frames(spark, [x for x in docs if x[0] is not None], items)
    got = {(r.item, r.position): (r.words, r.doc, r.at) for r in decontaminate.longest_matches(d.repartition(3), b).collect()}
    want = {}
    words = {}
    for key, text in docs:
        if key is not None:
            words.setdefault(key, _words(text))
    for item, text in items:
        w = _words(text)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            best = (0, 0, 0)
            for key, v in words.items():
                for at in range(len(v)):
                    n = 0
                    while k + n < len(w) and at + n < len(v) and w[k + n] == v[at + n]:
                        n += 1
                    best = max(best, (n, -key, -at))
            if best[0] >= min(10, len(w)):
                want[str(item), k] = (best[0], -best[1], -best[2])
    assert got == want and len(want) > 20


def test_clean_documents_and_clashing_columns(spark):
    docs, items = _case(5)
    d, b = _frames(spark, docs, items)
    more = d.withColumns({"hits": F.lit("own"), "Items": F.lit("own"), "n_words": F.lit(-1), "item_id": F.lit(7), "own_0": F.lit(1)})
    clean = {r[0] for r in _plain(docs, items, 10) if not r[5]}
    kept = decontaminate.clean_documents(more, b.withColumn("doc_id", F.lit(1)))
    assert kept.columns == more.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == clean and all(r.hits == "own" and r.n_words == -1 for r in rows)
    named = decontaminate.match_documents(d.withColumnRenamed("text", "Items"), b, text="Items").collect()
    found = lambda rows: sorted((str(r.doc_id), r.n_words, r["items"], [tuple(h) for h in r.hits]) for r in rows)
    assert found(named) == found(decontaminate.match_documents(d, b).collect())
    assert sorted(map(tuple, decontaminate.digests(more, b.withColumn("n_words", F.lit(1))).collect()), key=str) == _plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = _case(6)
    d, b = _frames(spark, docs, items)
    assert decontaminate.digests(d.limit(0), b).count() == 0
    for none in (b.limit(0), b.where("text is null")):
        rows = decontaminate.digests(d, none).collect()
        assert len(rows) == len(docs) and not any(r.n_hit or r.n_items or r.contaminated for r in rows)
        assert decontaminate.longest_matches(d, none).count() == 0
        assert decontaminate.clean_documents(d, none).count() == len(docs)


def test_one_passage_in_many_documents_and_items(spark):
    """A passage that thousands of documents and hundreds of items share."""
    passage = " ".join(f"p{k}" for k in range(50))
    docs = [(k, f"own{k} {passage} end{k}") for k in range(3000)]
    items = [(k, f"q{k} {passage} r{k}") for k in range(400)]
    d, b = _frames(spark, docs, items)
    rows = decontaminate.digests(d, b).collect()
    assert {(r.n_words, r.n_hit, r.n_items) for r in rows} == {(52, 50, 400)}
