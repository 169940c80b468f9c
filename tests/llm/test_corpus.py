"""Operators over a whole corpus, against brute force."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import components, context_mixing, mixing, near_vectors, ngram_join, suffix_dedup

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = "doc_id long, text string"


def _rows():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return rows + [(None, rows[5][1]), (None, "a b c"), (7, "x y z"), (7, "x y z"), (8, ""), (9, None), (10**6, rows[3][1]), (10**6, rows[4][1])]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def _classes(n, linked):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        up[top(a)] = top(b)
    return [top(x) for x in range(n)]


def _least(keys, tops):
    members = collections.defaultdict(list)
    for k, t in zip(keys, tops, strict=True):
        members[t].append(k)
    return [min((k for k in members[t] if k is not None), default=None) for t in tops]


def _jaccard(rows):
    sets = []
    for _, text in rows:
        w = _words(_lower(text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    index, linked = collections.defaultdict(list), []
    for k, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in index[x])
        linked += [(k, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
        for x in s:
            index[x].append(k)
    least = _least([k for k, _ in rows], _classes(len(rows), linked))
    return sorted(str((k, len(s), c)) for (k, _), s, c in zip(rows, sets, least, strict=True))


def _near_copies(n):
    rng = random.Random(0)
    base = [f"w{k}" for k in range(80)]
    out = []
    for k in range(n):
        some = list(base)
        for _ in range(rng.randrange(0, 6)):
            some[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        out.append((5000 + k, " ".join(some)))
    return out


def test_jaccard_classes(spark, monkeypatch):
    for rows, long_list in ((_rows(), 8), (_near_copies(150), 2)):
        monkeypatch.setattr(ngram_join, "LONG", long_list)
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, TEXTS))
        assert sorted(str(tuple(r)) for r in got.collect()) == _jaccard(rows)
    assert ngram_join.jaccard_components(spark.createDataFrame([], TEXTS)).count() == 0


def test_sets_of_one_group_that_meet_another_group_on_a_late_token(spark):
    """A and B have one prefix, whose last shingle the document "q" holds too; 95 of their 100 shingles are the same."""
    rare, often = [f"p{k}" for k in range(25)], [f"c{k}" for k in range(69)]
    a, b = ([f"{x}{k}" for k in range(5)] for x in "ab")
    rows = [(1, rare + ["q"] + often + a), (2, rare + ["q"] + often + b), (3, ["q"])]
    rows += [(10 + k, often + a + b + [f"f{k}_{j}" for j in range(200)]) for k in range(4)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], TEXTS)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, size=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 10: 10, 11: 11, 12: 12, 13: 13}


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (4, None), (4, None), (5, " "), (6, "else")]
    got = ngram_join.deduplicate(spark.createDataFrame([(*r, "x") for r in rows], TEXTS + ", mark string")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={k}, text={t!r}, mark='x')" for k, t in [(1, "A b c d e f"), (4, None), (4, None), (5, " "), (6, "else")])


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (None, 3), (200, 100)], "a long, b long")
    assert {r.id: r.component for r in components.connected_components(edges).collect()} == {k: 0 for k in range(1, 41)} | {101: 100, 200: 100}


def _repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append(str((key, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def _repeating_rows():
    rng = random.Random(1)
    base = ["".join(rng.choice("ab c\né") for _ in range(400)) for _ in range(6)]
    rows = [(k, "".join((b := rng.choice(base))[(s := rng.randrange(300)) : s + rng.randrange(10, 150)] for _ in range(rng.randrange(1, 7)))) for k in range(200)]
    return rows + [(None, base[0]), (None, base[0]), (300, ""), (301, None), (302, "ab" * 200)]


@pytest.mark.parametrize("hot", [1000, 8, 3])
def test_repeated_strings(spark, monkeypatch, hot):
    """With all anchors in one bucket each, with pieces in buckets, and with single starts."""
    rows = _repeating_rows()
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, TEXTS), length=40).collect()
    assert sorted(str((*r[:4], bytes(r[4]))) for r in got) == _repeats(rows, 40)


@pytest.mark.parametrize("hot", [1000, 3])
def test_all_but_the_first_of_repeated_strings(spark, monkeypatch, hot):
    """Every start but the first in (key, hash, position) order goes; rows have keys of their own."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(k, t) for k, (_, t) in enumerate(_repeating_rows())]
    seen, want = set(), {}
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 39):
            if (x := b[at : at + 40]) in seen:
                gone[at : at + 40] = b"\1" * 40
            seen.add(x)
        want[k] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, TEXTS), length=40, keep="first")
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == want


def test_repeats_in_a_long_text_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    rows = [(1, text), (2, "x" + text[1_048_000:1_049_500]), (3, text[:399])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, "y") for r in rows], TEXTS + ", kept string"))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()} == {1: (1_300_000, 1500, 1), 2: (1501, 1500, 1), 3: (399, 0, 0)}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], TEXTS)).count() == 0


def test_longest_factors():
    rng = np.random.default_rng(3)
    for n, letters, length in ((300, 2, 12), (500, 3, 30), (40, 1, 9), (1, 2, 5)):
        raw = rng.integers(97, 97 + letters, n, dtype=np.uint8)
        at = np.sort(rng.choice(n, max(1, n // 2), replace=False))
        text = bytes(raw) + bytes(length)
        share = lambda i, j: next((k for k in range(length) if text[i + k] != text[j + k]), length)  # noqa: B023, E731
        previous, following = suffix_dedup.factors(raw, at, length)
        for k, i in enumerate(at.tolist()):
            if i + length <= n:
                assert previous[k] == max((share(i, j) for j in at[:k].tolist()), default=0)
                assert following[k] == max((share(i, j) for j in at[k + 1 :].tolist()), default=0)


def test_the_first_of_repeated_strings_may_stay(spark):
    rows = [(1, "x" + "abcdefghij" * 3), (2, "y" + "abcdefghij" * 3)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, TEXTS), length=30, keep="first").collect()}
    assert got == {1: rows[0][1].encode(), 2: b"y"}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    rows = [(k, (base[k % 20] + rng.normal(size=16) * (0.05 + 0.05 * (k % 7))).tolist()) for k in range(300)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [1.0, None]), (None, rows[3][1]), (1004, rows[3][1][:8]), (1005, [2 * x for x in rows[3][1][:8]]), (1009, []), (5, rows[5][1])]
    x = [np.array(v, np.float32).astype(float) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    linked = [(a, b) for a in range(len(x)) for b in range(a) if x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.9]
    n = collections.Counter(k for pair in linked for k in pair)
    least = _least([k for k, _ in rows], _classes(len(rows), linked))
    want = sorted(str((k, n[i], c, k is not None and k == c)) for i, ((k, _), c) in enumerate(zip(rows, least, strict=True)))
    for block, leaf in ((4096, 512), (40, 16)):
        got = near_vectors.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block, leaf=leaf)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert near_vectors.near_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(spark):
    rows = _rows() + [(4, " a"), (3, "b\x00 c \x00"), (6, "x" * 3000)]
    got = context_mixing.score_documents(spark.createDataFrame(rows, TEXTS)).collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    words = [_words(_lower(t)) for _, t in rows]
    count = collections.Counter(w for (k, _), ws in zip(rows, words, strict=True) if not held(k) for w in ws)
    ends = sum(not held(k) for k, _ in rows)
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda ws: round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)), 5)
    want = sorted(str((k, held(k), len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n, base(ws))) for (k, _), ws in zip(rows, words, strict=True))
    assert sorted(str((*r[:5], round(r.base_score, 5))) for r in got) == want
    assert all(r.score < 0 for r in got)
    mean = [r.bits_per_byte for r in got if r.held_out and r.n_tokens > 100]
    assert sum(mean) / len(mean) < 3.5  # raw bytes of such text have over 4 bits in order 0
    assert context_mixing.score_documents(spark.createDataFrame([], TEXTS)).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over the next byte after a known prefix, by the chain of bits."""
    mixer, tables = context_mixing.Mixer.fresh(), [np.zeros((1 << 14, 2), np.uint16) for _ in context_mixing.ORDERS]
    rng = np.random.default_rng(0)
    for t in tables:
        t[:] = rng.integers(0, 50, t.shape)
    contexts = rng.integers(0, 2**63, (len(tables), 1), dtype=np.uint64).repeat(256, 1)
    total = np.ones(256)
    for bit, node, value in context_mixing._bits(np.arange(256, dtype=np.uint8)):
        p = mixer.predict(*context_mixing._seen(tables, contexts, node), bit)[-1]
        total *= np.where(value == 1, p, 1 - p)
    assert abs(total.sum() - 1) < 1e-6


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 1, 1]) == [15, 15, 15]
    got = mixing.targets([100, 10, 10], [5, 2, 1])
    assert got[1:] == [20, 20] and math.isclose(sum(got), 180)
    assert mixing.targets([0, 5], [5, 2]) == [0, 7.5] and mixing.targets([], []) == []


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.digests(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    for _, some in got.groupby("source"):
        assert abs(some.taken.sum() - some.target.iloc[0]) <= 0.02 * some.target.iloc[0] + 20
    again = mixing.digests(docs.repartition(3)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_small_sources_reach_their_targets_in_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 16)
    sizes = {"hot": 200, **{f"s{k}": k for k in range(1, 6)}}
    rows = [(k, "w " * 7, name) for name, n in sizes.items() for k in range(n)]
    got = mixing.digests(spark.createDataFrame(rows, TEXTS + ", source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 6 and all(r.taken == round(r.target) for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c d e", None), (3, "", "y")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], TEXTS + ", source string, size string")
    got = {(r.doc_id, r["size"], r.source_size) for r in mixing.digests(docs).collect()}
    assert got == {(1, 2, 4), (2, 0, 4), (None, 3, 3), (3, 0, 0)}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.digests(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = corpus_pipeline.run(spark, SF)
    rows = done.collect()
    assert rows and all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
