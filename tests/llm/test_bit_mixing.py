"""Scores of which every bit is predicted by mixing."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from lodeseek.llm import bit_mixing, queries
from lodeseek.llm import context_mixing as cm


def _refined(mixer, inputs, gate):
    dot = max(-12.0, min(12.0, sum(x * w for x, w in zip(inputs, mixer.weights[gate].tolist(), strict=True))))
    bucket = min(cm.BUCKETS - 1, max(0, int(dot / 0.5 + cm.BUCKETS / 2)))
    seen = (mixer.ones[gate, bucket] + 0.02) / (mixer.seen[gate, bucket] + 0.04)
    return min(1 - 1e-6, max(1e-6, 0.5 / (1 + math.exp(-dot)) + 0.5 * seen))


def _entries(seed=3, groups=40, width=12):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.zipf(1.4, 3000) % groups * (1 << width) + rng.integers(0, 1 << width, 3000))
    return keys >> width, (keys & ((1 << width) - 1)).astype(np.uint64), rng.integers(1, 9, len(keys))


@pytest.mark.parametrize("shared", [True, False])
def test_words_after_a_word_are_told_by_mixed_bits(monkeypatch, shared):
    """Against a plain walk down the bits of each entry, with the weights that were learnt; a group's probabilities sum to one."""
    made = []
    fresh = bit_mixing._trie_mixer
    monkeypatch.setattr(bit_mixing, "_trie_mixer", lambda: made.append(fresh()) or made[-1])
    width = 16
    group, path, times = _entries(width=width)
    costs = bit_mixing._costs(group, path, times, width, shared=shared)
    for g in np.unique(group):
        assert abs(sum(2.0 ** -costs[0][group == g]) - 1) < 1e-5
    entries = list(zip(group.tolist(), path.tolist(), times.tolist(), strict=True))
    size = lambda x: min(15, int(x).bit_length())
    moved = False
    for n in range(0, len(entries), 37):
        g, p, t = entries[n]
        for less in (0, 1) if t > 1 else (0,):
            want = 0.0
            for d in range(width):
                here = [e for e in entries if e[0] == g and e[1] >> (width - d) == p >> (width - d)]
                sides = [[e for e in here if e[1] >> (width - 1 - d) & 1 == b] for b in (0, 1)]
                if not all(sides):
                    continue
                b = p >> (width - 1 - d) & 1
                around = [e for e in entries if shared and e[1] >> (width - d) == p >> (width - d)]
                seen = [sum(e[2] for e in x) - less * (k == b) for k, x in enumerate(sides)]
                every = [max(0, sum(e[2] for e in around if e[1] >> (width - 1 - d) & 1 == k) - less * (k == b)) for k in (0, 1)]
                stretch = lambda z, o: math.log(o + 0.4) - math.log(z + 0.4)
                one = _refined(made[0], [stretch(*seen), stretch(*map(len, sides)), stretch(*every), 0.3], size(sum(seen)) * 16 + size(len(here)))
                want -= math.log2(one if b else 1 - one)
            assert abs(costs[less][n] - want) < 2e-3 * max(1, want)
            total = sum(e[2] for e in entries if e[0] == g)
            moved |= less == 0 and abs(costs[0][n] + math.log2(t / total)) > 0.05
    assert moved  # not the share of the counts


def test_bits_of_events_sum_to_one():
    rng = np.random.default_rng(0)
    mixer, table = bit_mixing._event_mixer(), rng.integers(0, 50, (1 << bit_mixing.EVENT_BITS, 2)).astype(float)
    for kind, width in ((0, 5), (1, 9), (2, 3)):
        n = 1 << width
        every = bit_mixing.Events.of((kind, 7, 3, width, np.arange(n), np.arange(n)))
        total = np.zeros(n)
        for at, slots, gate, value in every.bits():
            *_, p = mixer.mix(cm._stretched(table, slots), gate)
            total[at] += np.log(np.where(value == 1, p, 1 - p))
        assert abs(np.exp(total).sum() - 1) < 1e-6


def test_graded_counts_keep_their_classes():
    x = np.arange(1, 5000)
    got = bit_mixing._graded(x)
    for less in (0, 1):
        assert (bit_mixing._grade((got - less).astype(float)) == bit_mixing._grade((x - less).astype(float))).all()


def test_scores_of_texts(spark, tmp_path):
    """The query's scores are those of mixed bits: they differ from those of count shares and tell copies."""
    rng = np.random.default_rng(5)
    fresh = [(10**6 + k, " ".join(f"w{x}" for x in rng.zipf(1.3, 120) % 900)) for k in range(60)]
    rows = fresh + [(k + 10**6, t) for k, t in fresh[:20]] + [(1, None), (2, ""), (3, "A  a\tb\n"), (4, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_context_mixing(spark, str(tmp_path)).collect()}
    old = {r.doc_id: r for r in cm.score_documents(docs).collect()}
    assert got.keys() == old.keys()
    for k, r in got.items():
        assert r[:5] == old[k][:5] and abs(r.base_score - old[k].base_score) < 1e-9 and r.score < 0
    assert any(abs(r.score - old[k].score) > 0.5 for k, r in got.items())
    copied = [got[k].bits_per_byte for k, _ in fresh[:20] if not got[k].held_out and not got[k + 10**6].held_out]
    single = [got[k].bits_per_byte for k, _ in fresh[20:] if not got[k].held_out]
    assert max(copied) < min(single)


def test_held_out_texts_beat_the_base(spark):
    rows = queries.op5_context_mixing(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("score", "base_score").first()
    assert rows[0] > rows[1]


def test_every_word_has_its_bits(spark, monkeypatch):
    """Costs of words that training has, and events, against a plain count of which words are told how."""
    taken = {}
    scored = bit_mixing._scored

    def keep(counted, tables, model, totals, kind):
        taken.update(rows=counted.collect(), totals=totals)
        return scored(counted, tables, model, totals, kind)

    monkeypatch.setattr(bit_mixing, "_scored", keep)
    texts = {k: t for k, t in enumerate(["the cat sat on the mat the cat ran", "a dog sat on the mat", "the cat sat", "zebra zebra the", "on the dog the cat sat"] * 4)}
    bit_mixing.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    pairs, counts = collections.Counter(), collections.Counter()
    words = {k: re.split(" ", t) for k, t in texts.items()}
    held = {k: cm.zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    for k, w in words.items():
        if not held[k]:
            counts.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    n = 0
    for row in taken["rows"]:
        told = cm._choices(row.asDict(), taken["totals"], shares=False)
        costs, events, at = cm._values(row["costs"], "<u2"), bit_mixing._events(row.asDict(), told), 0
        gaps = {int(w): 1 << int(e) for w, e, k in zip(events.word, events.code, events.kind, strict=True) if k == bit_mixing._EXPONENT}
        for w, c, k in zip(events.word, events.code, events.kind, strict=True):
            if k == bit_mixing._DISTANCE:
                gaps[int(w)] += int(c)
        for k in row["key"]:
            for place, w in enumerate(words[k]):
                own, before = int(not held[k]), words[k][place - 1] if place else None
                level = 0 if pairs[before, w] > own else 1 if w in words[k][:place] else 2 if counts[w] > own else 3
                assert told["level"][at] == level
                if level == 1:
                    assert gaps[at] == place - max(p for p in range(place) if words[k][p] == w)
                assert level in (1, 3) or costs[at] > 0 or sum(a == before for a, _ in pairs) == 1
                at, n = at + 1, n + 1
    assert n == sum(map(len, words.values()))
