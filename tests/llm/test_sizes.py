"""Work that grows with the input and not with its square: many turns, matches, equal rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import chat, ngram_join, secrets, suffix_dedup
from lodeseek.llm.common import running

from .test_corpus import _jaccard


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 15, 16, 17, 1000])]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, v array<int>").select("k", running(F.col("v")).alias("s")).collect()}
    assert got == {k: [sum(v[:i]) for i in range(len(v))] for k, v in rows}


def test_twenty_thousand_turns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é [TEXT] "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    done = chat.format_conversations(rows)
    got = done.select("formatted", "loss_spans", F.size(chat.read_back(F.col("formatted"))).alias("n"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.time() - began < 30
    want = [k for k in range(n) if k % 3]
    assert got.n == n and got.loss == [f"é [TEXT] {k}" for k in want] and [s.turn for s in got.loss_spans] == want
    assert all(got.formatted[s.start : s.end] == chat_escaped(k) for s, k in zip(got.loss_spans[::997], want[::997], strict=True))


def chat_escaped(k):
    return f"é [\\TEXT] {k}"


def test_forty_thousand_matches_in_a_text(spark):
    n = 40_000
    text = " ".join(f"{k:032x}" for k in range(n))
    began = time.time()
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 30
    assert [(s.start, s.end) for s in row.secrets if s.kind == "hex"] == [(33 * k, 33 * k + 32) for k in range(n)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_four_thousand_equal_rows(spark, keep):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(600))
    rows = [(1, text)] * 4000 + [(k + 2, text[:2000] + f" other {k} " + text[2500:]) for k in range(20)]
    began = time.time()
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    assert time.time() - began < 60 and len(got) == 4020
    whole = [r.n_removed for r in got if r.doc_id == 1]
    assert len(whole) == 4000 and set(whole) == {len(text) if keep == "none" else 0}
    assert all(r.n_removed >= 2000 + len(text) - 2500 for r in got if r.doc_id != 1)


def test_long_lists_are_paired_block_by_block(spark, monkeypatch):
    """Documents of one template, below and above the threshold, in lists of many blocks: the components are those of all pairs."""
    rng = random.Random(6)
    head = [f"t{k}" for k in range(40)]
    rows = [(k, " ".join(head[: rng.choice([8, 20, 40])] + [f"w{rng.randrange(60 if k % 3 else 10**6)}" for _ in range(rng.choice([2, 4, 12, 40]))])) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(60)]
    want = _jaccard(rows)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
    for long_list in (2, 10**6):  # with and without the rounds that come first
        monkeypatch.setattr(ngram_join, "LONG", long_list)
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_documents_of_one_template_do_not_all_meet(spark, monkeypatch):
    """Texts that share much of their prefixes and yet are too unlike: the sketches leave few of their meetings."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for n in range(60):
        words = list(base)
        for k in rng.sample(range(400), 19):
            words[k] = f"x{n}_{k}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, t) for n, t in rows[:2]] + [(200, rows[2][1] + " more")]
    met, plain = [], ngram_join._met
    monkeypatch.setattr(ngram_join, "_met", lambda *args: met.append(out := plain(*args).localCheckpoint()) or out)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    like = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(60) for b in range(a)]
    assert max(like) < 0.75
    assert got == {n: n for n in range(60)} | {100: 0, 101: 1, 200: 2}
    assert sum(m.count() for m in met) < len(like)
