"""Plain versions of what SQL can't express: the stream and schedule of the mix, the forest and its verdicts, what counts as personal."""

import collections
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import mixing, pii, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def _mix_case(spark, odd):
    docs = _table(spark, "documents").select("doc_id", "text", "source")
    if odd:
        rows = [(9001, None, "src0"), (9002, "", None), (9003, "one two", None), (9004, "w " * 7, "tiny"), (9005, "w " * 7, "tiny"), (9005, "w " * 9, "tiny"), (None, "a b c", "src0")]
        docs = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame(rows, docs.schema))
    return docs


@pytest.mark.parametrize("odd", [False, True])
def test_words_taken_and_the_schedule(spark, odd):
    """taken: the words of the first ``wanted`` of a source's stream, read twice over. The schedule: golden-ratio points through the targets."""
    docs = _mix_case(spark, odd)
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source, r.h % 2**64) for r in docs.select("*", F.xxhash64(F.col("doc_id").alias("key")).alias("h")).collect()]
    names = sorted({s for _, _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, _, s, _ in rows) else [])
    sizes = [sum(n for _, n, s, _ in rows if s == name) for name in names]
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    left, open_, wanted = 1.5 * sum(sizes), dict(enumerate(weights)), {}
    while open_:
        total = sum(open_.values())
        full = [k for k, w in open_.items() if left * w / total > 2 * sizes[k]]
        wanted |= {k: 2.0 * sizes[k] for k in full} if full else {k: left * w / total for k, w in open_.items()}
        left = 1.5 * sum(sizes) - sum(wanted.values())
        open_ = {k: w for k, w in open_.items() if k not in wanted}
    target = [wanted[k] for k in range(len(names))]
    words = [max(1, round(t)) if t > 0 else 0 for t in target]
    want = []
    for k, name in enumerate(names):
        at = 0
        for key, n, _, _ in sorted((r for r in rows if r[2] == name), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1])):
            reads = [max(0, min(words[k], at + e * sizes[k] + n) - (at + e * sizes[k])) for e in (0, 1)]
            want.append((key, n, sizes[k], round(target[k], 6), sum(reads)))
            at += n
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    made, schedule = mixing.mix(docs)
    pieces = schedule.collect()
    by_source = collections.defaultdict(list)
    for p in pieces:
        by_source[p.sid].append((p.slot, p.start + p.epoch * sizes[p.sid] + p.first, p.words))
    for sid, some in by_source.items():  # slot by slot, a source's stream goes on without a gap
        at = 0
        for _, begin, n in sorted(some):
            assert begin == at
            at += n
        assert at == words[sid]
    block = max(1, int(sum(target) // mixing.SLOTS))
    ends = np.cumsum(target) / sum(target)
    for p in pieces[:: max(1, len(pieces) // 500)]:
        point = (p.slot * 0x9E3779B97F4A7C15 % 2**64 >> 11) / 2**53
        falls = int(min(np.searchsorted(ends, point, "right"), len(ends) - 1))
        assert p.sid == falls or len({q.slot for q in pieces if q.sid == p.sid}) == 1
    assert block == 1 or max(p.slot for p in pieces) <= sum(target) // block + 1


def _path(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(rows, rng, level, depth):
    """(feature, value, below, above) or a leaf's path length."""
    spread = [f for f in range(len(rows[0])) if max(r[f] for r in rows) > min(r[f] for r in rows)]
    if level >= depth or not spread:
        return level + _path(len(rows))
    f = int(rng.choice(np.array(spread)))
    value = rng.uniform(min(r[f] for r in rows), max(r[f] for r in rows))
    above = _tree([r for r in rows if r[f] > value], rng, level + 1, depth)
    return f, value, _tree([r for r in rows if r[f] <= value], rng, level + 1, depth), above


def _walk(tree, row):
    while isinstance(tree, tuple):
        f, value, below, above = tree
        tree = below if row[f] <= value else above
    return tree


def test_verdicts_of_a_plain_forest(spark):
    """A forest grown row by row with the same random numbers, a threshold tried cut by cut."""
    docs, labels = _table(spark, "documents"), _table(spark, "labels")
    rows = quality.judge(docs, quality.fit_forest(docs, labels)).join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left").withColumn("h", F.xxhash64("doc_id")).collect()

    def ratios(r):
        words, chars, lines = max(1, r.n_words), max(1, r.word_chars), max(1, r.n_lines)
        return (r.word_chars / words, math.sqrt(r.n_symbols / words), math.sqrt(r.n_repeat_words / words), math.sqrt(r.n_capitals / chars), r.n_marks / words, math.log1p(words / lines), r.n_distinct_words / words**0.8)

    fit = [r for r in sorted(rows, key=lambda r: (r.h, r.doc_id, *[r[c] for c in quality.COUNTS])) if r.quality is not None and r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    x, bad = [ratios(r) for r in fit], [r.quality == 0 for r in fit]
    assert 0 < sum(bad) < len(bad)
    rng = np.random.default_rng(0)
    good_at, bad_at = np.array([k for k, b in enumerate(bad) if not b]), np.array([k for k, b in enumerate(bad) if b])
    n = min(quality.TREE_ROWS, len(x))
    few = min(len(bad_at), max(1, round(quality.BAD_SHARE * n)))
    trees = []
    for _ in range(quality.TREES):
        picked = [*rng.choice(bad_at, min(few, len(bad_at)), replace=False), *rng.choice(good_at, min(n - few, len(good_at)), replace=False)]
        trees.append(_tree([x[k] for k in picked], rng, 0, 3 * math.ceil(math.log2(max(2, n))) // 2))
    score = lambda row: 2 ** (-(sum(_walk(t, row) for t in trees) / len(trees)) / _path(n))
    scores = [score(row) for row in x]
    good = sorted(s for s, b in zip(scores, bad, strict=True) if not b)
    floor = good[max(0, math.ceil(len(good) * (1 - quality.MAX_LOSS)) - 1)]
    share = lambda cut, which: sum(s > cut for s, b in zip(scores, bad, strict=True) if b == which) / sum(b == which for b in bad)
    cuts = sorted({s for s in scores if s >= floor - 1e-12})
    best = max(cuts, key=lambda c: (round(share(c, True) - share(c, False), 12), c))
    over = [s for s in scores if s > best]
    threshold = (best + min(over)) / 2 if over else best
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and abs(r.anomaly - score(ratios(r))) < 1e-9
        assert r.kept == (not failed and score(ratios(r)) <= threshold) or abs(score(ratios(r)) - threshold) < 1e-9
    assert 0 < sum(r.kept for r in rows) < len(rows)


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _iban(text):
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_personal_data_found_by_plain_rules_is_gone(spark):
    """Validity by its public definitions: Luhn's sum and the card networks' first digits, the remainder of an IBAN, octets, calendar days."""
    made = [
        (5001, "card 4111 1111 1111 1111 or 5500-0000-0000-0004, not 4111 1111 1111 1112"), (5002, "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, not DE89370400440532013001"),
        (5003, "from 192.168.10.254 to 10.0.0.1 not 999.1.1.1"), (5004, "born 1984-02-29 and 31.12.1999"), (5005, "ssn 078-05-1120 mail a.b@example.org call +1 (212) 555-0199"),
    ]
    docs = _table(spark, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    seen = collections.Counter()
    for r in pii.pseudonymise(docs.withColumn("was", F.col("text")), "k").collect():
        was, now = r.was or "", r.text or ""
        surely = [("mail", v) for v in re.findall(r"[\w.]+@[\w.-]+\.[a-z]{2,}\b", was)]
        surely += [("card", v) for v in re.findall(r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){3}(?![\d-])", was) if _luhn(re.sub(r"\D", "", v)) and re.match(r"4|5[1-5]|6011|65|35", v)]
        surely += [("iban", v) for v in re.findall(r"\b[A-Z]{2}\d{2}[A-Z0-9]{14,18}\b", was) if _iban(v)]
        surely += [("ip", v) for v in re.findall(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", was) if all(int(o) < 256 and str(int(o)) == o for o in v.split("."))]
        for kind, v in surely:
            seen[kind] += 1
            assert v not in now, (r.doc_id, kind, v)
            shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
            if kind in ("card", "iban"):
                assert any(shape(v) == shape(now[k : k + len(v)]) for k in range(len(now) - len(v) + 1))
    assert seen["card"] >= 2 and seen["iban"] >= 1 and seen["ip"] >= 2 and seen["mail"] >= 1
    odd = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(made, "doc_id long, text string"), "k").collect()}
    assert "4111 1111 1111 1112" in odd[5001] and "DE89370400440532013001" in odd[5002] and "999.1.1.1" in odd[5003] and "1984-02-29" not in odd[5004]


def test_forest_of_all_labelled_rows(spark, monkeypatch):
    """Many rows: every tree draws from all of them, and the threshold is the one that a plain count over all scores gives."""
    rng = np.random.default_rng(4)
    text = lambda k, bad: " ".join(("#" if bad else "") + "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60))
    docs = spark.createDataFrame([(k, text(k, k % 20 == 0)) for k in range(400)], "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (F.col("doc_id") % 20 != 0).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "LOCAL", 100)
    monkeypatch.setattr(quality, "TREE_ROWS", 64)
    forest = quality.fit_forest(docs, labels)
    assert len(forest.trees) == quality.TREES and len({t[1].tobytes() for t in forest.trees}) == quality.TREES
    rows = quality.digests(docs, labels).collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(0, 400, 20))
    again = quality.fit_forest(docs.repartition(5), labels)
    assert again.threshold == forest.threshold and all(np.array_equal(a, b) for s, t in zip(again.trees, forest.trees, strict=True) for a, b in zip(s, t, strict=True))
    step, bad = np.ceil(np.array([r.anomaly for r in rows]) * quality.GRID).astype(int), np.array([r.doc_id % 20 == 0 for r in rows])
    good = np.sort(step[~bad])
    cuts = [c for c in sorted(set(step)) if c >= good[math.ceil(len(good) * (1 - quality.MAX_LOSS)) - 1]]
    best = max(cuts, key=lambda c: (round((step[bad] > c).mean() - (step[~bad] > c).mean(), 12), c))
    over = step[step > best]
    assert forest.threshold == ((best + over.min() - 1) / 2 if len(over) else best) / quality.GRID
