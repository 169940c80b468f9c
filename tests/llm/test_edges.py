"""Extra columns with clashing names, empty tables and very long texts for every operator; the pipeline stage by stage."""

import base64
import collections
import math
import os
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import bpe, chat, context_mixing, mixing, near_vectors, ngram_join, pii, quality, secrets, suffix_dedup

from .test_corpus import _jaccard

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators use for results and inside.
NAMES = ["key", "mark", "size", "n", "id", "grp", "slice", "kept", "bytes", "ids", "n_tokens", "n_words", "word_chars", "score", "held_out", "spans", "secrets", "n_bytes", "pii_spans", "quality", "turns", "formatted", "node", "packed", "links", "idx", "start", "target", "N_Removed"]


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


OPERATORS = {
    "secrets": lambda spark, docs: secrets.digests(docs),
    "context_mixing": lambda spark, docs: context_mixing.score_documents(docs).drop("score", "bits_per_byte"),  # learnt side by side
    "bpe": lambda spark, docs: bpe.digests(docs, BPE),
    "mixing": lambda spark, docs: mixing.digests(docs),
    "ngram_join": lambda spark, docs: ngram_join.jaccard_components(docs),
    "suffix_dedup": lambda spark, docs: suffix_dedup.remove_repeats(docs, length=60),
    "quality": lambda spark, docs: quality.digests(docs, _labels(spark)),
    "pii": lambda spark, docs: pii.pseudonymise(docs, "k").select("doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(spark, name):
    docs = _documents(spark).where("doc_id % 4 = 1")
    more = docs.withColumns({c: F.lit("other") for c in NAMES})
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(OPERATORS[name](spark, more)) == rows(OPERATORS[name](spark, docs))
    empty = OPERATORS[name](spark, more.limit(0))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](spark, docs).columns


def test_clashing_columns_of_vectors_and_conversations(spark):
    rows = lambda df: sorted(str(r) for r in df.collect())
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    assert rows(near_vectors.near_components(vectors.withColumns({c: F.lit("other") for c in NAMES}))) == rows(near_vectors.near_components(vectors))
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows(chat.digests(turns.withColumns({c: F.lit("other") for c in NAMES}))) == rows(chat.digests(turns))


def test_very_long_texts(spark):
    """Texts over the slices in which operators work."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("etaoinsh"), 5)) for _ in range(3000)])
    text = " ".join(rng.choice(words, 250_000))
    rows = [(1, text, "a"), (2, text + " end", "a"), (3, "mail jo@example.com " + text[:50], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r["size"] for r in mixing.digests(docs).collect()} == {k: len(t.split()) for k, t, _ in rows}
    assert {r.doc_id: r.n_words for r in quality.digests(docs, _labels(spark).limit(0)).collect()} == {k: len(t.split()) for k, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in context_mixing.score_documents(docs).collect()} == {k: len(t.split()) + 1 for k, t, _ in rows}
    done = bpe.encode(docs, BPE, decoded="back").collect()
    assert all(bytes(r.back).decode() == r.text for r in done)
    assert {r.doc_id: r.text == dict((k, t) for k, t, _ in rows)[r.doc_id] for r in pii.pseudonymise(docs, "k").collect()} == {1: True, 2: True, 3: False}
    found = secrets.digests(docs).collect()
    assert len(found) == 3 and not any(r.n_access for r in found)


def test_pseudonyms_are_undone_by_the_inverse_permutation(spark):
    """Over all documents: the inverse brings the text back, up to zeros before days and months."""
    back = pii.Pseudonyms(corpus_pipeline.PII_KEY)
    back.move = pii.Permutation(corpus_pipeline.PII_KEY.encode()).undo
    flat = lambda t: re.sub(r"(?<![0-9])0(?=[0-9][/.])", "", t)
    seen = 0
    for r in pii.pseudonymise(_documents(spark).withColumnRenamed("lang", "was").withColumn("was", F.col("text")), corpus_pipeline.PII_KEY).collect():
        if not r.text:
            continue
        seen += len(r.pii_spans)
        assert flat(back.replace(r.text)[0]) == flat(r.was)
        # A plainer finder of what is surely personal: none of it is left.
        for v in re.findall(r"[\w.]+@[\w.-]+\.\w+|\b\d{3}-\d{2}-\d{4}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b(?:\d{4}[ -]){3}\d{4}\b", r.was):
            valid = len(v) != 11 and not re.fullmatch(r"(?:\d{4}[ -]){3}\d{4}", v) or pii.Pseudonyms("x").of("card" if len(v) == 19 else "ssn", v)
            assert not valid or v not in r.text
    assert seen > 5


@pytest.mark.parametrize("date", ["0001-01-01", "1066-10-14", "1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "9999-12-31"])
def test_dates_of_any_year(date):
    names, back = pii.Pseudonyms("key"), pii.Pseudonyms("key")
    back.move = pii.Permutation(b"key").undo
    made = names.of("date", date)
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", made) and back.of("date", made) == date
    assert ("1900" <= made < "2100") == ("1900" <= date < "2100")


def test_forest_on_labels_that_it_has_not_seen(spark):
    """Fitted on one half of the labelled rows of a larger table, measured on the other half."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the larger table isn't there")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.digests(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r for r in judged if r.quality == q] for q in (1, 0))
    print("held out: kept good", sum(r.kept for r in good), len(good), "rejected bad", sum(not r.kept for r in bad), len(bad))
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_pipeline_stage_by_stage(spark):
    """Each stage on what its predecessor kept, against a plain version of its rule."""
    docs = _documents(spark)
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, SF).toPandas()
    verdict = quality.digests(docs, _labels(spark)).where("kept").toPandas()
    assert list(good.columns) == names and sorted(good.doc_id) == sorted(verdict.doc_id)

    frame = lambda some: spark.createDataFrame(some, docs.schema)
    once = stage["n-gram Jaccard join"](spark, frame(good), SF).toPandas()
    classes = [eval(x) for x in _jaccard(list(zip(good.doc_id.tolist(), good.text, strict=True)))]  # noqa: S307
    assert sorted(once.doc_id) == sorted({c for _, n, c in classes if n} | {k for k, n, _ in classes if not n})

    hidden = stage["personal data"](spark, frame(once), SF).toPandas()
    by_id = dict(zip(once.doc_id, once.text, strict=True))
    own = pii.Pseudonyms(corpus_pipeline.PII_KEY)
    assert {k: t for k, t in zip(hidden.doc_id, hidden.text, strict=True)} == {k: own.replace(t)[0] for k, t in by_id.items()}
    assert (hidden.n_chars == hidden.text.str.len()).all()

    mix = stage["source mix"](spark, frame(hidden), SF).toPandas()
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in zip(hidden.doc_id, hidden.text, strict=True)}
    of = dict(zip(hidden.doc_id, hidden.source, strict=True))
    sources = sorted(set(of.values()))
    sizes = [sum(n for k, n in words.items() if of[k] == s) for s in sources]
    for s, n, want in zip(sources, sizes, mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sources))]), strict=True):
        largest = max(words[k] for k in words if of[k] == s)
        got = sum(words[k] for k in mix.doc_id if of[k] == s)  # only the last document of the stream is rounded
        assert abs(got - want) <= largest / 2 + 1 and got <= 2 * n
    assert max(collections.Counter(mix.doc_id).values()) <= 2
    assert list(mix.columns) == names and mix.text.tolist() == mix.doc_id.map(dict(zip(hidden.doc_id, hidden.text, strict=True))).tolist()

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = stage["byte-level BPE"](spark, frame(mix), SF).collect()
    texts = dict(zip(mix.doc_id, mix.text, strict=True))
    assert len(done) == len(mix)
    for r in done:
        assert r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    docs = _documents(spark)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 60, None, None, 120)], docs.schema)
    for k, some in enumerate((docs.limit(0), odd)):
        folder = f"{tmp_path}/{k}"
        some.write.parquet(f"{folder}/documents.parquet")
        _labels(spark).write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert all(r.round_trip for r in rows)


def test_score_is_the_sum_of_bit_predictions(spark, monkeypatch):
    """Against a plain walk over every bit of every word, with counts of its own and the weights that the model learnt."""
    learnt = {}
    scored = context_mixing._scored

    def keep(counted, tables, model, totals, kind):
        learnt.update(tables=tables.value, model=model.value)
        return scored(counted, tables, model, totals, kind)

    monkeypatch.setattr(context_mixing, "_scored", keep)
    texts = ["The cat sat.\nThe cat  ran.", "the cat", "a Dog sat\ton the mat ", "", "é zebra!", "the the the cat sat on the mat", "  "]
    rows = [(k, t if k % 3 else t + f" only{k} {k}") for k, t in enumerate(texts * 5)] + [(100, None), (101, " ".join(f"the w{k % 40}" for k in range(300)))]
    got = {r.doc_id: r for r in context_mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tables, model = learnt["tables"], learnt["model"]
    pieces = {}
    for key, text in rows:
        raw = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        cuts = [m.start() for m in re.finditer(rb"[\x20\x09-\x0D]", raw)]
        pieces[key] = [(raw[a:b], raw[b] if b < len(raw) else 0) for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(raw)], strict=True)]
    train = [k for k in pieces if not got[k].held_out]
    assert 0 < len(train) < len(rows)
    counts = collections.Counter(w for k in train for w, _ in pieces[k])
    pairs = collections.Counter((a, w) for k in train for a, (w, _) in zip([None, *[x for x, _ in pieces[k]]], pieces[k], strict=False))
    ends = collections.Counter((w[-1] if w else 0, d) for k in train for w, d in pieces[k])
    total = sum(counts.values())

    def refined(mixer, inputs, gate):
        dot = max(-12.0, min(12.0, sum(x * w for x, w in zip(inputs, mixer.weights[gate].tolist(), strict=True))))
        bucket = min(context_mixing.BUCKETS - 1, max(0, int(dot / 0.5 + context_mixing.BUCKETS / 2)))
        seen = (mixer.ones[gate, bucket] + 0.02) / (mixer.seen[gate, bucket] + 0.04)
        return min(1 - 1e-6, max(1e-6, 0.5 / (1 + math.exp(-dot)) + 0.5 * seen))

    def spelled(word):
        level, out = lambda n: sum(n >= x for x in (1, 3, 31)), 0.0
        symbols, contexts, _ = next(context_mixing._symbols(pa.array([word], pa.binary())))
        for at, symbol in enumerate(symbols.tolist()):
            node = 1
            for bit in range(8):
                value, seen = symbol >> (7 - bit) & 1, []
                for k, table in enumerate(tables):
                    slot = int(context_mixing._slots(contexts[k][at : at + 1], np.array([node], np.uint64), len(table).bit_length() - 1)[0])
                    pair = [int(x) for x in table[slot]]
                    pair[value] = max(0, pair[value] - (counts[word] == 1))
                    seen.append(pair)
                inputs = [math.log(o + context_mixing.DELTA) - math.log(z + context_mixing.DELTA) for z, o in seen] + [0.3]
                p = refined(model.spelling, inputs, (level(sum(seen[context_mixing.ORDERS.index(0)])) * 4 + level(sum(seen[context_mixing.ORDERS.index(3)]))) * 8 + bit)
                out += math.log10(p if value else 1 - p)
                node = node * 2 + value
        return out

    def choice(n, value, contexts, gate, without):
        inputs = []
        for k, c in enumerate(contexts):
            slot = int(context_mixing.mixed(np.array([c * 16 + 4 * k + n], np.uint64))[0]) >> (64 - context_mixing.CHOICE_BITS)
            pair = model.table[slot].tolist()
            pair[value] = max(0, pair[value] - without)
            inputs.append(math.log(pair[1] + 0.4) - math.log(pair[0] + 0.4))
        p = refined(model.choices, [*inputs, 0.3], n * 80 + gate)
        return math.log10(p if value else 1 - p)

    size = lambda x: min(15, x.bit_length())
    for key in pieces:
        own, want, levels, prior_pair = int(not got[key].held_out), 0.0, [4, 4, 4], 0
        earlier, followed = collections.Counter(), 0
        for at, (word, mark) in enumerate(pieces[key]):
            before = pieces[key][at - 1][0] if at else None
            often = max(0, (counts[before] if at else len(train)) - own)
            pair, known = max(0, pairs[before, word] - own), max(0, counts[word] - own)
            grade = size(often)
            contexts = [((grade * 5 + levels[-1]) * 5 + levels[-2]) * 5 + levels[-3], often if often >= 32 else grade * 5 + levels[-1], followed * 8 // max(1, at) * 16 + size(at), (grade * 16 + size(prior_pair)) * 5 + levels[-1]]
            asks = [(often > 0, pair > 0, pair / max(1, often)), (at > 0, earlier[word] > 0, earlier[word] / max(1, at))]
            taken = sum(max(0, counts[w] - own) for w in earlier if earlier[w]) / (total - own)
            asks.append((total > own, known > 0, min(1, known / (total - own) / (1 - min(taken, 0.999)))))
            level = 3
            for n, (asked, yes, share) in enumerate(asks):
                if asked:
                    want += choice(n, int(yes), contexts, grade * 5 + levels[-1], own)
                    if yes:
                        level, want = n, want + math.log10(share)
                        break
            if level == 3:
                want += spelled(word)
            last = word[-1] if word else 0
            want += math.log10((ends[last, mark] + 0.05) / (sum(ends[last, d] for d in (0, *context_mixing.SPACES)) + 0.35))
            levels.append(level)
            followed += level == 0
            prior_pair = pair
            earlier[word] += 1
        assert abs(got[key].score - want) < 1e-3 * max(1, abs(want)), (key, got[key].score, want)


def test_copies_are_told_from_single_texts_and_held_out_texts_beat_the_base(spark):
    """Over all documents of the folder, some of them twice: bits of a byte fall where a training text has a copy."""
    docs = _documents(spark).select("doc_id", "text")
    rows = context_mixing.score_documents(docs).where("held_out").groupBy().sum("score", "base_score").first()
    assert rows[0] > rows[1]
    rng = np.random.default_rng(5)
    fresh = [(10**6 + k, " ".join(f"w{x}" for x in rng.zipf(1.3, 120) % 900)) for k in range(60)]
    twice = fresh + [(k + 10**6, t) for k, t in fresh[:20]]
    got = {r.doc_id: r for r in context_mixing.score_documents(spark.createDataFrame(twice, docs.schema)).collect()}
    copied = [got[k].bits_per_byte for k, _ in fresh[:20] if not got[k].held_out and not got[k + 10**6].held_out]
    single = [got[k].bits_per_byte for k, _ in fresh[20:] if not got[k].held_out]
    assert max(copied) < min(single)
