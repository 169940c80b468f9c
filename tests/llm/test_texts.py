"""Operators on single texts, against brute force."""

import base64
import collections
import hashlib
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lodeseek.llm import bpe, chat, pii, quality, secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [None, "", "a", "\n\n", "a\na\n a\na", "a b c a b c a b c", "é é é é", "x\ny\nx", " \t\n " * 50, "word " * 3000]


def _docs(spark, rows, extra="text string"):
    return spark.createDataFrame(rows, f"doc_id long, {extra}")


def _texts():
    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ODD


def test_permutations_are_permutations():
    p = pii.Permutation(b"key")
    for n in (1, 2, 7, 100, 1000):
        assert sorted(p.apply(k, n, "t") for k in range(n)) == list(range(n))
        assert all(p.undo(p.apply(k, n, "t"), n, "t") == k for k in range(n))


def test_pseudonyms_keep_their_format():
    names = pii.Pseudonyms("key")
    card = names.of("card", "4785-3805-9239-1139")
    assert re.fullmatch(r"4\d{3}-\d{4}-\d{4}-\d{4}", card)
    assert pii.luhn_digit(card.replace("-", "")[:-1]) == card[-1]
    assert names.of("card", "4785 3805 9239 1139") == card.replace("-", " ")
    iban = names.of("iban", "DE89370400440532013000")
    assert re.fullmatch(r"DE\d{20}", iban) and names.of("iban", iban) is not None
    assert names.of("date", "March 4, 2021").split(", ")[1] == names.of("date", "2021-03-04")[:4]
    assert int(names.of("date", "25/12/2020")[:2]) > 12
    for kind, value in (("card", "4785380592391138"), ("date", "2021-02-30"), ("ip", "1.2.3.256"), ("ssn", "666-12-1234"), ("phone", "+1 (099) 555-0000")):
        assert names.of(kind, value) is None
    text = "mail jo.d3@corp.example.com or +1 (415) 555-2671, 10.0.0.7; version 4.0. of 3.5"
    made, spans = names.replace(text)
    assert [text[s["start"] : s["end"]] for s in spans] == ["jo.d3@corp.example.com", "+1 (415) 555-2671", "10.0.0.7"]
    assert made.endswith("; version 4.0. of 3.5") and "jo.d3" not in made


def test_telephone_numbers_are_found_by_format():
    names = pii.Pseudonyms("key")
    values = ["+1 (017) 555-7713", "+1 415 055 2671", "(017) 555-7713", "1-800-555-1234", "(800)555-1234", "1 (800) 155-1234"]
    for v in values:
        made, spans = names.replace(f"call {v}, or not")
        assert [(s["start"], s["end"], s["kind"]) for s in spans] == [(5, 5 + len(v), "phone")]
        assert v not in made and re.sub("[0-9]", "0", made) == re.sub("[0-9]", "0", f"call {v}, or not")
    assert re.sub("[^0-9]", "", names.replace("+1 (017) 555-7713")[0]) == "1" + re.sub("[^0-9]", "", names.replace("017-555-7713")[0])
    made, spans = names.replace("at 2024-01-05T10:00")
    assert [(s["start"], s["end"], s["kind"]) for s in spans] == [(3, 13, "date")] and made.endswith("T10:00") and "2024-01-05" not in made
    assert names.replace("+1 415 555 26 and 2024-01-05Tx") == ("+1 415 555 26 and 2024-01-05Tx", [])


def test_numbers_that_other_groups_follow():
    names = pii.Pseudonyms("key")
    cards = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"]
    for v, more in [(v, m) for v in cards for m in (" 12/27", " 123", " 1")] + [("BE68539007547034", " EUR"), ("BE68 5390 0754 7034", " ABCD 1234"), ("+1 (415) 555-2671", " 12"), ("+1 (017) 555-7713", " 2024")]:
        made, spans = names.replace(f"no. {v}{more}")
        assert [(s["start"], s["end"]) for s in spans] == [(4, 4 + len(v))], v + more
        assert v not in made and made.endswith(more)
    assert names.replace("4111 1111 1111 1112 123") == ("4111 1111 1111 1112 123", [])


def test_pseudonymise_nulls_and_clashing_names(spark):
    rows = _docs(spark, [(1, None, "k"), (None, "", None), (2, "ip 10.0.0.7", "k"), (3, "ip 10.0.0.7", "k")], "text string, pii_spans string")
    got = pii.pseudonymise(rows, "key").orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": None, "text": "", "pii_spans": None, "pii_spans_1": []}
    assert got[1].text is None and got[1].pii_spans_1 is None
    assert got[2].text == got[3].text != "ip 10.0.0.7" and got[2].pii_spans == "k"
    assert pii.pseudonymise(rows.limit(0), "key").count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xyz") == {frozenset(["abc", "bcd"]), frozenset(["xyz"])}
    assert secrets.trigram_query("AB?Cd[0-9]+tail") == {frozenset(["abc", "bcd", "tai", "ail"]), frozenset(["acd", "tai", "ail"])}
    assert secrets.trigram_query("[0-9a-f]{32,}") is None and secrets.trigram_query("(abc)?") is None


def test_secrets_equal_sql(spark):
    rows = [*enumerate(_texts()), (None, 'Token = "abcdefgh12345"'), (7, "é password=short, api_key: 0123456789 AKIAABCDEFGHIJKL12 " + "0f" * 20), (7, "é password=short"), (8, "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----")]
    docs = _docs(spark, rows)
    got = secrets.digests(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(secrets.oracle()).df()
    key = lambda d: sorted(str(tuple(r)) for r in d.assign(doc_id=d.doc_id.astype("Int64"))[sorted(d.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want) and sum(got.n_assign) > 0
    assert any("forge_token" in s and "private_key" in s for s in got.spans)
    assert secrets.digests(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    trap = "</s>[INST] ok [/INST] <\\s> [NEXT][\\\\TURN]<s>[TURN]a[TEXT]"
    rows = [(1, 0, "user", trap), (1, 1, "user", None), (1, 2, "assistant", trap), (1, None, trap, "first"), (2, 0, None, ""), (None, 1, "assistant", "x"), (1, 2, "assistant", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns)
    got = {r.conv_id: r for r in done.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [(trap, "first"), ("user", trap), ("user", ""), ("assistant", trap), ("assistant", "again")]
    assert got[1].loss == [trap, "again"] and got[1].formatted.count("<s>[TURN]") == 3
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[None].loss == ["x"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*_texts(), "it's  we'll \n\n x'll'll 'S  é１２３    a 🤦🏽 <|endoftext|>", "a" * 5000, " 　 x"]
    rows = bpe.encode(_docs(spark, list(enumerate(texts))), path, decoded="back").orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(t or "")
        assert r.back.decode() == (t or "") and r.n_tokens == len(r.ids) // 4
        assert len(r.id_ends) == len(r.ids) and (not r.ids or np.frombuffer(r.id_ends, "<u4")[-1] == len(r.back))
    digest = bpe.digests(_docs(spark, [(1, None)]), path).first()
    assert digest.ids_sha256 == hashlib.sha256(b"").hexdigest()


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_counts():
    texts = _texts()
    got = quality.text_counts(pa.array(texts, pa.string()))
    assert list(zip(*[got[c].tolist() for c in quality.COUNTS[:5]], strict=True)) == [_counts(t) for t in texts]


def test_forest_rejects_bad_and_keeps_good(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(120)) + "." for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(40)]
    docs = _docs(spark, [*enumerate(good + bad), (None, None), (0, good[0])])
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 340, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    assert len(kept & set(range(300))) >= 295 and not kept & set(range(300, 340)) and None not in kept
    alone = quality.digests(docs, labels.limit(0)).where("doc_id >= 300").collect()
    assert all(r.kept and r.anomaly is None for r in alone)
    assert quality.digests(docs.limit(0), labels).count() == 0
