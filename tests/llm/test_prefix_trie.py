"""The trie of rebuilt conversations against SQL over the tables and a plain walk over odd conversations."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import prefix_trie, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KIND = "conv_id long, turn long, role string, text string"


def _plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(some)] for c, some in own.items()}
    rebuilt = {}
    for c in turns:
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves, ends = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for p, some in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(some) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    for c, seq in rebuilt.items():
        ends[seq].append(c)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(some), len(p), min(members[p[:-1]]) if p else None, len(some), children[p], leaves[p], saved[p], digest(ends[p])) for p, some in members.items())


def _got(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op11_prefix_trie(spark, SF)
    want = con.execute(queries.oracle_sql()["op11_prefix_trie"])
    assert [d[0] for d in want.description] == df.columns
    assert _got(df) == sorted(want.fetchall())


def _case(seed):
    """Few texts, so that families and others share turns; ties, nulls, repeats, gaps in ids and turns."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 1000, 10**12 + 3]:
        if rng.random() < 0.85:
            for k in range(rng.choice([1, 2, 3, 8, 12, 20])):
                rows.append((c, rng.choice([None, k, k, 3]), rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(["a", "", None, "é", "long " * 30]) if rng.random() < 0.6 else "a"))
    rows += [(None, 0, "user", "nobody"), (60, 0, "a", "b\nc"), (65, 0, "a\nb", "c"), (70, 0, "", "1:x"), (75, 0, "1", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations(spark, monkeypatch, seed):
    """Also where a family is sent on in parts and ids are hashed in pieces (in this process and its workers)."""
    rows = _case(seed)
    df = spark.createDataFrame(rows, KIND)
    assert _got(prefix_trie.prefix_trie(df.repartition(5))) == _plain(rows)
    more = df.withColumns({c: F.lit(1) for c in ("base", "key", "parent", "depth", "bytes", "members", "mark", "conv", "n_convs")})
    assert _got(prefix_trie.prefix_trie(more)) == _plain(rows)


def _all(batches, f):
    return [tuple(r.values()) for b in f(iter(batches)) for r in b.to_pylist()]


def test_large_families_are_sent_in_parts(spark, monkeypatch):
    rows = _case(3)
    turns = prefix_trie._turns(spark.createDataFrame(rows, KIND), "conv_id", "turn", "role", "text").coalesce(1).sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "head", "mark").toArrow()
    whole = _all(turns.to_batches(max_chunksize=7), prefix_trie._family_nodes)
    monkeypatch.setattr(prefix_trie, "NODES", 3)
    parts = _all(turns.to_batches(max_chunksize=7), prefix_trie._family_nodes)
    assert len(parts) > len(whole)
    by = lambda some, at: sorted((r[1], m) for r in some for m in r[at])
    assert by(whole, 5) == by(parts, 5) and by(whole, 6) == by(parts, 6)
    assert {(r[1], r[2], r[3], r[4]) for r in whole} == {(r[1], r[2] or next(x[2] for x in parts if x[1] == r[1] and (x[2] or not x[3])), r[3], max(x[4] for x in parts if x[1] == r[1])) for r in parts}


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    """Two texts for all: hot nodes at every depth, and ids hashed in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, t, "user", f"t{t}" if c % 3 else "same") for c in range(0, 5000, 5) for t in range(3)]
    assert _got(prefix_trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(7))) == _plain(rows)


def test_long_and_missing_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], KIND)).count() == 0
    rows = [(c, t, "user", f"t{t}" if t < 1500 else f"{c} {t}") for c in (10, 11) for t in range(3000)] + [(13, 0, "user", "x")]
    got = {r.conv_id: 0 for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, KIND)).select("conv_id", "depth").collect()}
    assert set(got) <= {10, 11, 13}
    short = [r for r in rows if r[1] < 60 or r[1] > 2940]
    assert _got(prefix_trie.prefix_trie(spark.createDataFrame(short, KIND))) == _plain(short)
