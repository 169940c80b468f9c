"""The store against a dictionary: upserts, purges, compactions, kept counts, crashes, two writers, streams."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import search
from lodeseek.plans import service
from lodeseek.sources import store
from lodeseek.streaming import ingest

KIND = "source string, doc int, space string, text string"


def _frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def _rows(table):
    return sorted((tuple(r) for r in table.read().select("source", "doc", "space", "text").collect()), key=str)


def _counts(table):
    return {(r.column, r.value): r.n for r in table.facets().collect()}


def _expected(rows):
    return dict(collections.Counter([("space", r[2]) for r in rows] + [("text", r[3]) for r in rows]))


def _size(path):
    return sum(p.stat().st_size for p in path.rglob("part-*"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    table = store.Store(spark, str(tmp_path / "t"), KIND, keep=2, facets=("space", "text"))
    row = lambda: (rng.choice(["a/b", "c d", None, "e=1", "ü%"]), rng.randrange(8), rng.choice(["x", None, "y"]), rng.choice(["1", "2"]))
    held = [row() for _ in range(12)]
    table.write(_frame(spark, held))
    for _ in range(7):
        step = rng.choice(["upsert", "upsert", "purge", "drop", "missing", "compact"])
        some = [row() for _ in range(rng.randrange(1, 4))]
        if step == "upsert":
            table.upsert(_frame(spark, some), ("source", "doc"))
            held = [r for r in held if r[:2] not in {s[:2] for s in some}] + some
        elif step == "missing":
            table.upsert(_frame(spark, some), ("source", "doc"), purge_missing=True)
            held = [r for r in held if r[0] not in {s[0] for s in some}] + some
        elif step == "purge":
            table.purge(_frame(spark, some).select("source", "space"))
            held = [r for r in held if (r[0], r[2]) not in {(s[0], s[2]) for s in some}]
        elif step == "drop":
            table.purge(_frame(spark, some[:1]).select("source"))
            held = [r for r in held if r[0] != some[0][0]]
        else:
            table.compact()
            assert table.compact() == []
        assert _rows(table) == sorted(held, key=str), step
        assert _counts(table) == _expected(held), step
    assert len(table.versions()) <= 2


def test_bytes_follow_the_change_and_compaction_folds(spark, tmp_path):
    table = store.Store(spark, str(tmp_path / "t"), KIND)
    rows = [("s", k, "x", f"{k} " * 200) for k in range(3000)]
    table.write(_frame(spark, rows))
    whole = _size(tmp_path / "t/data")
    table.upsert(_frame(spark, [("s", 7, "x", "new")]), ("source", "doc"))
    table.purge(spark.createDataFrame([("s", 8)], "source string, doc int"))
    assert _size(tmp_path / "t/data") - whole < whole / 20 and _size(tmp_path / "t/deletes") < whole / 20
    before = _rows(table)
    assert len(before) == 2999 and ("s", 7, "x", "new") in before
    versions = table.versions()
    table.upsert(_frame(spark, []), ("source", "doc"))
    assert table.versions() == versions
    assert table.compact() == ["s"] and _rows(table) == before
    assert all(e.kind == "data" for e in table._entries(table.versions()[-1]))
    assert "left_anti" not in str(table.read()._jdf.queryExecution().optimizedPlan()).lower().replace("leftanti", "left_anti")


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    one, two = (store.Store(spark, str(tmp_path / "t"), KIND) for _ in range(2))
    one.write(_frame(spark, [("a", 1, "x", "1")]))
    append = store.Store._append

    def slow(self, rows, batch, seq):
        if self is two:
            monkeypatch.setattr(store.Store, "_append", append)
            one.upsert(_frame(spark, [("a", 1, "x", "first")]), ("source", "doc"))
        return append(self, rows, batch, seq)

    monkeypatch.setattr(store.Store, "_append", slow)
    with pytest.raises(store.Conflict):
        two.upsert(_frame(spark, [("a", 2, "x", "second")]), ("source", "doc"))
    assert _rows(one) == [("a", 1, "x", "first")]
    left = len(list((tmp_path / "t/data").iterdir()))
    one.vacuum()
    assert len(list((tmp_path / "t/data").iterdir())) < left and _rows(one) == [("a", 1, "x", "first")]


def test_filters_by_kept_counts_do_not_read_points(spark, tmp_path):
    table = store.Store(spark, str(tmp_path / "t"), KIND, facets=("source", "space"))
    table.write(_frame(spark, [("a", k, "x" if k < 3 else "y", "t") for k in range(5)] + [("b", 1, "z", "t")]))
    counts = table.facets()
    assert counts.inputFiles() and all("/facets/" in f for f in counts.inputFiles())
    broken = table.read().withColumn("space", F.when(F.raise_error(F.lit("points were read")).isNull(), "x"))
    with pytest.raises(ValueError, match="has no value 'w'; it has x, y, z"):
        search.filtered(broken, counts, space="w")
    assert search.filtered(table.read(), counts, space="y", source="a").count() == 2 == search.filtered(table.read(), space="y", source="a").count()
    with pytest.raises(ValueError, match="repo has no value"):
        service.code_search(table.read(), _frame(spark, []).select(F.lit(1).cast("long").alias("qid"), F.lit("q").alias("query")), lambda q: q, repo="none", facets=counts.withColumn("column", F.lit("repo")))


def test_a_repeated_batch_makes_no_version(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = store.Store(spark, str(tmp_path / "t"), KIND)
    read = lambda: spark.readStream.schema(KIND).json(str(tmp_path / "in"))
    run = lambda check: ingest.ingest(read(), table, lambda df: df, str(tmp_path / check), ("source", "doc")).awaitTermination()
    (tmp_path / "in/1.json").write_text('{"source": "a", "doc": 1, "text": "one"}\n')
    run("c")
    (tmp_path / "in/2.json").write_text('{"source": "a", "doc": 1, "text": "two"}\n{"source": "b", "doc": 2}\n')
    run("c")
    assert _rows(table) == [("a", 1, None, "two"), ("b", 2, None, None)] and table.versions() == [0, 1]
    table.upsert(_frame(spark, [("a", 1, None, "again")]), ("source", "doc"), stream=(str(tmp_path / "c"), 1))
    assert table.versions() == [0, 1]
    for name in ("1", ".1.crc"):
        (tmp_path / "c/commits" / name).unlink()  # the batch is in the store, but the stream doesn't know
    run("c")
    assert table.versions() == [0, 1] and _rows(table)[0] == ("a", 1, None, "two")
    table.purge(spark.createDataFrame([("a",)], "source string"))
    table.upsert(_frame(spark, [("z", 1, None, "late")]), ("source", "doc"), stream=(str(tmp_path / "c"), 0))
    assert [r[0] for r in _rows(table)] == ["b"]
