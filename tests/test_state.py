"""Stores, graphs, pages and services under failures, long chains and odd answers."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import vectors
from lodeseek.operators import graph, pages, search
from lodeseek.sources import files, store, wiki

ROWS = "source string, doc int, text string"


def _store(spark, path, **more):
    return store.Store(spark, str(path), ROWS, **more)


def _all(table):
    return sorted((tuple(r) for r in table.read().select("source", "doc", "text").collect()), key=str)


def test_a_missing_store_is_an_error(spark, tmp_path):
    table = _store(spark, tmp_path / "t")
    with pytest.raises(LookupError, match="no store"):
        table.read()
    assert not table.exists() and table.count() == 0
    table.write(spark.createDataFrame([], ROWS))
    assert table.exists() and table.read().count() == 0


def test_a_write_that_broke_off_leaves_the_last_version(spark, tmp_path):
    table = _store(spark, tmp_path / "t")
    (tmp_path / "t/data/half").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="no complete version"):
        table.read()
    table.write(spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], ROWS))
    (tmp_path / "t/versions/1").mkdir()  # without _SUCCESS
    assert set(_all(table)) == {("a", 1, "x"), (None, 2, "y")}
    table.upsert(spark.createDataFrame([(None, 2, "new")], ROWS), ("source", "doc"))
    assert set(_all(table)) == {("a", 1, "x"), (None, 2, "new")} and table.versions() == [0, 1]


def test_only_touched_partitions_are_written_and_old_versions_go(spark, tmp_path):
    table = _store(spark, tmp_path / "t", keep=2)
    table.write(spark.createDataFrame([("a/b", 1, "x"), ("c", 2, "y"), ("c", 3, "z")], ROWS))
    first = table._folders(0)
    table.upsert(spark.createDataFrame([("c", 2, "new")], ROWS), ("source", "doc"))
    assert table._folders(1)["a/b"] == first["a/b"] and table._folders(1)["c"] != first["c"]
    assert _all(table) == [("a/b", 1, "x"), ("c", 2, "new"), ("c", 3, "z")]
    reader = table.read()
    table.upsert(spark.createDataFrame([("c", 9, "only")], ROWS), ("source", "doc"), purge_missing=True)
    assert _all(table) == [("a/b", 1, "x"), ("c", 9, "only")] and reader.count() == 3
    table.purge(spark.createDataFrame([("c", 9)], "source string, doc int"))
    assert _all(table) == [("a/b", 1, "x")] and len(table.versions()) == 2
    assert (tmp_path / "t" / first["a/b"]).exists()  # still in use, though its version is gone
    assert len(list((tmp_path / "t/data").iterdir())) <= 3
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("c", 2, "new")], ROWS), ("doc",))


def test_long_chains(spark):
    n = 80
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, 0), (500, 501)], "src long, dst long")
    tree = spark.createDataFrame([(k + 1, k) for k in range(n)], "id long, parent long")
    ring = {r.id: r.distance for r in graph.distances(edges, 0).collect()}
    assert ring == {k: min(k, n + 1 - k) for k in range(n + 1)}
    assert graph.distances(edges, 0, most=3).count() == 7
    down = pages.descendants(tree.where("id <= 30"), spark.createDataFrame([(0,)], "id long")).collect()
    assert {r.id: r.depth for r in down} == {k: k for k in range(31)}


def test_paths_lookups_and_communities(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)], "src long, dst long")
    assert [(r.step, r.id) for r in graph.path(edges, 1, 5).orderBy("step").collect()] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert graph.path(edges, 1, 9).count() == 0 and [r.id for r in graph.path(edges, 1, 1).collect()] == [1]
    nodes = spark.createDataFrame([(1, "Pay"), (2, "repay"), (3, None)], "id long, label string")
    assert {(r.id, r.exact) for r in graph.lookup(nodes, "PAY").collect()} == {(1, True), (2, False)}
    assert {r.id: r.community for r in graph.communities(edges).where("id > 7").collect()} == {8: 8, 9: 8}


def test_state_of_pages(spark, tmp_path):
    assert pages.load_state(spark, str(tmp_path / "none")).count() == 0
    state = spark.createDataFrame([("1", "u", "T", "S", "f")], pages.STATE)
    pages.save_state(state, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    pages.save_state(state, str(tmp_path / "s"))
    assert [tuple(r) for r in pages.load_state(spark, str(tmp_path / "s")).collect()] == [("1", "u", "T", "S", "f")]
    assert "T" in json.loads("".join(p.read_text() for p in (tmp_path / "s").glob("part-*")))["synced_at"]
    (tmp_path / "bad").write_text("{broken")
    assert pages.load_state(spark, str(tmp_path / "bad")).count() == 0


def test_markdown_files(spark, tmp_path):
    made = spark.createDataFrame([("1", "S/a b.md", "# é"), ("2", "S/x.md", None)], "id string, file string, markdown string")
    assert pages.write_markdown(made, str(tmp_path / "dry"), dry_run=True).count() == 2 and not (tmp_path / "dry").exists()
    assert {(r.file, r.chars) for r in pages.write_markdown(made, str(tmp_path)).collect()} == {("S/a b.md", 3), ("S/x.md", None)}
    assert (tmp_path / "S/a b.md").read_text() == "# é" and (tmp_path / "S/x.md").read_text() == ""


def test_answers_of_models():
    assert vectors.vectors_of('{"data": [{"embedding": [1, 2]}]}', 2, 1) == vectors.vectors_of('{"embeddings": [[1, 2]]}', 2, 1) == [[1, 2]]
    for payload, asked in (('{"embeddings": [[1, 2]]}', 2), ('{"embeddings": [[1, 2], [1]]}', 2), ("{}", 1)):
        with pytest.raises(ValueError):
            vectors.vectors_of(payload, 2, asked)
    inner = json.dumps({"queries": ["a", 3, "b"]})
    assert vectors.variants_of(json.dumps({"message": {"content": inner}})) == vectors.variants_of(json.dumps({"choices": [{"message": {"content": inner}}]})) == ["a", "b"]
    assert vectors.variants_of("no") == vectors.variants_of("{}") == vectors.variants_of('{"message": {"content": "[]"}}') == []


def test_embedder_batches_and_checks(spark):
    rows = spark.createDataFrame([(k, f"t{k}" if k else None) for k in range(5)], "id int, text string")
    got = rows.select("id", vectors.embedder(lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2, batch=2)(F.col("text")).alias("v")).collect()
    assert all(r.v[0] == (2.0 if r.id else 0.0) and r.v[1] <= 2 for r in got)
    with pytest.raises(Exception, match="another model"):
        rows.select(vectors.embedder(lambda texts: [[1.0]] * len(texts), 2)(F.col("text"))).collect()


def test_vectors_of_other_lengths_are_an_error(spark):
    asked = spark.createDataFrame([(7, 0, [1.0, 0.0])], "qid long, variant int, embedding array<float>")
    for bad in ([1.0], [1.0, None], [1.0, 0.0, 0.0]):
        with pytest.raises(Exception, match="2 components"):
            search.top_k(spark.createDataFrame([(1, bad)], "id long, embedding array<float>"), asked, 1).collect()


def test_hit_rate(spark):
    hits = spark.createDataFrame([(1, True), (2, False)], "qid long, hit boolean")
    assert tuple(search.hit_rate(hits).first()) == (2, 1, 0.5, None)
    assert tuple(search.hit_rate(hits, spark.createDataFrame([(1, 1.0), (2, 3.0)], "qid long, seconds double")).first()) == (2, 1, 0.5, 2.0)


def test_repositories_below_repos(spark, tmp_path):
    for name in ("repos/one/a.py", "repos/.git/x.py", "repos/two/b/c.py", "other/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert {(r.repo, r.path) for r in files.code_files(spark, str(tmp_path)).collect()} == {("one", "a.py"), ("two", "b/c.py")}
    assert {r.repo for r in files.code_files(spark, str(tmp_path / "repos"), not_repos=(".git", "two")).collect()} == {"one"}


class _Wiki(http.server.BaseHTTPRequestHandler):
    fails = 2

    def log_message(self, *_):
        pass

    def do_GET(self):
        if self.path.startswith("/none"):
            self.send_error(404)
            return
        if type(self).fails:
            type(self).fails -= 1
            if type(self).fails:
                self.send_error(503)
            else:
                self.connection.close()  # a lost connection
            return
        page = lambda k: {"id": str(k), "title": f"T{k}", "space": {"key": "S"}, "version": {"when": "w"}, "body": {"storage": {"value": f"<p>{k}</p>"}}}
        start = int(self.path.partition("start=")[2] or 0)
        body = page(1) if "/search" not in self.path else {"results": [page(k) for k in range(2 + start, min(32, 2 + start + 25))]}
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)


def test_wiki_pages_of_a_flaky_service(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert wiki.fetch(f"{url}/rest/api/content/1", "t", wait=0.01)["id"] == "1"
        with pytest.raises(RuntimeError, match="no such page"):
            wiki.fetch(f"{url}/none", "t", wait=0.01)
        spark.dataSource.register(wiki.WikiSource)
        rows = spark.read.format("wiki").option("url", url).option("roots", "1").load().orderBy("pos").collect()
        assert [r.id for r in rows] == [str(k) for k in range(1, 32)] and rows[3].storage == "<p>4</p>"
    finally:
        server.shutdown()
    with pytest.raises(RuntimeError, match="can't be reached"):
        wiki.fetch("http://127.0.0.1:9/x", "t", tries=1, wait=0.01)
