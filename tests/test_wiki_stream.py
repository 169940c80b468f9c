"""The wiki as a table of ranges and as a stream of changes, and the sinks for its pages, over a stub service."""

import http.server
import json
import re
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lodeseek.sources import sinks, wiki


class _Stub(http.server.BaseHTTPRequestHandler):
    pages: dict = {}
    asked: list = []
    during = None

    def log_message(self, *_):
        pass

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        _Stub.asked.append(asked)
        if "cql" in asked:
            found = list(self.pages.values())
            if "(id=" not in asked["cql"]:
                found = [p for p in found if p["id"] != "0"]
            if day := re.search(r'lastmodified >= "([\d-]+)"', asked["cql"]):
                found = [p for p in found if p["version"]["when"][:10] >= day[1]]
            if "desc" in asked["cql"]:
                found.sort(key=lambda p: p["version"]["when"], reverse=True)
            start, limit = int(asked["start"]), int(asked["limit"])
            body = {"results": found[start : start + limit]}
            if _Stub.during and "created" in asked["cql"] and limit > 1:
                _Stub.during, change = None, _Stub.during
                change()
        else:
            body = self.pages[url.path.rpartition("/")[2]]
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)


def _put(k, when, text=""):
    _Stub.pages[str(k)] = {"id": str(k), "title": f"T{k}", "space": {"key": "S"}, "version": {"when": when}, "body": {"storage": {"value": text or f"<p>{k}</p>"}}}


@pytest.fixture
def service(spark):
    _Stub.pages, _Stub.asked = {}, []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(wiki.WikiSource)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("n", [0, 24, 25, 26, 50, 51, 333])
def test_ranges_of_a_subtree(spark, service, n):
    for k in range(n + 1):
        _put(k, "2024-01-01T00:00:00Z")
    df = spark.read.format("wiki").options(url=service, roots="0", rangePages=50).load()
    rows = df.orderBy("pos").collect()
    assert [(r.root_ord, r.pos, r.id) for r in rows] == [(0, k, str(k)) for k in range(n + 1)]
    assert df.rdd.getNumPartitions() == max(1, -(-n // 50))


def test_a_stream_of_changes_resumes_without_repeats(spark, service, tmp_path):
    def run():
        batch = spark.readStream.format("wiki").options(url=service, roots="0", rangePages=25).load()
        query = batch.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()

    def rows():
        return sorted((int(r.id), r.updated) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [(k, f"2024-01-01T{k % 24:02d}:{k % 60:02d}:00+00:00") for k in range(60)]
    for k, when in first:
        _put(k, when)
    run()
    assert rows() == sorted(first)
    run()  # nothing new
    assert rows() == sorted(first)
    _put(7, "2024-01-05T10:00:00.500+03:00")
    _put(61, "2024-01-05T06:59:59Z")  # earlier than the other, though its text is greater
    _Stub.during = lambda: _put(8, "2024-01-06T00:00:00Z")  # changes while the batch is read
    run()
    assert rows() == sorted([*first, (7, "2024-01-05T10:00:00.500+03:00"), (61, "2024-01-05T06:59:59Z")])
    _Stub.asked.clear()
    run()
    assert rows()[-1][0] == 61 and (8, "2024-01-06T00:00:00Z") in rows() and len(rows()) == 63
    assert all("lastmodified >=" in a["cql"] for a in _Stub.asked if "created" in a.get("cql", ""))


def test_times_of_versions():
    assert wiki._instant("2024-01-05T10:00:00+03:00") == "2024-01-05T07:00:00.000000+00:00" and wiki._instant("") == wiki._instant(None) == wiki._instant("x") == ""


def _files(root):
    """The visible files; a task that outlives its job may leave some in the hidden folder."""
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc") and ".staging" not in p.parts}


def test_markdown_files_are_visible_after_the_commit_only(spark, tmp_path):
    sinks.register(spark)
    rows = spark.createDataFrame([(f"S/{k}.md", f"# {k} é" if k else None) for k in range(20)], "file string, markdown string").repartition(4)
    save = lambda df, **o: df.write.format("markdown").mode("append").options(path=str(tmp_path / "out"), **o).save()
    save(rows, dryRun="true")
    assert not (tmp_path / "out").exists() or _files(tmp_path / "out") == {}
    save(rows)
    want = {f"S/{k}.md": f"# {k} é" if k else "" for k in range(20)}
    assert _files(tmp_path / "out") == want and not (tmp_path / "out/.staging").exists()
    broken = rows.withColumn("markdown", F.when(F.col("file") == "S/7.md", F.raise_error(F.lit("no"))).otherwise(F.lit("changed")))
    with pytest.raises(Exception, match="no"):
        save(broken)
    assert _files(tmp_path / "out") == want
    with pytest.raises(Exception, match="isn't a path"):
        save(spark.createDataFrame([("../x.md", "x")], rows.schema))
    save(spark.createDataFrame([("S/3.md", "new"), ("T/x.md", "y")], rows.schema))
    assert _files(tmp_path / "out") == want | {"S/3.md": "new", "T/x.md": "y"}
    with pytest.raises(Exception, match="append only"):
        rows.write.format("markdown").mode("overwrite").options(path=str(tmp_path / "out")).save()


def test_states_of_runs_are_versions(spark, tmp_path):
    sinks.register(spark)
    kind = "id string, updated string, title string, space string, file string"
    save = lambda rows, **o: spark.createDataFrame(rows, kind).write.format("pagestate").mode("append").options(path=str(tmp_path / "s"), **o).save()
    read = lambda: sorted(tuple(r) for r in sinks.newest_state(spark, str(tmp_path / "s")).collect())
    assert read() == []
    one = [(str(k), "u", "Ü", "S", f"S/{k}.md") for k in range(9)]
    save(one)
    assert read() == one
    save([("1", "v", "T", "S", "f")], dryRun="true")
    assert read() == one
    save([("1", "v", None, "S", "f")])
    assert read() == [("1", "v", None, "S", "f")]
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.isdigit()) == ["0000000000", "0000000001"]
    assert all("T" in json.loads(line)["synced_at"] for p in (tmp_path / "s/0000000000").glob("*.json") for line in p.read_text().splitlines())
