"""Model services in both dialects and header styles, the reranker hook, odd answers; the raw dump of a page."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import vectors
from lodeseek.functions.providers import Provider
from lodeseek.operators import search
from lodeseek.sources import wiki


class _Stub(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *_):
        pass

    def _send(self, body):
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self._send({"id": "5", "title": "Ü", "results": []})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body))
        if self.headers.get("Authorization") != "Bearer k" and self.headers.get("x-api-key") != "k":
            self.send_error(401)
        elif self.path == "/v1/embeddings":
            self._send({"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]})
        elif self.path == "/api/embed":
            self._send({"embeddings": [[1.0, float(len(t))] for t in body["input"]]})
        elif self.path == "/v1/chat/completions":
            self._send({"choices": [{"message": {"content": json.dumps({"queries": [body["messages"][1]["content"] + "?"]})}}]})
        elif self.path == "/api/chat":
            self._send({"message": {"content": "nothing"}})
        elif self.path == "/v1/rerank":
            n = len(body["texts"])
            self._send([{"index": 0, "score": 1.5}, {"index": n, "score": 9}, {"index": -1, "score": 9}, {"index": True, "score": 9}, {"index": 1, "score": "x"}, {"score": 3}, "odd", {"index": n - 1, "score": -2}])
        else:
            self.send_error(404)


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_dialects_and_headers(url):
    bearer = Provider(f"{url}/v1/", "m", key="k")
    other = Provider(f"{url}/v1", "m", "native", "k", "x-api-key", "")
    assert bearer.embed(["ab", "c"], 2) == [[2.0, 1.0], [1.0, 1.0]] and other.embed(["ab"], 2) == [[1.0, 2.0]]
    assert Provider(url, "m").headers() == {"Content-Type": "application/json"} and "x-api-key" in other.headers()
    with pytest.raises(RuntimeError, match="key is missing"):
        Provider(f"{url}/v1", "m").embed(["a"], 2)
    with pytest.raises(RuntimeError, match="no such address"):
        Provider(f"{url}/v2", "m", key="k").embed(["a"], 2)
    with pytest.raises(RuntimeError, match="can't be reached"):
        Provider("http://127.0.0.1:9", "m").embed(["a"], 2)
    with pytest.raises(ValueError):
        bearer.embed(["a"], 3)
    assert bearer.expand("why", "vary") == ["why?"] and other.expand("why", "vary") == [] and Provider(url, "m").expand("why", "vary") == []
    assert _Stub.seen[-3][1]["temperature"] == 0 and _Stub.seen[-2][1]["options"] == {"temperature": 0}


def test_embedding_and_reranking_on_executors(spark, url):
    provider = Provider(f"{url}/v1", "m", key="k")
    rows = spark.createDataFrame([("abc",), (None,)], "text string")
    assert sorted(r.v[0] for r in rows.select(vectors.embedder(lambda t: provider.embed(t, 2), 2)(F.col("text")).alias("v")).collect()) == [0.0, 3.0]
    candidates = spark.createDataFrame([(q, i, 0.9 - i / 10, i + 1) for q in (1, 2) for i in range(3)], "qid long, id long, score double, place int")
    asked = candidates.select("qid", "id", F.lit("q").alias("query"), F.col("id").cast("string").alias("text"))
    scores = vectors.reranker(provider.rerank)(asked)
    assert sorted(map(tuple, scores.collect())) == [(q, i, s) for q in (1, 2) for i, s in ((0, 1.5), (2, -2.0))]
    assert [tuple(r) for r in search.rerank(candidates, scores.where("qid = 1"), 2).orderBy("qid", "place").collect()] == [(1, 0, 1.5, 1), (2, 0, 0.9, 1), (2, 1, 0.8, 2)]
    refused = vectors.reranker(Provider(f"{url}/v1", "m").rerank)(asked)
    assert refused.count() == 0
    assert search.rerank(candidates, refused, 5).count() == search.rerank(candidates, None, 5).count() == 6


def test_raw_dump_of_the_first_page(spark, url, tmp_path):
    spark.dataSource.register(wiki.WikiSource)
    assert spark.read.format("wiki").options(url=url, roots="5", dumpRaw=str(tmp_path / "raw.json")).load().count() == 1
    assert json.loads((tmp_path / "raw.json").read_text())["title"] == "Ü"
