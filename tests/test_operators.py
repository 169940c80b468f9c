import datetime

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text
from lodeseek.functions.storage import storage_to_markdown
from lodeseek.functions.vectors import embed
from lodeseek.operators import chunking, code_chunks, pages, search
from lodeseek.plans.service import code_search, kb_search
from lodeseek.sources import files, store


def test_lines_and_strip(spark):
    rows = spark.createDataFrame([("a\r\nb\x1cc\n",), ("",), ("\xa0 x\x1c",)], "t string")
    got = rows.select(text.lines(F.col("t")).alias("l"), text.strip(F.col("t")).alias("s")).collect()
    assert [r.l for r in got] == [["a", "b", "c"], [], ["\xa0 x"]]
    assert got[2].s == "x"


def test_ids_names_and_variants(spark):
    one = spark.range(1)
    got = one.select(
        text.document_chunk_id(F.lit("local"), F.lit("a.md"), F.lit(0)).alias("id"),
        text.safe_name(F.lit(' ..a:b/  c?. ')).alias("name"),
        text.safe_name(F.lit("..")).alias("none"),
        text.accepted_variants(F.lit("Query"), F.array(*map(F.lit, ("query", " ", "one", "two", "three")))).alias("v"),
    ).first()
    assert got.id == "06dc0309-c408-9f81-ba98-acf286f93d84"
    assert (got.name, got.none, got.v) == ("a-b- c-", "untitled", ["Query", "one", "two"])


def test_chunks_of_headings_fences_and_paragraphs(spark):
    body = "intro\n# A\n```\n# no\n```\n## B\nb1\n\nb2\n\n\nlonger paragraph\n# C\n### D\nd\n## \ne"
    got = chunking.chunks(spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, t string"), "k", "t", 8).orderBy("k", "chunk_idx").collect()
    assert [(r.chunk_idx, r.heading, r.text) for r in got] == [(0, "", "intro"), (1, "A", "```\n# no\n```"), (2, "A - B", "b1\n\nb2"), (3, "A - B", "longer paragraph"), (4, "C - D", "d"), (5, "C", "e")]


def test_packing_joins_may_pass_the_limit(spark):
    got = spark.range(1).select(chunking.pack_paragraphs(F.lit("aaa\n\nbbb\n\ncccccccccc\n\nd"), 6).alias("p")).first().p
    assert got == ["aaa\n\nbbb", "cccccccccc", "d"]


def test_storage_markup():
    page = (
        '<h1>Top&nbsp;x</h1><p>a &amp; b &mdash; <ac:link><ri:page ri:content-title="P" /></ac:link></p>'
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sh</ac:parameter><ac:plain-text-body><![CDATA[ls <x>]]></ac:plain-text-body></ac:structured-macro>'
        '<ac:structured-macro ac:name="info"><p>note</p></ac:structured-macro><ul><li>one<ol><li>deep</li></ol></li><li>two</li></ul>'
        '<table><tr><th>h</th><th>i</th></tr><tr><td>1</td></tr></table><pre> p </pre><section><p>in</p></section>'
    )
    assert storage_to_markdown(page, "T") == "# T\n\n# Top x\n\na & b — «P»\n\n```sh\nls <x>\n```\n\n> note\n\n- one\n  1. deep\n- two\n\n| h | i |\n| --- | --- |\n| 1 |  |\n\n```\np\n```\n\nin\n"
    assert storage_to_markdown("<p>a<br>b &lt;", "") == "a b <\n"
    assert (storage_to_markdown(" ", "T"), storage_to_markdown(None, None)) == ("# T\n", "")


def test_code_chunks(spark):
    module = "import x\n\n@d\nclass A(B):\n    'doc'\n    def m(self, a, *b, c=1, **d):\n        def inner(): pass\n\nasync def f(): pass\n"
    rows = [("r", "a/b.py", module), ("r", "tests/t.py", module), ("r", "latest_x.py", module), ("r", "bad.py", "def ("), ("r", "consts.py", "A = 1\nB = 2\nC = 3\nD = 4\n"), ("r", "Dockerfile", "FROM x\n" * 130), ("r", "x.rst", "no")]
    got = code_chunks.code_chunks(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    found = {(r.path, r.symbol, r.kind, r.signature, r.line_start, r.line_end) for r in got}
    assert found == {
        ("a/b.py", "A", "class", "class A(B)", 4, 7), ("a/b.py", "A.m", "function", "def m(self, a, *b, **d)", 6, 7), ("a/b.py", "f", "asyncfunction", "async def f()", 9, 9),
        ("consts.py", "consts", "module", "", 1, 4), ("Dockerfile", "Dockerfile", "config", "", 1, 120), ("Dockerfile", "Dockerfile", "config", "", 121, 130),
    }


def test_scans(spark, tmp_path):
    for name, body in {"s/a.md": b"# T\nx \xff", "s/.git/b.md": b"no", "s/blank.txt": b" \n", "c.TXT": b"y", "d.pdf": b"z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = files.with_source_labels(files.documents(spark, str(tmp_path))).orderBy("source_id").collect()
    assert [(r.source_id, r.space, r.title, r.source, r.text) for r in got] == [("c.TXT", tmp_path.name, "c", "local", "y"), ("s/a.md", "s", "a", "s", "# T\nx \ufffd")]
    assert all(r.url == str(tmp_path / r.source_id) for r in got)


def test_store_replaces_by_key(spark, tmp_path):
    def rows(*which):
        made = spark.createDataFrame([(f"{s}{d}{k}", s, d, t, k) for s, d, k, t in which], "id string, source string, source_id string, text string, chunk_idx int")
        return made.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("space", "string"), ("title", "string"), ("url", "string"), ("acl_groups", "array<string>"), ("updated_at", "timestamp"), ("heading", "string"), ("embedding", "array<float>"))])

    table = store.Store(spark, str(tmp_path / "t"))
    assert table.count() == 0
    table.upsert(rows(("a", "x", 0, "1"), ("a", "x", 1, "2"), ("b", "y", 0, "3")))
    table.upsert(rows(("a", "x", 0, "new")))
    assert {(r.id, r.text) for r in table.read().collect()} == {("ax0", "new"), ("by0", "3")}
    table.upsert(rows(("a", "x", 0, "new")))
    assert table.count() == 2


def test_page_state(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long")
    tree = pages.descendants(edges, spark.createDataFrame([(1,)], "id long"), depth=5)
    assert {(r.id, r.depth) for r in tree.collect()} == {(1, 0), (2, 1), (3, 1)}
    state = spark.createDataFrame([("1", "t", "T", "S", "f"), ("9", "t", "T", "S", "g")], "id string, updated string, title string, space string, file string")
    now = pages.change_set(state.where("id = '1'").withColumn("updated", F.lit("u")), state)
    assert now.first().action == "updated"
    assert {(r.id, r.updated) for r in pages.new_state(state, now, "now").collect()} == {("1", "u"), ("9", "t")}


def _embed(df):
    return embed(df.withColumn("k", F.concat_ws("/", "qid", "variant")), "k", "query", 64).drop("k")


def test_search_facade(spark):
    docs = [("1", "a", "how to deploy the payment gateway"), ("2", "a", "vacation and sick leave rules"), ("3", "b", "deploy checklist")]
    rows = spark.createDataFrame(docs, "id string, source string, text string").select("*", F.col("source").alias("space"), F.lit("t").alias("title"), F.concat(F.lit("d"), "id").alias("source_id"), F.lit("C:\\x").alias("url"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(0).alias("chunk_idx"))
    points = embed(rows, "id", "text", 64)
    asked = spark.createDataFrame([(1, "deploy the payment gateway"), (2, "zebra")], "qid long, query string")
    hits, answers = kb_search(points, asked, _embed)
    first = hits.where("qid = 1").orderBy("place").first()
    assert (first.document, first.text, first.location) == ("d1", docs[0][2], "C:\\x")
    told = {r.qid: r for r in answers.collect()}
    assert told[1].citation.startswith("Источник: d1 (C:/x)") and told[2].found == 0 and told[2].reason == "below_threshold"
    with pytest.raises(ValueError):
        kb_search(points, asked, _embed, source="none")
    with pytest.raises(ValueError):
        kb_search(points, spark.createDataFrame([(1, " ")], asked.schema), _embed)
    code = points.select("id", "embedding", "text", F.lit("r").alias("repo"), F.lit("p").alias("path"), F.lit("s").alias("symbol"), F.lit("function").alias("kind"), F.lit("").alias("signature"), F.lit("").alias("doc"), F.lit(3).alias("line_start"))
    row = code_search(code, asked, _embed, top_k=1).first()
    assert (row.location, row.signature, row.code) == ("r/p:3", None, docs[0][2])


def test_search_edges(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, 0, [1.0, 0.0])], "qid long, variant int, embedding array<float>")
    assert [(r.id, r.rank) for r in search.top_k(points, asked, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert search.top_k(points, asked.limit(0), 2).count() == 0
    assert search.top_k(points.limit(0), asked, 2).count() == 0
    assert (search.clamp(0), search.clamp(99)) == (1, 20)


def test_stream_into_store(spark, tmp_path):
    from lodeseek.streaming.ingest import ingest

    source = tmp_path / "in"
    rows = spark.createDataFrame([("a.md", "# H\ntext", datetime.datetime(2024, 1, 1))], "source_id string, text string, updated_at timestamp")
    rows.write.parquet(str(source))

    def index(batch):
        made = chunking.chunks(batch, "source_id", "text").withColumn("source", F.lit("local"))
        made = chunking.chunk_ids(made, F.col("source"), F.col("source_id"))
        missing = {"space": "string", "title": "string", "url": "string", "acl_groups": "array<string>", "updated_at": "timestamp", "embedding": "array<float>"}
        return made.select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()])

    table = store.Store(spark, str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    ingest(stream, table, index, str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.heading, r.text) for r in table.read().collect()] == [("H", "text")]


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    points = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(k // 2, k % 2, [1.0, float(k % 3), float(k)]) for k in range(23)] + [(0, 0, [1.0, 0.0, 0.0])], "qid long, variant int, embedding array<float>")
    want = sorted(map(str, search.top_k(points, asked, 4).collect()))
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    monkeypatch.setattr(search, "STEP", 2, raising=False)
    assert sorted(map(str, search.top_k(points, asked, 4).collect())) == want and len(want) == 23 * 4
