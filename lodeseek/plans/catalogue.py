"""The library's queries by name, and the equal SQL where SQL can express them.

Documents stand for chunks, their vectors come from ``embeddings``; conversations are
rendered as Markdown, pages as a tree. Search takes as queries every vector whose id is
divisible by 50, against all points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import Settings
from lodeseek.functions import storage, text, vectors
from lodeseek.operators import ann, chunking, code_chunks, graph, graph_build, pages, search, sparse
from lodeseek.plans import service
from lodeseek.sources import files, sinks, store
from lodeseek.sources.shared import shared_dir

FLAGSHIP = "vector_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Scores that random vectors reach; the defaults are those of a semantic model.
LEAST, GATE, TOP, WIDTH = 0.2, 0.72, 5, 20
FENCE = "```"

_VECTORS = """pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    qry AS (SELECT b.vec_id AS qid, v.variant, CAST(e.embedding AS DOUBLE[]) AS e FROM embeddings b, (VALUES (0), (1), (2)) v(variant), embeddings e WHERE b.vec_id % 50 = 0 AND e.vec_id = b.vec_id + v.variant)"""


def _ranked(k: int, queries: str = "qry", points: str = "pts", name: str = "ranked") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, id) AS rank
        FROM (SELECT qid, variant, p.id, round(list_cosine_similarity(p.e, q.e), 9) AS score FROM {points} p, {queries} q)) WHERE rank <= {k})"""


def _fused(name: str = "fused", of: str = "ranked") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rrf DESC, f.variant, f.rank, id) AS place
        FROM (SELECT qid, id, max(score) AS score, sum(1.0 / (60 + rank)) AS rrf, min({{'variant': variant, 'rank': rank}}) AS f FROM {of} GROUP BY qid, id))"""


def _query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    asked = points.where("id % 50 = 0").select(F.col("id").alias("qid"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("variant"))
    return asked.join(points, F.col("id") == F.col("qid") + F.col("variant")).select("qid", "variant", "embedding")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).where("variant = 0")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double"})


def _hits(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """The best points of every query with what their documents tell."""
    found = search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), k).withColumnRenamed("rank", "place")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    shown = docs.select("id", "text", F.col("lang").alias("title"), "source", F.col("source").alias("source_id"), F.col("lang").alias("space"), F.concat(F.lit("C:\\"), "source", F.lit("\\"), F.col("id").cast("string")).alias("url"), F.lit("2024-01-01").alias("updated_at"), F.col("n_chars").alias("chunk_idx"))
    return found.join(shown, "id")


_HITS = f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(TOP, "q0")},
    hits AS (SELECT qid, rank AS place, id, score, text, lang, source, n_chars, 'C:\\' || source || '\\' || id AS url FROM ranked JOIN documents ON doc_id = id)"""


@_query(f"WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(TOP, 'q0')} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), TOP).select("qid", "id", "score", "rank"))


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), picked AS (SELECT pts.* FROM pts JOIN documents ON doc_id = id WHERE lang = 'en'), {_ranked(TOP, 'q0', 'picked')}
    SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked""")  # fmt: skip
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return _rounded(search.top_k(search.filtered(points, lang="en", space=None), _first(spark, sf_dir), TOP).select("qid", "id", "score", "rank"))


@_query(f"WITH {_VECTORS}, {_ranked(TOP)} SELECT qid, CAST(variant AS INT) AS variant, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked")
def batch_topk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.top_k(_points(spark, sf_dir), _variants(spark, sf_dir), TOP))


@_query(f"WITH {_VECTORS}, {_ranked(WIDTH)}, {_fused()} SELECT qid, id, round(score, 6) AS score, round(rrf, 6) AS rrf, CAST(place AS INT) AS place FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.fuse(search.top_k(_points(spark, sf_dir), _variants(spark, sf_dir), WIDTH)))


@_query(f"""WITH {_VECTORS}, mean AS (SELECT a.qid, 0 AS variant, list_transform(list_zip(a.e, b.e), lambda x: (x[1] + x[2]) / 2) AS e FROM qry a JOIN qry b ON a.qid = b.qid AND a.variant = 0 AND b.variant = 1),
    asked AS (SELECT * FROM mean UNION ALL SELECT * FROM qry WHERE variant > 0), m0 AS (SELECT * FROM asked WHERE variant = 0), {_ranked(TOP, 'm0', name='pass1')},
    hard AS (SELECT qid FROM pass1 GROUP BY qid HAVING max(score) < {GATE}), h AS (SELECT * FROM asked WHERE qid IN (SELECT qid FROM hard)), {_ranked(WIDTH, 'h')}, {_fused()}
    SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS place, false AS expanded FROM pass1 WHERE qid NOT IN (SELECT qid FROM hard)
    UNION ALL SELECT qid, id, round(score, 6), CAST(place AS INT), true FROM fused WHERE place <= {TOP} AND score >= {LEAST}""")  # fmt: skip
def gated_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _variants(spark, sf_dir)
    pair = every.where("variant = 0").join(every.where("variant = 1").select("qid", F.col("embedding").alias("other")), "qid")
    mean = pair.select("qid", "variant", F.zip_with("embedding", "other", lambda a, b: (a.cast("double") + b.cast("double")) / 2).alias("embedding"))
    rest = every.where("variant > 0").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return _rounded(search.gated_search(_points(spark, sf_dir), mean.unionByName(rest), TOP, GATE, LEAST, WIDTH))


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(WIDTH, 'q0')}
    SELECT qid, count(*) FILTER (WHERE score >= {LEAST}) AS kept, count(*) FILTER (WHERE score < {LEAST}) AS dropped FROM ranked GROUP BY qid""")  # fmt: skip
def threshold_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.threshold(search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), WIDTH), LEAST)[1]


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(WIDTH, 'q0')},
    scored AS (SELECT qid, id, rank, CASE WHEN id % 5 = 0 THEN -1.0 ELSE (id * 7 + qid) % 11 - 5.0 END AS s FROM ranked),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS place FROM scored WHERE s >= 0)
    SELECT qid, id, CAST(s AS DOUBLE) AS score, CAST(place AS INT) AS place FROM placed WHERE place <= {TOP}""")  # fmt: skip
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), WIDTH).withColumnRenamed("rank", "place")
    scores = found.where("id % 5 <> 0").select("qid", "id", ((F.col("id") * 7 + F.col("qid")) % 11 - 5.0).alias("rerank"))
    return search.rerank(found, scores, TOP)


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(WIDTH, 'q0')}
    SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS place FROM ranked WHERE score >= {LEAST} AND rank <= {TOP}""")  # fmt: skip
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), WIDTH).withColumnRenamed("rank", "place")
    return _rounded(search.rerank(found, None, TOP, fallback=LEAST))


@_query(f"WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(TOP, 'q0')} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE score >= {LEAST}")
def code_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.code_top_k(_points(spark, sf_dir), _first(spark, sf_dir), TOP, LEAST).select("qid", "id", "score", "rank"))


@_query(ORACLE["vector_topk"])
def ivf_topk_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all points, searched in all of its cells."""
    index = ann.build(_points(spark, sf_dir), f"{shared_dir(spark)}/lodeseek-ivf-{uuid.uuid4().hex}")
    return _rounded(index.search(_first(spark, sf_dir), TOP).select("qid", "id", "score", "rank"))


@_query()
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true best points of each query the index finds with as many probes as calibration asks for."""
    index = ann.build(_points(spark, sf_dir), f"{shared_dir(spark)}/lodeseek-ivf-{uuid.uuid4().hex}")
    asked = _first(spark, sf_dir)
    return ann.recall(index.search(asked, TOP, index.probes_for(asked, TOP, 0.95)), search.top_k(_points(spark, sf_dir), asked, TOP))


def _bm25(queries: str, k: int) -> str:
    """CTEs that end in ``bm25`` (qid, id, score, rank) for ``queries`` (qid, text) over all documents."""
    return f"""dl AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    total AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dl), tf AS (SELECT id, len(w) AS size, term, count(*) AS n FROM (SELECT id, w, unnest(w) AS term FROM dl) GROUP BY ALL),
    df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), qt AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {queries}) GROUP BY ALL),
    bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, id, round(sum(qt.n * ln(1 + (total.n - d + 0.5) / (d + 0.5)) * tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), total GROUP BY qid, id)) WHERE rank <= {k})"""


def _sparse(spark: SparkSession, sf_dir: str) -> sparse.Bm25:
    return sparse.build(_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/lodeseek-sparse-{uuid.uuid4().hex}", "doc_id")


@_query(f"WITH q AS (SELECT item_id AS qid, text FROM benchmark), {_bm25('q', TOP)} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that fit each benchmark item best by their words."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit(0).alias("variant"), "text")
    return _rounded(_sparse(spark, sf_dir).search(asked, TOP).select("qid", "id", "score", "rank"))


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(WIDTH, 'q0')}, q AS (SELECT doc_id AS qid, text FROM documents WHERE doc_id IN (SELECT qid FROM q0)), {_bm25('q', WIDTH)},
    fused AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT qid, id, rank FROM ranked UNION ALL SELECT qid, id, rank FROM bm25) GROUP BY qid, id)
    SELECT qid, id, round(rrf, 6) AS rrf, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, id) AS INT) AS place FROM fused""")  # fmt: skip
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and word search for the documents of the query vectors, fused by ranks."""
    dense = _first(spark, sf_dir)
    asked = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.lit(1).alias("variant"), "text").join(dense.select("qid").distinct(), "qid", "left_semi")
    lists = search.top_k(_points(spark, sf_dir), dense, WIDTH).unionByName(_sparse(spark, sf_dir).search(asked, WIDTH))
    return _rounded(search.fuse_ranks(lists))


@_query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 50")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_table(spark, sf_dir, "documents"), "source")


@_query(_HITS + " SELECT qid, CAST(place AS INT) AS place, text, source AS document, url AS location FROM hits")
def concise_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.concise(_hits(spark, sf_dir))


@_query(_HITS + " SELECT qid, CAST(place AS INT) AS place, text, lang AS title, source, source AS document, lang AS space, url AS location, '2024-01-01' AS updated, n_chars AS chunk, round(score, 4) AS score FROM hits")
def detailed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.detailed(_hits(spark, sf_dir))


@_query(_HITS + """, first AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY place) AS nth FROM hits)
    SELECT qid, 'Источник: ' || string_agg(source || ' (' || replace(url, '\\', '/') || ')', '; ' ORDER BY place) AS citation FROM first WHERE nth = 1 GROUP BY qid""")  # fmt: skip
def citation_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.citations(_hits(spark, sf_dir))


@_query(_HITS.replace(f"rank <= {TOP}", "rank <= 3") + """ SELECT q0.qid, coalesce(bool_or(contains(lower(text), 'enue') OR contains(lower(text), 'stein')), false) AS hit FROM q0 LEFT JOIN hits USING (qid) GROUP BY q0.qid""")
def eval_marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _first(spark, sf_dir).select("qid", F.array(F.lit("ENUE"), F.lit("stein")).alias("markers"))
    return search.marker_hits(_hits(spark, sf_dir, 3), cases)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): a conversation as Markdown, with a fenced line that looks like a heading."""
    piece = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit(f"\n{FENCE}\n# not a heading\n{FENCE}\n"), "text")
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: t["piece"]), "\n")
    return turns.select("conv_id", F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), body).alias("text"))


_LINES = f"""WITH md AS (SELECT conv_id, '# conv ' || conv_id || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || '{FENCE}' || chr(10) || '# not a heading' || chr(10) || '{FENCE}' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    each AS (SELECT conv_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT conv_id, string_split(text, chr(10)) AS l FROM md)),
    fenced AS (SELECT *, line LIKE '{FENCE}%' AS mark, sum(CASE WHEN line LIKE '{FENCE}%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) % 2 = 1 AS inside FROM each),
    marked AS (SELECT *, CASE WHEN NOT mark AND NOT inside AND regexp_matches(line, '^#{{1,6}}\\s') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level FROM fenced),
    titled AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN level = 1 THEN substr(line, 3) END IGNORE NULLS) OVER w AS one, last_value(CASE WHEN level = 2 THEN substr(line, 4) WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS two FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
    trail AS (SELECT *, CASE WHEN two = '' THEN one ELSE one || ' - ' || two END AS heading FROM titled),
    bodies AS (SELECT * FROM (SELECT conv_id, section, max(heading) AS heading, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') AS body FROM trail GROUP BY conv_id, section) WHERE body <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY section) - 1 AS idx FROM bodies)"""


@_query(_LINES + " SELECT conv_id, CAST(pos AS INT) AS pos, mark OR inside AS fenced FROM marked")
def fence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_lines(_markdown(spark, sf_dir), "conv_id", "text").select("conv_id", "pos", "fenced")


@_query(_LINES + " SELECT conv_id, CAST(pos AS INT) AS pos, CAST(level AS INT) AS level, CAST(section AS BIGINT) AS section, heading FROM trail")
def heading_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = chunking.document_lines(_markdown(spark, sf_dir), "conv_id", "text")
    return chunking.heading_trail(marked, "conv_id").select("conv_id", "pos", "level", "section", "heading")


@_query(_LINES + " SELECT conv_id, CAST(section AS BIGINT) AS section, heading, body FROM bodies")
def section_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(_markdown(spark, sf_dir), "conv_id", "text")


@_query(_LINES + ", h AS (SELECT *, md5('local|' || conv_id || '.md|' || idx) AS m FROM numbered) SELECT conv_id, CAST(idx AS INT) AS chunk_idx, concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) AS id FROM h")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunks(_markdown(spark, sf_dir), "conv_id", "text")
    return chunking.chunk_ids(made, F.lit("local"), F.concat(F.col("conv_id").cast("string"), F.lit(".md"))).select("conv_id", "chunk_idx", "id")


@_query(_LINES + " SELECT conv_id, CAST(idx AS INT) AS chunk_idx, heading || chr(10) || chr(10) || body AS input FROM numbered")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunks(_markdown(spark, sf_dir), "conv_id", "text")
    return made.select("conv_id", "chunk_idx", vectors.input_text(F.col("heading"), F.col("text")).alias("input"))


@_query("""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g') AS body FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\\r?\\n\\s*\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM b WHERE length(body) > 1500),
    step AS (SELECT doc_id, 1 AS i, 0 AS piece, l[1] AS buf FROM p WHERE len(l) > 0 UNION ALL
        SELECT s.doc_id, i + 1, CASE WHEN length(buf) + length(l[i + 1]) > 1500 THEN piece + 1 ELSE piece END, CASE WHEN length(buf) + length(l[i + 1]) > 1500 THEN l[i + 1] ELSE buf || chr(10) || chr(10) || l[i + 1] END FROM step s JOIN p ON p.doc_id = s.doc_id WHERE i < len(l))
    SELECT doc_id, 0 AS piece, body AS text FROM b WHERE length(body) <= 1500 UNION ALL SELECT doc_id, piece, arg_max(buf, i) FROM step GROUP BY doc_id, piece""")  # fmt: skip
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _table(spark, sf_dir, "documents").select("doc_id", text.strip(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("body"))
    return bodies.select("doc_id", F.posexplode(chunking.pack_paragraphs(F.col("body"), 1500)).alias("piece", "text"))


@_query("""WITH each AS (SELECT doc_id, len(l) AS total, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    w AS (SELECT doc_id, total, pos // 10 AS n, string_agg(line, chr(10) ORDER BY pos) AS piece FROM each GROUP BY ALL)
    SELECT doc_id, CAST(n * 10 + 1 AS INT) AS line_start, CAST(least(n * 10 + 10, total) AS INT) AS line_end, left(piece, 4000) AS text FROM w WHERE regexp_matches(piece, '\\S')""")  # fmt: skip
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(_table(spark, sf_dir, "documents"), "doc_id", "text", step=10)


@_query("SELECT doc_id, '## ' || source || ' ' || doc_id || chr(10) || '```' || chr(10) || rtrim(text, chr(10)) || chr(10) || '```' || chr(10) || 'See — it' || chr(10) AS markdown FROM documents")
def asciidoc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("== "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n[source]\n----\n"), F.regexp_replace("text", "\n+$", ""), F.lit("\n----\nimage::x.png[]\nSee -- it((( index )))\n"))
    return chunking.asciidoc_to_markdown(_table(spark, sf_dir, "documents").select("doc_id", written.alias("text")), "doc_id", "text")


@_query("""SELECT doc_id, '# ' || lang || chr(10) || chr(10) || '## ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS markdown FROM documents""")
def storage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    escape = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    markup = F.concat(F.lit("<h2>"), "source", F.lit("</h2><p>"), escape, F.lit("</p>"))
    return _table(spark, sf_dir, "documents").select("doc_id", storage.to_markdown(markup, "lang").alias("markdown"))


@_query("SELECT page_id, trim(regexp_replace(regexp_replace(translate(html, chr(160), ' '), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pages")
def html_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", storage.plain_text(F.col("html")).alias("text"))


@_query("""WITH new AS (SELECT DISTINCT doc_id, source FROM documents JOIN labels USING (doc_id))
    SELECT source, doc_id, lang, 'old' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT d.source, d.doc_id, d.lang, 'new' FROM documents d JOIN new USING (doc_id)""")  # fmt: skip
def delete_then_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    fresh = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("source", "doc_id", "lang", F.lit("new").alias("state"))
    return store.replaced(docs.withColumn("state", F.lit("old")), fresh, ("source", "doc_id"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") > 0, F.expr("page_id div 4")).alias("parent"))


_CLOSURE = """WITH RECURSIVE t AS (SELECT page_id AS root, page_id AS id, 0 AS depth FROM pages UNION ALL SELECT t.root, p.page_id, t.depth + 1 FROM t JOIN pages p ON p.page_id // 4 = t.id AND p.page_id > 0)"""


@_query(_CLOSURE + " SELECT root, id, CAST(min(depth) AS INT) AS depth FROM t GROUP BY root, id")
def page_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return pages.descendants(tree, tree)


@_query(_CLOSURE + " SELECT root, count(DISTINCT id) AS pages FROM t GROUP BY root")
def page_subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.subtree_sizes(_tree(spark, sf_dir))


@_query("SELECT page_id AS id, min(page_id % 3) AS root_ord, page_id AS pos FROM pages GROUP BY page_id")
def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("root_ord"), F.col("page_id").alias("pos"))
    again = listed.withColumn("root_ord", F.col("root_ord") + 1)
    return pages.first_occurrences(listed.unionByName(again))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("v"), F.expr("page_id % 5 = 0").cast("int").cast("string")).alias("updated"))
    before = _table(spark, sf_dir, "pages").where("page_id % 7 <> 3").select(F.col("page_id").alias("id"), F.lit("v0").alias("updated"))
    return pages.change_set(now, before)


_CHANGES = "WITH c AS (SELECT page_id AS id, 'v' || CAST(page_id % 5 = 0 AS INT) AS updated, CASE WHEN page_id % 7 = 3 THEN 'new' WHEN page_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM pages)"


@_query(_CHANGES + " SELECT * FROM c")
def page_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@_query(_CHANGES + " SELECT action, count(*) AS n FROM c GROUP BY action")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sync_stats(_changes(spark, sf_dir))


@_query("""SELECT doc_id, left(CASE WHEN n = '' THEN 'untitled' ELSE n END, 120) AS name FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '-', 'g'), '. '), '\\s+', ' ', 'g') AS n FROM documents)""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.col("text")).alias("name"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("test_a.py", "main.py", "notes.rst", "Dockerfile", "deploy.YML", "latest_x.py"))), (F.col("n_chars") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), F.concat(F.when(F.col("doc_id") % 10 == 0, "vendor").otherwise(F.col("lang")), F.lit("/"), name).alias("path"))


_PATHS = "WITH f AS (SELECT doc_id, source AS repo, CASE WHEN doc_id % 10 = 0 THEN 'vendor' ELSE lang END AS dir, ['test_a.py', 'main.py', 'notes.rst', 'Dockerfile', 'deploy.YML', 'latest_x.py'][n_chars % 6 + 1] AS name FROM documents), s AS (SELECT *, dir = 'vendor' OR contains(lower(name), 'test_') OR contains(lower(name), '_test') OR contains(lower(name), 'conftest') AS skipped, name LIKE '%.py' OR name = 'Dockerfile' AS admitted FROM f)"


@_query(_PATHS + " SELECT doc_id, skipped, admitted FROM s")
def skip_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", code_chunks.skipped(F.col("path")).alias("skipped"), code_chunks.admitted(F.col("path")).alias("admitted"))


@_query(_PATHS + " SELECT repo, count(*) AS seen, count(*) FILTER (WHERE admitted AND NOT skipped) AS taken, count(*) FILTER (WHERE skipped) AS skipped_by_name FROM s GROUP BY repo")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_chunks.scan_report(_paths(spark, sf_dir))


@_query(_PATHS + " SELECT regexp_extract(name, '(\\.[^.]+)$', 1) AS ext, count(*) AS n FROM s WHERE NOT admitted GROUP BY 1 ORDER BY n DESC, ext LIMIT 12")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_chunks.rejected_extensions(_paths(spark, sf_dir))


@_query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, bucket, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")  # fmt: skip
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.word_buckets(_table(spark, sf_dir, "documents"), "doc_id", "text", 256))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("EXTRACTED").alias("confidence"))


_EDGES = "WITH RECURSIVE e AS (SELECT page_id AS src, page_id // 4 AS dst FROM pages WHERE page_id > 0), u AS (SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"


@_query(_EDGES + " SELECT src AS id, count(*) AS degree FROM u GROUP BY src")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@_query(_EDGES + " SELECT src AS id, dst AS neighbour FROM u")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), _tree(spark, sf_dir).select("id"))


@_query(_EDGES + ", d AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS distance UNION ALL SELECT u.dst, distance + 1 FROM d JOIN u ON u.src = d.id AND u.dst > u.src) SELECT id, CAST(min(distance) AS INT) AS distance FROM d GROUP BY id")
def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(_edges(spark, sf_dir), 0).withColumn("id", F.col("id").cast("long"))


@_query("SELECT (SELECT count(*) FROM pages) AS nodes, (SELECT count(*) FROM pages WHERE page_id > 0) AS edges, (SELECT count(*) FROM pages WHERE page_id > 0) AS extracted, CAST(0 AS BIGINT) AS inferred, CAST(0 AS BIGINT) AS ambiguous")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(_tree(spark, sf_dir), _edges(spark, sf_dir))


@_query(_EDGES + ", p AS (SELECT max(page_id) AS id FROM pages UNION ALL SELECT id // 4 FROM p WHERE id > 0) SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS step FROM p")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _table(spark, sf_dir, "pages").agg(F.max("page_id")).first()[0]
    return graph.path(_edges(spark, sf_dir), 0, last)


@_query("SELECT page_id AS id, url AS label, lower(url) = '12' OR CAST(page_id AS VARCHAR) = '12' AS exact FROM pages WHERE contains(lower(url), '12') OR contains(CAST(page_id AS VARCHAR), '12')")
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("label")), "12")


def _votes(n: int) -> str:
    return f", l{n} AS (SELECT src AS id, community FROM (SELECT a.src, l.community, row_number() OVER (PARTITION BY a.src ORDER BY count(*) DESC, l.community) AS place FROM a JOIN l{n - 1} l ON a.dst = l.id GROUP BY a.src, l.community) WHERE place = 1)"


@_query(_EDGES + ", a AS (SELECT * FROM u UNION SELECT src, src FROM u), l0 AS (SELECT DISTINCT src AS id, src AS community FROM u)" + "".join(map(_votes, (1, 2, 3))) + " SELECT * FROM l3")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(_edges(spark, sf_dir), rounds=3)


@_query("""WITH new AS (SELECT DISTINCT doc_id FROM labels)
    SELECT source, doc_id, lang, CASE WHEN n.doc_id IS NULL THEN 'old' ELSE 'new' END AS state FROM documents d LEFT JOIN new n USING (doc_id) WHERE d.doc_id % 10 <> 3""")  # fmt: skip
def store_upsert_and_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of documents after a first write, an upsert of those with labels and a purge of some."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    table = store.Store(spark, f"{shared_dir(spark)}/lodeseek-store-{uuid.uuid4().hex}", "source string, doc_id long, lang string, state string")
    table.write(docs.withColumn("state", F.lit("old")))
    table.upsert(docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("state", F.lit("new")), ("source", "doc_id"))
    table.purge(docs.where("doc_id % 10 = 3").select("source", "doc_id"))
    return table.read()


@_query(ORACLE["store_upsert_and_purge"])
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store in smaller steps (by key, then whole partitions folded), which gives the same rows."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    table = store.Store(spark, f"{shared_dir(spark)}/lodeseek-store-{uuid.uuid4().hex}", "source string, doc_id long, lang string, state string")
    fresh = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("state", F.lit("new"))
    table.write(docs.withColumn("state", F.lit("old")))
    for half in (0, 1):
        table.upsert(fresh.where(F.col("doc_id") % 2 == half), ("source", "doc_id"))
    table.purge(docs.where("doc_id % 10 = 3").select("source", "doc_id"))
    table.compact()
    return table.read()


@_query("""WITH d AS (SELECT source, CASE WHEN n.doc_id IS NULL THEN lang ELSE 'new' END AS lang FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) n USING (doc_id) WHERE d.doc_id % 10 <> 3)
    SELECT 'source' AS "column", source AS value, count(*) AS n FROM d GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM d GROUP BY lang""")  # fmt: skip
def kept_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values that a store keeps through an upsert and a purge."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    table = store.Store(spark, f"{shared_dir(spark)}/lodeseek-store-{uuid.uuid4().hex}", "source string, doc_id long, lang string", facets=("source", "lang"))
    table.write(docs)
    table.upsert(docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("lang", F.lit("new")), ("source", "doc_id"))
    table.purge(docs.where("doc_id % 10 = 3").select("source", "doc_id"))
    return table.facets()


@_query("""SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || '### Deep ' || lang || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || doc_id || ' < 3' || chr(10) || '```' || chr(10) || chr(10) || '> note ' || source || chr(10) || chr(10)
    || '- ' || source || chr(10) || '  1. in ' || lang || chr(10) || '- end' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |' || chr(10) || chr(10) || '```' || chr(10) || 'x  y' || chr(10) || '```' || chr(10) || chr(10) || 'see «' || source || '» & — it' || chr(10) AS markdown FROM documents""")  # fmt: skip
def storage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros, lists, tables, preformatted text, links, entities and unknown elements around values of the documents."""
    number = F.col("doc_id").cast("string")
    pieces = ["<h3>Deep ", "lang", '</h3><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[SELECT ', number, ' < 3]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name="warning"><p>note ', "source", "</p></ac:structured-macro><ul><li>", "source", "<ol><li>in ", "lang", "</li></ol></li><li>end</li></ul><table><tbody><tr><th>a</th><th>b</th></tr><tr><td>", number, '</td></tr></tbody></table><pre>x  y</pre><layout><p>see <ac:link><ri:page ri:content-title="', "source", '"/></ac:link> &amp; &mdash;&nbsp;it</p></layout>']
    markup = F.concat(*[p if not isinstance(p, str) else F.col(p) if p in ("lang", "source") else F.lit(p) for p in pieces])
    return _table(spark, sf_dir, "documents").select("doc_id", storage.to_markdown(markup, number).alias("markdown"))


@_query("""WITH h(n, heading, body) AS (VALUES (0, 'A - B - C - D - E - F', 'six'), (1, 'A - B - C - D - G', 'five'), (2, 'A - H', 'two'), (3, 'A - H - I', 'four'), (4, 'J', 'one'))
    SELECT doc_id, heading, body || ' ' || lang AS body FROM documents, h""")  # fmt: skip
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under headings of all six levels, with levels left out and closed."""
    parts = ["# A\n## B\n### C\n#### D\n##### E\n###### F\nsix ", "\n##### G\nfive ", "\n## H\ntwo ", "\n#### I\nfour ", "\n# J\none "]
    text_ = F.concat(*[x for p in parts for x in (F.lit(p), F.col("lang"))])
    return chunking.sections(_table(spark, sf_dir, "documents").select("doc_id", text_.alias("text")), "doc_id", "text").select("doc_id", "heading", "body")


@_query("""WITH s(symbol, kind, signature, doc, line_start, line_end) AS (VALUES ('read', 'function', 'def read(a, b)', 'Doc of it.', 3, 5), ('Big', 'class', 'class Big(Base)', '', 7, 9), ('Big.go', 'asyncfunction', 'async def go(self)', '', 8, 9))
    SELECT source AS repo, 'm' || doc_id || '.py' AS path, symbol, kind, signature, doc, line_start, line_end FROM documents, s
    UNION ALL SELECT source, 'c' || doc_id || '.py', 'c' || doc_id, 'module', '', '', 1, 4 FROM documents""")  # fmt: skip
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Python modules, of one with constants only, and of one that doesn't parse."""
    module = 'import x\n\ndef read(a, b):\n    """Doc of it."""\n    return "%s"\n\nclass Big(Base):\n    async def go(self):\n        pass\n'
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), "doc_id", "lang")
    made = [docs.select("repo", F.concat(F.lit(name), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.format_string(body, "lang").alias("content")) for name, body in (("m", module), ("c", "A = 1\nB = 2\nC = 3\nD = '%s'\n"), ("bad", "def (%s"))]
    found = code_chunks.code_chunks(made[0].unionByName(made[1]).unionByName(made[2]))
    return found.select("repo", "path", "symbol", "kind", "signature", "doc", "line_start", "line_end")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): a module for each document, which imports the next one's function and calls a method by its name alone."""
    n, after, third = (F.col(c).cast("string") for c in ("doc_id", "after", "third"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") + 1).alias("after"), F.expr("doc_id div 3").alias("third"))
    parts = ["from m", after, " import f", after, " as g\n\nclass C", n, ":\n    def go_", third, "(self):\n        return f", n, "(self)\n\ndef f", n, "(x):\n    x.go_", third, "()\n    return g(x)\n"]
    return docs.select(F.col("source").alias("repo"), F.concat(F.lit("m"), n, F.lit(".py")).alias("path"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("content"))


_GRAPH = """WITH d AS (SELECT doc_id AS n, source AS repo, source || ':m' || doc_id AS m, doc_id // 3 AS t FROM documents),
    fits AS (SELECT d.n, o.n AS other, count(*) OVER (PARTITION BY d.n) AS many FROM d JOIN (SELECT n, repo, t FROM d) o ON o.t = d.t AND o.repo = d.repo),
    nodes AS (SELECT m AS id, 'module' AS kind FROM d UNION ALL SELECT m || '.C' || n, 'class' FROM d UNION ALL SELECT m || '.C' || n || '.go_' || t, 'function' FROM d UNION ALL SELECT m || '.f' || n, 'function' FROM d
        UNION ALL SELECT 'external:m' || (n + 1), 'external' FROM d WHERE n + 1 NOT IN (SELECT n FROM d)),
    edges AS (SELECT m AS src, m || '.C' || n AS dst, 'contains' AS kind, 'EXTRACTED' AS confidence FROM d UNION ALL SELECT m || '.C' || n, m || '.C' || n || '.go_' || t, 'contains', 'EXTRACTED' FROM d UNION ALL SELECT m, m || '.f' || n, 'contains', 'EXTRACTED' FROM d
        UNION ALL SELECT m || '.C' || n || '.go_' || t, m || '.f' || n, 'calls', 'EXTRACTED' FROM d
        UNION ALL SELECT a.m, coalesce(b.m || '.f' || b.n, 'external:m' || (a.n + 1)), 'imports', 'EXTRACTED' FROM d a LEFT JOIN d b ON b.n = a.n + 1
        UNION ALL SELECT a.m || '.f' || a.n, b.m || '.f' || b.n, 'calls', 'EXTRACTED' FROM d a JOIN d b ON b.n = a.n + 1
        UNION ALL SELECT a.m || '.f' || a.n, b.m || '.C' || b.n || '.go_' || b.t, 'calls', CASE WHEN many = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END FROM fits JOIN d a ON a.n = fits.n JOIN d b ON b.n = fits.other)"""


@_query(_GRAPH + " SELECT * FROM edges")
def graph_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph of modules, one for each document, of all three confidences."""
    return graph_build.build(_code(spark, sf_dir))[1]


@_query(_GRAPH + " SELECT id, kind FROM nodes")
def graph_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_build.build(_code(spark, sf_dir))[0].select("id", "kind")


@_query(_GRAPH + """ SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3, a.kind AS e1, a.confidence AS c1, b.kind AS e2, b.confidence AS c2, c.kind AS e3, c.confidence AS c3
    FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst JOIN nodes k ON k.id = a.dst
    WHERE a.kind = 'contains' AND k.kind = 'class' AND b.kind = 'contains' AND c.kind = 'calls' AND c.confidence = 'EXTRACTED'""")  # fmt: skip
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What methods of a module's classes surely call: a pattern of three hops."""
    nodes, edges = graph_build.build(_code(spark, sf_dir))
    hop = graph.Hop
    return graph.match(nodes, edges, hop(nodes=("module",)), hop(("contains",), nodes=("class",)), hop(("contains",)), hop(("calls",), ("EXTRACTED",)))


@_query(_GRAPH.replace("WITH d", "WITH RECURSIVE d") + """, s AS (SELECT m || '.f' || n AS start, n FROM d WHERE n % 50 = 0),
    r AS (SELECT start, start AS id, 0 AS distance FROM s UNION ALL SELECT r.start, e.src, distance + 1 FROM r JOIN edges e ON e.dst = r.id AND e.kind = 'calls' WHERE distance < 3)
    SELECT start, id, CAST(min(distance) AS INT) AS distance FROM r GROUP BY start, id""")  # fmt: skip
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls the functions of every fiftieth module, over up to three calls."""
    edges = graph_build.build(_code(spark, sf_dir))[1].where("kind = 'calls'")
    wanted = _code(spark, sf_dir).select(F.concat("repo", F.lit(":m"), F.regexp_extract("path", r"\d+", 0), F.lit(".f"), F.regexp_extract("path", r"\d+", 0)).alias("id"), F.regexp_extract("path", r"\d+", 0).cast("long").alias("n")).where("n % 50 = 0")
    return graph.reach(edges, wanted, backwards=True, most=3)


_LINKS = """WITH l AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""


@_query(_LINKS + ", u AS (SELECT src, dst FROM l WHERE src <> dst UNION SELECT dst, src FROM l WHERE src <> dst) SELECT src AS id, count(*) AS degree FROM u GROUP BY src")
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses each address is linked with, by the links in the pages."""
    links = _table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return graph.degrees(links)


@_query("""SELECT lang || '/' || source || '/' || doc_id || '.md' AS source_id, source AS space, CAST(doc_id AS VARCHAR) AS title, lang AS source, text FROM documents WHERE regexp_matches(text, '\\S')""")
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Markdown files by the sink, and scanned again."""
    sinks.register(spark)
    root = f"{shared_dir(spark)}/lodeseek-files-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file"), F.col("text").alias("markdown"))
    rows.write.format("markdown").mode("append").option("path", root).save()
    return files.with_source_labels(files.documents(spark, root)).select("source_id", "space", "title", "source", "text")


_ASCIIDOC = """'## ' || source || chr(10) || '```' || chr(10) || rtrim(text, chr(10)) || chr(10) || '```' || chr(10) || 'See — it `x`' || chr(10)"""


@_query(f"SELECT lang AS chapter, CAST(doc_id AS VARCHAR) AS stem, {_ASCIIDOC} AS markdown FROM documents WHERE length({_ASCIIDOC}) >= 800")
def asciidoc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inside listings of the four kinds of AsciiDoc, written as files and scanned again; short ones are dropped."""
    sinks.register(spark)
    root = f"{shared_dir(spark)}/lodeseek-files-{uuid.uuid4().hex}"
    mark = F.element_at(F.array(*map(F.lit, ("----", "....", "====", "****"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    body = F.concat(F.lit("== "), "source", F.lit("\n[source,sql]\n"), mark, F.lit("\n"), F.regexp_replace("text", "\n+$", ""), F.lit("\n"), mark, F.lit("\nimage::a.png[]\nSee -- it((( i, j ))) `+x+`\n"))
    rows = _table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".asc")).alias("file"), body.alias("markdown"))
    rows.write.format("markdown").mode("append").option("path", root).save()
    return files.asciidoc(spark, root)


@_query("""SELECT doc_id, source || '/m' || doc_id || '.py :: ' || lang || chr(10) || CASE WHEN n_chars % 2 = 0 THEN 'def f(a)' || chr(10) ELSE '' END || CASE WHEN n_chars % 3 = 0 THEN 'Doc.' || chr(10) ELSE '' END || text AS input FROM documents""")
def code_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of code, with and without signature and documentation."""
    some = lambda value, n: F.when(F.col("n_chars") % n == 0, value).otherwise("")
    made = vectors.code_input_text(F.col("source"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")), F.col("lang"), some("def f(a)", 2), some("Doc.", 3), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", made.alias("input"))


@_query(_HITS + " SELECT qid, CAST(place AS INT) AS place, source || '/' || lang || ':' || n_chars AS location, lang AS symbol, 'function' AS kind, CASE WHEN n_chars % 2 = 0 THEN 'def f()' END AS signature, CAST(NULL AS VARCHAR) AS doc, left(text, 600) AS code FROM hits")
def code_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as rows of code, cut where they are long; empty signatures and documentation are null."""
    hits = _hits(spark, sf_dir).select("qid", "place", F.col("source").alias("repo"), F.col("title").alias("path"), F.col("chunk_idx").alias("line_start"), F.col("title").alias("symbol"), F.lit("function").alias("kind"), F.when(F.col("chunk_idx") % 2 == 0, "def f()").otherwise("").alias("signature"), F.lit("").alias("doc"), "text")
    return search.code_rows(hits)


@_query("""SELECT page_id AS id, page_id % 3 AS root_ord, length(html) AS pos, url AS title FROM pages ORDER BY root_ord, pos, url LIMIT 40""")
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of the listing, as a limited run takes them."""
    listed = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("root_ord"), F.length("html").alias("pos"), F.col("url").alias("title"))
    return pages.limited(listed, 40)


@_query("""SELECT doc_id, '# ' || source || chr(10) || chr(10) || trim(regexp_replace('see ' || text || ' & more', '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10)) || chr(10) AS markdown FROM documents""")
def storage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup that isn't well-formed around the documents' texts: their plain text."""
    escape = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _table(spark, sf_dir, "documents").select("doc_id", storage.to_markdown(F.concat(F.lit("<p>see "), escape, F.lit(" <b>&amp; more</p>")), "source").alias("markdown"))


@_query("""SELECT doc_id, lang || chr(10) || chr(10) || '[изображение: ' || doc_id || '.png]' || chr(10) || chr(10) || '[изображение: изображение]' || chr(10) || chr(10) || 'to ' || source || chr(10) || chr(10) || '- ' || source || chr(10) || '  - in' || chr(10) || '- out' || chr(10) AS markdown FROM documents""")
def storage_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images that name no page or file, and list items whose own text a nested list repeats."""
    number = F.col("doc_id").cast("string")
    pieces = ["<ac:link><ri:user/><ac:plain-text-link-body>", F.col("lang"), '</ac:plain-text-link-body></ac:link><ac:image ac:alt="a"><ri:attachment ri:filename=\'', number, ".png'/></ac:image><ac:image><ri:url/></ac:image><ac:link ac:anchor=\"x\"><ac:link-body>to ", F.col("source"), "</ac:link-body></ac:link><ul><li>", F.col("source"), "<ul><li>in</li></ul>in</li><li>out</li></ul>"]
    markup = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return _table(spark, sf_dir, "documents").select("doc_id", storage.to_markdown(markup, F.lit("")).alias("markdown"))


@_query(_HITS.replace(f"rank <= {TOP}", "rank <= 3") + """, e AS (SELECT q0.qid, coalesce(bool_or(contains(lower(text), 'enue') OR contains(lower(text), 'stein')), false) AS hit FROM q0 LEFT JOIN hits USING (qid) GROUP BY q0.qid)
    SELECT count(*) AS questions, count(*) FILTER (WHERE hit) AS hits, round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(qid / 2.0), 6) AS mean_seconds FROM e""")  # fmt: skip
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions have an answer among their best three documents."""
    cases = eval_marker_hits(spark, sf_dir)
    return _rounded(search.hit_rate(cases, cases.select("qid", (F.col("qid") / 2.0).alias("seconds"))))


@_query(f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), {_ranked(WIDTH, 'q0')}, s AS (SELECT qid, count(*) FILTER (WHERE score < 0.3) AS dropped, count(*) FILTER (WHERE score >= 1.1) AS found FROM ranked GROUP BY qid)
    SELECT qid, dropped, CASE WHEN dropped > 15 THEN 'below_threshold' WHEN qid % 100 = 0 THEN 'try_without_filters' ELSE 'rephrase' END AS reason FROM s""")  # fmt: skip
def no_hit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the three replies a question without hits gets."""
    stats = search.threshold(search.top_k(_points(spark, sf_dir), _first(spark, sf_dir), WIDTH), 0.3)[1]
    return stats.select("qid", "dropped", search.no_hit_reason(F.greatest(F.col("dropped") - 15, F.lit(0)), F.col("qid") % 100 == 0).alias("reason"))


@_query("""SELECT doc_id, array_to_string(list_concat([lang], list_filter([source, upper(lang), ' ', source || ' ' || doc_id, CAST(doc_id AS VARCHAR)], lambda v: trim(v) <> '' AND lower(trim(v)) <> lower(lang))[1:2]), '|') AS variants FROM documents""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query and the variants that are accepted for it."""
    offered = F.array(F.col("source"), F.upper("lang"), F.lit(" "), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.accepted_variants(F.col("lang"), offered), "|").alias("variants"))


@_query("""SELECT doc_id, concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) AS id, regexp_replace(text || chr(10) || chr(10) || chr(10) || lang, '\n{3,}', chr(10) || chr(10), 'g') AS collapsed FROM (SELECT *, md5(source || '|m' || doc_id || '.py|' || lang || '|' || n_chars) AS m FROM documents)""")
def code_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of code chunks, and texts without runs of empty lines."""
    made = text.code_chunk_id(F.col("source"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")), F.col("lang"), F.col("n_chars"))
    return _table(spark, sf_dir, "documents").select("doc_id", made.alias("id"), text.collapse_blank_lines(F.concat("text", F.lit("\n\n\n"), "lang")).alias("collapsed"))


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors as the chunks that search reads."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("title"), "source", F.col("source").alias("source_id"), F.col("lang").alias("space"), F.concat(F.lit("C:\\"), "source", F.lit("\\"), F.col("doc_id").cast("string")).alias("url"), F.lit("2024-01-01").alias("updated_at"), F.col("n_chars").alias("chunk_idx"))
    return docs.join(_points(spark, sf_dir), "id")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable]:
    """Questions (qid, query), one for every fiftieth vector, and what embeds them: the vector of that number."""
    points = _points(spark, sf_dir)
    embed = lambda rows: rows.join(points.withColumnRenamed("id", "qid"), "qid")
    return points.where("id % 50 = 0").select(F.col("id").alias("qid"), F.concat(F.lit("question "), F.col("id").cast("string")).alias("query")), embed


_TOOLS = Settings(score_least=0.2, code_score_least=0.25, gate=0.0)
_ANSWERED = f"""WITH {_VECTORS}, q0 AS (SELECT * FROM qry WHERE variant = 0), k AS (SELECT p.* FROM pts p JOIN documents ON doc_id = p.id WHERE {{0}}), {_ranked(TOP, 'q0', 'k')},
    found AS (SELECT qid, rank AS place, id, score, text, lang, source, n_chars, 'C:\\' || source || '\\' || id AS url FROM ranked JOIN documents ON doc_id = id)"""


@_query(_ANSWERED.format("true") + " SELECT qid, CAST(place AS INT) AS place, text, source AS document, url AS location FROM found WHERE score >= 0.2")
def kb_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document tool's hits for all questions."""
    asked, embed = _asked(spark, sf_dir)
    return service.kb_search(_knowledge(spark, sf_dir), asked, embed, TOP, settings=_TOOLS)[0]


@_query(_ANSWERED.format("lang = 'de'") + """, one AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY place) AS nth FROM found WHERE score >= 0.2),
    c AS (SELECT qid, 'Источник: ' || string_agg(source || ' (' || replace(url, '\\', '/') || ')', '; ' ORDER BY place) AS citation FROM one WHERE nth = 1 GROUP BY qid)
    SELECT q0.qid, count(*) FILTER (WHERE score >= 0.2) AS found, count(*) FILTER (WHERE score < 0.2) AS dropped, CASE WHEN count(*) FILTER (WHERE score >= 0.2) = 0 THEN CASE WHEN count(*) FILTER (WHERE score < 0.2) > 0 THEN 'below_threshold' ELSE 'try_without_filters' END END AS reason, any_value(citation) AS citation
    FROM q0 LEFT JOIN found ON found.qid = q0.qid LEFT JOIN c ON c.qid = q0.qid GROUP BY q0.qid""")  # fmt: skip
def kb_search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document tool's answers in one space: how many hits, why none, what is cited."""
    asked, embed = _asked(spark, sf_dir)
    return service.kb_search(_knowledge(spark, sf_dir), asked, embed, TOP, space="de", settings=_TOOLS)[1]


@_query(_ANSWERED.format("true") + " SELECT qid, CAST(place AS INT) AS place, source || '/' || lang || ':' || n_chars AS location, lang AS symbol, 'function' AS kind, 'def f()' AS signature, CAST(NULL AS VARCHAR) AS doc, text AS code FROM found WHERE score >= 0.25")
def code_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code tool's rows for all questions, code in full."""
    asked, embed = _asked(spark, sf_dir)
    points = _knowledge(spark, sf_dir).select("id", F.col("source").alias("repo"), F.col("title").alias("path"), F.col("title").alias("symbol"), F.lit("function").alias("kind"), F.lit("def f()").alias("signature"), F.lit("").alias("doc"), F.col("chunk_idx").alias("line_start"), "text", "embedding")
    return service.code_search(points, asked, embed, TOP, full=True, settings=_TOOLS)


@_query("""SELECT source AS repo, 'm' || doc_id || '.py' AS path, 'from m' || (doc_id + 1) || ' import f' || (doc_id + 1) || ' as g' || chr(10) || chr(10) || 'class C' || doc_id || ':' || chr(10) || '    def go_' || (doc_id // 3) || '(self):' || chr(10) || '        return f' || doc_id || '(self)' || chr(10) || chr(10)
    || 'def f' || doc_id || '(x):' || chr(10) || '    x.go_' || (doc_id // 3) || '()' || chr(10) || '    return g(x)' || chr(10) AS content FROM documents UNION ALL SELECT DISTINCT source, 'tests/t.py', NULL FROM documents""")  # fmt: skip
def scanned_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories written as files below repos/ and scanned again; files that are skipped have no content."""
    sinks.register(spark)
    root = f"{shared_dir(spark)}/lodeseek-files-{uuid.uuid4().hex}"
    made = _code(spark, sf_dir)
    tests = made.select("repo").distinct().select("repo", F.lit("tests/t.py").alias("path"), F.lit("x = 1\n").alias("content"))
    every = made.unionByName(tests).unionByName(made.limit(1).select(F.lit(".git").alias("repo"), F.lit("config").alias("path"), F.lit("no").alias("content")))
    every.select(F.concat(F.lit("repos/"), "repo", F.lit("/"), "path").alias("file"), F.col("content").alias("markdown")).write.format("markdown").mode("append").option("path", root).save()
    return files.code_files(spark, root)


_CLEAN = """translate(text, '"\\' || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || chr(0), '')"""


@_query(f"""WITH m AS (SELECT *, {_CLEAN} AS t FROM documents)
    SELECT source AS repo, 'm' || doc_id || '.py' AS path, 'f' AS symbol, 'def f(a, *b, **d)' AS signature, left(repeat(lang, 200), 300) AS doc, 2 AS line_start, CAST(4 + length(t) - length(replace(t, chr(10), '')) AS INT) AS line_end,
        left('def f(a, *b, c=1, **d):' || chr(10) || '    ''' || repeat(lang, 200) || '''' || chr(10) || '    return \"\"\"' || t || '\"\"\"', 4000) AS text FROM m""")  # fmt: skip
def code_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with starred arguments, long documentation and bodies that hold whole documents: what is cut, and where."""
    t = F.regexp_replace("text", "[\"\\\\\\\\\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029\\x00]", "")
    content = F.concat(F.lit("@d\ndef f(a, *b, c=1, **d):\n    '"), F.repeat("lang", F.lit(200)), F.lit("'\n    return \"\"\""), t, F.lit('"""\n'))
    found = code_chunks.code_chunks(_table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), content.alias("content")))
    return found.select("repo", "path", "symbol", "signature", "doc", "line_start", "line_end", "text")
