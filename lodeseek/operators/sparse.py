"""Sparse search: an index of documents as lists of words with counts, scored by BM25 where the lists are read.

Words are runs of letters and digits of the lower-cased text, told apart by 64 bits of
their hashes. A task holds a tile, some documents and some queries: each query sums its
words' postings in the tile and sends on its best k of the tile only, so what is shuffled
grows with documents and queries, not with the pairs of them that share a word. Words that
are frequent in the tile are left to the end: where the k-th best score so far exceeds what
they could add, they are looked up for the remaining candidates only, and the result stays
exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.search import ranked
from lodeseek.sources.shared import written

#: The usual constants of BM25, and the share of a tile's documents from which on a word is frequent there.
K1, B, FREQUENT = 1.2, 0.75, 0.05
#: Entries (a word of a document, or of a query): of queries that are sent to all tasks, of queries and of documents that meet in a tile, of documents in each task while there are few.
SENT, ASKED, STRIPE, SMALL_STRIPE = 1 << 20, 1 << 23, 1 << 22, 1 << 18
#: Bytes of the frequent words' weights that a tile holds.
DENSE = 64 << 20
_EPS = 1e-6


def words(text: Column) -> Column:
    """The words of a text; none of a null one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, terms, times) of (id, words)."""
    for batch in batches:
        lists = batch.column("words")
        size = lists.value_lengths().to_numpy().astype(np.int64)
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        first = np.flatnonzero((np.diff(flat, prepend=0) != 0) | (np.diff(row, prepend=-1) != 0))
        offsets = pa.array(np.searchsorted(row[first], np.arange(len(size) + 1)), pa.int32())
        times = np.diff(first, append=len(flat)).astype(np.int32)
        cols = [batch.column("id"), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(flat[first])), pa.ListArray.from_arrays(offsets, pa.array(times))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "terms", "times"])


def build(docs: DataFrame, root: str, key: str = "id", text: str = "text") -> Bm25:
    """Writes the index of ``docs`` to ``root``, a new folder that all executors reach: documents, terms and stats.

    key: tells documents apart; rows of one key are one document. Documents without words
    count in the mean length, and are never found.
    """
    spark = docs.sparkSession
    each = docs.select(F.col(key).alias("id"), _hashes(F.col(text)).alias("words"))
    again = written(docs.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        whole = each.join(again, same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
        each = each.join(again, same, "left_anti").unionByName(whole)
    kind = each.schema["id"].dataType.simpleString()
    each.mapInArrow(_counted, f"id {kind}, size long, terms array<long>, times array<int>").write.parquet(f"{root}/documents")
    rows = spark.read.parquet(f"{root}/documents")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs")).write.parquet(f"{root}/terms")
    rows.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).coalesce(1).write.parquet(f"{root}/stats")
    return Bm25(spark, root)


class _Queries:
    """Queries of (qid, variant, terms, gains), their words as indexes into a sorted list of all of them."""

    def __init__(self, rows: pa.Table):
        self.qid, self.variant = (rows.column(c).to_numpy() for c in ("qid", "variant"))
        terms, gains = (rows.column(c).combine_chunks() for c in ("terms", "gains"))
        self.vocabulary, self.terms = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        self.gains = gains.flatten().to_numpy()
        size = terms.value_lengths().to_numpy().astype(np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def best(self, k: int) -> np.ndarray:
        """Room for the best k scores of each query."""
        return np.full((len(self.qid), k), -np.inf)


def _scored(docs: pa.Table, queries: _Queries, best: np.ndarray, mean: float, k: int, frequent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) as indexes: the best ``k`` of each query in a tile that can still be among its best, by ``best``, which is updated."""
    n = docs.num_rows
    column = lambda c: docs.column(c).combine_chunks()
    terms, vocabulary = column("terms"), queries.vocabulary
    row, flat = np.repeat(np.arange(n), terms.value_lengths().to_numpy().astype(np.int64)), terms.flatten().to_numpy()
    at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
    met = np.flatnonzero(vocabulary[at] == flat) if len(vocabulary) else np.zeros(0, np.int64)
    times = column("times").flatten().to_numpy()[met].astype(np.float64)
    at, row = at[met], row[met]
    weight = times * (K1 + 1) / (times + (K1 * (1 - B + B * column("size").to_numpy() / (mean or 1.0)))[row])
    order = np.argsort(at, kind="stable")
    at, row, weight = at[order], row[order], weight[order]
    length = np.bincount(at, minlength=len(vocabulary))
    start = np.cumsum(length) - length
    often = np.flatnonzero(length > frequent * n)
    often = often[np.argsort(-length[often], kind="stable")][: DENSE // (8 * max(1, n))]
    held, place = np.zeros((len(often), n)), np.full(len(vocabulary), -1)
    place[often] = np.arange(len(often))
    inside = np.flatnonzero(place[at] >= 0)
    held[place[at[inside]], row[inside]] = weight[inside]
    most = held.max(1, initial=0.0)
    by_id = np.empty(n, np.int64)
    by_id[pc.sort_indices(column("id"), null_placement="at_start").to_numpy()] = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, (a, b) in enumerate(zip(queries.starts.tolist(), queries.ends.tolist(), strict=True)):
        words_, gains = queries.terms[a:b], queries.gains[a:b]
        dense = place[words_]
        last = np.flatnonzero(dense >= 0)
        rare = np.flatnonzero((dense < 0) & (length[words_] > 0))
        if not len(last) and not len(rare):
            continue
        size = length[words_[rare]]
        stops = np.cumsum(size)
        posting = np.arange(stops[-1] if len(stops) else 0) + np.repeat(start[words_[rare]] - (stops - size), size)
        score = np.bincount(row[posting], weight[posting] * np.repeat(gains[rare], size), n)
        kth = best[q].min()
        if not len(last):
            some = np.flatnonzero((score > 0) & (score >= kth - _EPS))
            score = score[some]
        else:
            if n > 4 * k:
                kth = max(kth, np.partition(score, n - k)[n - k])
            some = np.flatnonzero(score + float(gains[last] @ most[dense[last]]) >= kth - _EPS)
            if 4 * len(some) < n:
                score = score[some] + gains[last] @ held[dense[last][:, None], some]
            else:
                some, score = np.arange(n), score + gains[last] @ held[dense[last]]
            fit = np.flatnonzero((score > 0) & (score >= kth - _EPS))
            some, score = some[fit], score[fit]
        score = np.round(score, 9)
        if len(score) > k:
            fit = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            fit = fit[np.lexsort((by_id[some[fit]], -score[fit]))[:k]]
            some, score = some[fit], score[fit]
        if len(score):
            best[q] = np.sort(np.concatenate([best[q], score]))[-k:]
            out.append((np.full(len(some), q), some, score))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have about ``SMALL_STRIPE`` entries."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= SMALL_STRIPE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _found(docs: pa.Table, queries: _Queries, of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    query, at, score = of
    ids = docs.column("id").take(pa.array(at))
    return pa.table([pa.array(queries.qid[query], pa.int64()), pa.array(queries.variant[query], pa.int32()), ids, pa.array(score)], names=["qid", "variant", "id", "score"])


class Bm25:
    """The index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.docs, self.mean, self.entries = spark.read.parquet(f"{self.root}/stats").select("docs", "mean", "entries").first()
        self.documents, self.terms = (spark.read.parquet(f"{self.root}/{t}") for t in ("documents", "terms"))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(qid, variant, terms, gains) of the words of ``queries`` (qid, variant, text) that the index knows."""
        rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("variant").cast("int").alias("variant"), F.explode(_hashes(F.col("text"))).alias("term")).groupBy("qid", "variant", "term").agg(F.count("*").alias("n"))
        idf = F.log1p((self.docs - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
        each = rows.join(self.terms, "term").select("qid", "variant", F.struct("term", (F.col("n") * idf).alias("gain")).alias("one"))
        return each.groupBy("qid", "variant").agg(F.collect_list("one").alias("each")).select("qid", "variant", F.col("each.term").alias("terms"), F.col("each.gain").alias("gains"))

    def search(self, queries: DataFrame, k: int, frequent: float = FREQUENT) -> DataFrame:
        """(qid, variant, id, score, rank): the best ``k`` documents of every query, ties by id; scores to nine places.

        frequent: from this share of a tile's documents on, a word is looked up last. Up to
        ``SENT`` words of queries go to every task that reads documents, more are dealt
        with the documents in tiles.
        """
        asked = written(self.asked(queries))
        entries = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        found = self._sent(asked, k, frequent) if entries <= SENT else self._dealt(asked, entries, k, frequent)
        return ranked(found, k)

    def _schema(self) -> str:
        return f"qid long, variant int, id {self.documents.schema['id'].dataType.simpleString()}, score double"

    def _sent(self, asked: DataFrame, k: int, frequent: float) -> DataFrame:
        shared, mean = self.spark.sparkContext.broadcast(asked.toArrow()), self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = _Queries(shared.value)
            best = queries.best(k)
            for batch in _gathered(batches):
                yield from _found(batch, queries, _scored(batch, queries, best, mean, k, frequent)).to_batches()

        return self.documents.mapInArrow(run, self._schema())

    def _dealt(self, asked: DataFrame, entries: int, k: int, frequent: float) -> DataFrame:
        """Tiles of stripes of documents times groups of queries."""
        mean, groups = self.mean, -(-entries // ASKED)
        stripes = max(-(-self.entries // STRIPE), min(4 * self.spark.sparkContext.defaultParallelism, -(-self.entries // SMALL_STRIPE)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
        left = self.documents.withColumn("stripe", dealt(stripes, "id")).select("*", every(groups).alias("part"))
        right = asked.withColumn("part", dealt(groups, "qid", "variant")).select("*", every(stripes).alias("stripe"))

        def run(docs: pa.Table, some: pa.Table) -> pa.Table:
            queries = _Queries(some)
            return _found(docs, queries, _scored(docs, queries, queries.best(k), mean, k, frequent))

        return left.groupBy("stripe", "part").cogroup(right.groupBy("stripe", "part")).applyInArrow(run, self._schema())
