"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in an order shuffled by a keyed hash, are a stream of words
that may be read twice. Slot k of the mix takes the golden-ratio point frac(k * phi), maps
it through the cumulative targets of the sources, and gets the next unread block of the
source it falls on: any stretch of the mix holds the sources close to their shares. The
target of a source, in whole words, is cut into as many blocks as it has slots, of equally
many words but one; a source that no point falls on is one block, beside that of another
source. So all of every target is taken at every size. A slot's rank within its source is the number of
its block; both ranks and stream positions come from sums over ranges that are dealt to
many tasks, so a source with most of the rows is no task's business.

Null texts have size 0; such documents are never taken. A null source is a source of its
own, last in order. Repeated rows are documents of their own. Same input, same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import with_columns
from .common import cut, own_name, slices, spans_of_words, strings

#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input, and how often a document may be read.
SHARE, EPOCHS = 1.5, 2
#: Sources that the driver weighs; more are an error.
MAX_SOURCES = 200_000
#: Slots of a mix, at least, unless blocks would have less than a word; and words of a block at most.
SLOTS, MOST_WORDS = 1 << 18, 1 << 20
#: Slots ranked, and rows of a stream summed, in one range.
RANGE = 1 << 16
#: 2**64 / golden ratio, odd.
_PHI = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the number of words of ``text``."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [np.diff(spans_of_words(raw, offsets)[2]) for _, raw, offsets in slices(strings(batch.column(text)))]
        return {out: pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())}

    return with_columns(docs, make, f"`{out}` long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = EPOCHS) -> list[float]:
    """Words wanted of each source: ``share`` of all by weight, at most ``most`` times its size.

    What a full source leaves is shared again by weight until none is above.
    """
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in sorted(open_) if left * weights[k] / weight > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = float(most * sizes[k])
            open_.remove(k)
        left = total - sum(out[k] for k in range(len(sizes)) if k not in open_)
    return out


def _weighed(sized: DataFrame) -> list[dict]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.size for r in rows], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))])
    return [{"sid": k, "source": r.source, "source_size": r.size, "target": t} for k, (r, t) in enumerate(zip(rows, wanted, strict=True))]


def _slots(spark, sources: list[dict], block: int) -> tuple[DataFrame, list[int]]:
    """((slot, sid, block): the schedule; how many slots each source has). A source's blocks are numbered in slot order."""
    ends = np.cumsum([s["target"] for s in sources])
    n = int(ends[-1] // block) + 1 if len(ends) and ends[-1] > 0 else 0
    ends = ends / ends[-1] if n else ends

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = (slot.astype(np.uint64) * np.uint64(_PHI) >> np.uint64(11)).astype(np.float64) / 2**53
            sid = np.minimum(np.searchsorted(ends, point, "right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid.astype(np.int64)), pa.array(slot // RANGE)], names=["slot", "sid", "part"])

    placed = cut(spark.range(n).mapInArrow(place, "slot long, sid long, part long"))
    counts = [0] * len(sources)
    for r in placed.groupBy("sid").count().collect():
        counts[r.sid] = r["count"]
    missed = [k for k, s in enumerate(sources) if s["target"] > 0 and not counts[k]]
    if missed:  # their places are spread by the golden ratio, too
        at = [((j + 1) * _PHI % 2**64) * n >> 64 for j in range(len(missed))]
        placed = placed.unionByName(spark.createDataFrame([(a, k, a // RANGE) for a, k in zip(at, missed, strict=True)], "slot long, sid long, part long"))
        for k in missed:
            counts[k] = 1
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("sid", "part").count().select("sid", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1
    return placed.withColumn("rank", rank).join(base, ["sid", "part"]).select("slot", "sid", (F.col("base") + F.col("rank")).alias("block")), counts


def _streams(sized: DataFrame, order: list, rows: int) -> DataFrame:
    """``sized`` with the position ``start`` of each row in its source's shuffled stream."""
    ranges = max(1, rows // RANGE) * 4
    dealt = sized.withColumn("hash", F.xxhash64(*order)).withColumn("part", F.shiftrightunsigned("hash", 33) * ranges / F.lit(2**31)).withColumn("part", F.floor("part"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("sid", "part").agg(F.sum("size").alias("words")).select("sid", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("hash", *order, "size").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["sid", "part"]).withColumn("start", F.col("base") + F.col("inside")).drop("hash", "part", "base", "inside")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).

    documents: a row for each row of ``docs`` with ``key``, ``source``, ``size``,
    ``source_size``, ``target``, ``sid`` and ``start`` (its place in the stream).
    schedule: (slot, sid, start, epoch, first, words, key): slot by slot the words of
    documents that the mix takes, ``first`` being the number of the first word. A slot may
    hold blocks of several sources.
    """
    spark = docs.sparkSession
    sized = cut(word_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "text", "size").drop("text"))
    sources = _weighed(sized)
    total = sum(s["target"] for s in sources)
    slots, counts = _slots(spark, sources, int(min(MOST_WORDS, max(1, total // SLOTS))))
    for s, n in zip(sources, counts, strict=True):  # the first ``longer`` blocks have a word more than ``block_words``
        s["wanted"] = max(1, round(s["target"])) if s["target"] > 0 else 0
        s["block_words"], s["longer"] = divmod(s["wanted"], max(1, min(n, s["wanted"])))
    schema = "sid long, source string, source_size long, target double, wanted long, block_words long, longer long"
    named = spark.createDataFrame([tuple(s.values()) for s in sources], schema)
    named = F.broadcast(named) if len(sources) <= 10_000 else named
    cuts = ["wanted", "block_words", "longer"]
    known = sized.join(named, sized.source.eqNullSafe(named.source)).select("key", sized.source, "size", "source_size", "target", "sid", *cuts)
    placed = cut(_streams(known, ["key"], sized.count()))
    rows = placed.drop(*cuts)
    epochs = placed.where("size > 0").select("sid", "key", "start", "size", *cuts, F.explode(F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at")))).alias("e")).select("sid", "key", "start", "size", *cuts, "e.*")
    epochs = epochs.where("at < wanted").withColumn("end", F.least(F.col("at") + F.col("size"), "wanted"))
    edge = "longer * (block_words + 1)"
    of = f"if({{0}} < {edge}, {{0}} div (block_words + 1), longer + ({{0}} - {edge}) div block_words)"
    blocks = epochs.withColumn("block", F.explode(F.sequence(F.expr(of.format("at")), F.expr(of.format("(end - 1)")))))
    begin = F.col("block") * F.col("block_words") + F.least("block", "longer")
    low, high = F.greatest("at", begin), F.least("end", begin + F.col("block_words") + (F.col("block") < F.col("longer")).cast("long"))
    pieces = blocks.select("sid", "block", "key", "start", "epoch", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    schedule = pieces.join(slots, ["sid", "block"]).select("slot", "sid", "start", "epoch", "first", "words", "key")
    return rows, schedule


def taken(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """``rows`` with the words that the mix takes of each, repeats counted."""
    sums = schedule.groupBy("sid", "start").agg(F.sum("words").alias("words"))
    # Rows of size 0 share their place with the row after them.
    return rows.join(sums, ["sid", "start"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("words")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken."""
    return taken(*mix(docs)).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix reads, each as often as at least half of its words are taken.

    Of rows equal in key, text and source, those that differ elsewhere are ordered by a
    hash of all columns. A row whose words are taken once and a half stands there twice. Documents without
    words are not in the mix.
    """
    mark = own_name(docs, "mark")
    keyed = docs.withColumn(mark, F.xxhash64(key, text, source))
    rows, schedule = mix(keyed.select(mark, text, source), mark, text, source)
    # Rows with one mark are copies: their times are dealt out evenly, the rest to the first.
    times = taken(rows, schedule).where("size > 0").groupBy(F.col("key").alias(mark)).agg(F.sum(F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).cast("long").alias("mix_times"), F.count("*").alias("mix_copies")).where("mix_times > 0")
    repeat, copies, rank = (own_name(docs, c) for c in ("mix_times", "mix_copies", "mix_rank"))
    met = keyed.join(times.withColumnsRenamed({"mix_times": repeat, "mix_copies": copies}), mark)
    hashable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = F.row_number().over(Window.partitionBy(mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashable])))
    several = met.where(F.col(copies) > 1).withColumn(rank, first)
    several = several.withColumn(repeat, F.expr(f"`{repeat}` div `{copies}` + int(`{rank}` <= `{repeat}` % `{copies}`)")).drop(rank)
    every = met.where(F.col(copies) == 1).unionByName(several).where(F.col(repeat) > 0)
    return every.withColumn(rank, F.explode(F.sequence(F.lit(1).cast("long"), F.col(repeat)))).select(*docs.columns)
