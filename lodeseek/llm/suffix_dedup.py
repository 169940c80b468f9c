"""Removal of byte strings that occur more than once in a corpus, by longest previous factors.

Every ``length``-byte string contains a least k-gram (k half of ``length``, by hash,
leftmost in ties), its anchor. Starts whose strings have the same anchor are
consecutive and make a span; equal strings have equal anchors at equal distances. So:

1. Spans are counted by the k-gram at their anchor. Alone there, none of their strings
   occurs twice. If all spans there have equal bytes, all their strings do.
2. The distinct spans of the other anchors are dealt to buckets. A bucket concatenates
   its spans in corpus order, sorts its suffixes by prefix doubling up to ``length``
   bytes, and takes from the previous and next smaller positions in that order each
   suffix's longest previous factor (and, by the larger positions, its longest next one).
   Where a factor has ``length`` bytes, the string occurs earlier (later).
3. Anchors with more than ``HOT`` distinct spans would make a bucket grow with the
   corpus. Their spans are split into pieces of ``BLOCK`` starts by the distance to the
   anchor, and the pieces dealt to buckets by a hash of the bytes common to all their
   strings: equal strings still meet. Alone in its bucket, a piece has no repeats. A
   bucket with more than ``HOT`` distinct pieces is split once more, into single starts:
   all its strings are equal then, and an aggregate that combines before it shuffles
   takes the place of the order.

Matches do not cross rows. Null texts are empty; texts shorter than ``length`` stay
whole. Repeated rows are copies of each other; order is by key, nulls first, then by a
hash of key and text. Rows equal in both stand at one place: keeping the first keeps both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, with_columns
from .common import SLICE_BYTES, cut, flat, prefix_sums, slices, span_hashes, strings

#: Distinct spans of one anchor, and pieces of a bucket, beyond which they are split.
HOT = 1000
#: Starts in a piece of such a span.
BLOCK = 32
#: Spans that a bucket gets on average (of pieces, which are shorter, four times as many).
BUCKET = 1500
_PLACE = np.uint64(2 * SLICE_BYTES - 1)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, bytes, offsets): long rows come in overlapping parts."""
    for row, raw, offsets in slices(column):
        if len(raw) <= SLICE_BYTES + length:
            yield row, 0, raw, offsets
            continue
        for at in range(0, len(raw) - length + 1, SLICE_BYTES):
            part = raw[at : at + SLICE_BYTES + length - 1]
            yield row, at, part, np.array([0, len(part)])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _spans_of(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first start, starts, anchor hash, hash of the span's bytes) of all spans."""
    k = length // 2
    if len(raw) < length:
        return None
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - k + 1)
    grams = span_hashes(sums, at, at + k)
    least = _window_minima((grams & ~_PLACE) | at.astype(np.uint64), length - k + 1)
    anchor = (least & _PLACE).astype(np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= length)
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[offsets[long_enough]] += 1
    edges[offsets[long_enough + 1] - length + 1] -= 1
    valid = np.cumsum(edges[: len(anchor)], dtype=np.int8).astype(bool)
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return None
    stop = np.append(np.flatnonzero(change | ~valid), len(anchor))
    count = stop[np.searchsorted(stop, first, "right")] - first
    row = np.searchsorted(offsets, first, "right") - 1
    gap = anchor[first] - first
    body = span_hashes(sums, first, first + count + length - 1) ^ (gap.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row, first, count, gap, grams[anchor[first]], body


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """One row a span: key, mark, gram, body, lo (byte offset of its first start), n (starts), gap (to the anchor)."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, shift, raw, offsets in _pieces(strings(batch.column(2)), length):
                found = _spans_of(raw, offsets, length)
                if found is None:
                    continue
                row, first, count, gap, gram, body = found
                rows = pa.array(row + base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(x) for x in (gram.view(np.int64), body.view(np.int64), first - offsets[row] + shift, count.astype(np.int32), gap.astype(np.int32))]],
                    names=["key", "mark", "gram", "body", "lo", "n", "gap"],
                )

    return docs.select("key", "mark", "text").mapInArrow(run, f"key {kind}, mark long, gram long, body long, lo long, n int, gap int")


def _with_bytes(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """``spans`` (key, mark, lo, n and more) with their bytes, by a join with the texts."""
    rest = [c for c in spans.columns if c not in ("key", "mark")]
    lists = spans.groupBy("key", "mark").agg(F.collect_list(F.struct(*rest)).alias("spans"))
    found = docs.join(lists, docs.key.eqNullSafe(lists.key) & (docs.mark == lists.mark)).select(docs.key, docs.mark, "text", "spans")
    kind = {f.name: f.dataType.simpleString() for f in spans.schema}
    outputs = ", ".join(f"`{c}` {kind[c]}" for c in ("key", "mark", *rest)) + ", bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(strings(batch.column(2)))
            lists = batch.column(3)
            flat_spans = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            lo, n = (flat_spans.field(c).to_numpy().astype(np.int64) for c in ("lo", "n"))
            begin = offsets[of] + lo
            data = [raw[a : a + m + length - 1].tobytes() for a, m in zip(begin.tolist(), n.tolist(), strict=True)]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[flat_spans.field(c) for c in rest], pa.array(data, pa.binary())], names=["key", "mark", *rest, "bytes"])

    return found.mapInArrow(run, outputs)


def suffix_ranks(raw: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(reach, ranks of all suffixes by their first ``reach`` bytes), for reaches up to ``length``, by prefix doubling.

    Beyond the end stand zeros.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)])
    rank = np.zeros(n, np.uint64)
    reach = min(8, length)
    for k in range(reach):
        rank = rank << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    levels = [(reach, rank.astype(np.int32))]
    while reach < length:
        step = min(reach, length - reach)
        later = np.zeros(n, np.uint64)
        later[: n - step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank * np.uint64(n + 1) + later, return_inverse=True)[1].astype(np.uint64)
        reach += step
        levels.append((reach, rank.astype(np.int32)))
    return levels


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it, -1 where there is none."""
    near = np.arange(-1, len(values) - 1)
    left = np.flatnonzero(near >= 0)
    while len(left := left[values[near[left]] > values[left]]):
        near[left] = near[near[left]]  # all that lies between is larger still
        left = left[near[left] >= 0]
    return near


def _common(raw: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes, of the largest reach at most, the suffixes at ``i`` and ``j`` share; 0 where ``j`` is negative."""
    length, last = levels[-1]
    whole = (j >= 0) & (last[i] == last[j])
    out = np.where(whole, length, 0)
    some = np.flatnonzero((j >= 0) & ~whole)
    i, j, n = i[some], j[some], len(raw)
    common = np.zeros(len(some), np.int64)
    steps = [(reach, rank) for reach, rank in levels[:-1]][::-1] + [(1, raw)] * min(7, length - 1)
    for reach, rank in steps:
        a, b = i + common, j + common
        same = (a < n) & (b < n)
        same[same] = rank[a[same]] == rank[b[same]]
        common += reach * same
    out[some] = np.minimum(common, length - 1)
    return out


def factors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the longest previous and the longest next factors of the suffixes at ascending positions ``at``.

    Lengths end at ``length``. Of the suffixes that start earlier, one of those next to it
    in suffix order shares most with a suffix: its previous or next smaller position.
    Ties in the order of the first ``length`` bytes are in order of position.
    """
    levels = suffix_ranks(raw, length)
    order = np.argsort(levels[-1][1][at], kind="stable")
    place = at[order]
    out = []
    for value in (place, -place):
        near = []
        before = nearest_smaller(value)
        after = len(value) - 1 - nearest_smaller(value[::-1])[::-1]
        for side in (before, after):
            there = (side >= 0) & (side < len(value))
            near.append(_common(raw, levels, place, np.where(there, place[np.where(there, side, 0)], -1)))
        lengths = np.zeros(len(at), np.int64)
        lengths[order] = np.maximum(*near)
        out.append(lengths)
    return out[0], out[1]


def _runs(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices and lengths of runs of set flags at consecutive places of one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at)))


def _by_suffixes(spans: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Ranges (gram, body, skip, n) of starts that occur elsewhere in their bucket.

    spans: bucket, gram, body, base (starts of the span before these), key, mark, lo, n, bytes.
    """

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(parts))
        got = got.take(pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("key", "mark", "lo")], null_placement="at_start"))
        twice = np.zeros(len(got), bool)  # a repeated row brings its spans again
        gram, body, base = (got.column(c).to_numpy() for c in ("gram", "body", "base"))
        twice[1:] = (gram[1:] == gram[:-1]) & (body[1:] == body[:-1]) & (base[1:] == base[:-1])
        got = got.filter(pa.array(~twice))
        n = got.column("n").to_numpy().astype(np.int64)
        raw, offsets = flat(got.column("bytes").combine_chunks().cast(pa.large_binary()))
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        previous, following = factors(raw, offsets[owner] + place, length)
        first, size = _runs((previous if keep_first else np.maximum(previous, following)) >= length, owner, place)
        rows = pa.array(owner[first])
        some = got.take(rows).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[some.column(c).combine_chunks() for c in ("gram", "body")], pa.array(place[first] + some.column("base").to_numpy()), pa.array(size)], names=["gram", "body", "skip", "n"])

    return spans.groupBy("bucket").applyInArrow(run, "gram long, body long, skip long, n long")


def _block(length: int) -> int:
    return max(1, min(BLOCK, length // 4))


def _blocks(spans: DataFrame, length: int) -> DataFrame:
    """Blocks of starts by distance to the anchor, with a hash of what all strings of a block share."""

    wide = _block(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("gram", "body", "skip", "n", "gap", "core")}
            col = {c: batch.column(c).to_pylist() for c in ("gram", "body", "n", "gap", "bytes")}
            for gram, body, n, gap, data in zip(*col.values(), strict=True):
                sums = prefix_sums(np.frombuffer(data, np.uint8))
                start = np.arange(n)
                block = (gap - start) // wide  # falls as starts go on
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                stop = np.append(first[1:], n)
                last = gap - block[first] * wide
                core = span_hashes(sums, np.minimum(last, len(data)), np.minimum(last - wide + 1 + length, len(data)))
                for x, v in zip(out.values(), ([gram] * len(first), [body] * len(first), first, stop - first, gap - first, core.view(np.int64)), strict=True):
                    x.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return spans.select("gram", "body", "n", "gap", "bytes").mapInArrow(run, "gram long, body long, skip long, n long, gap long, core long")


def _starts(blocks: DataFrame, length: int) -> DataFrame:
    """One row a start of each block, with a 128-bit hash of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, body, skip, n, data, key, mark, lo in zip(*[batch.column(c).to_pylist() for c in ("gram", "body", "skip", "n", "bytes", "key", "mark", "lo")], strict=True):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(skip, skip + n)
                one = span_hashes(prefix_sums(raw), at, at + length).view(np.int64)
                two = span_hashes(prefix_sums(raw[::-1]), len(raw) - at - length, len(raw) - at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n), pa.array([body] * n), pa.array(at), pa.array(one), pa.array(two), pa.array([key] * n, batch.column("key").type), pa.array([mark] * n), pa.array([lo] * n)], names=["gram", "body", "skip", "one", "two", "key", "mark", "lo"])

    kind = blocks.schema["key"].dataType.simpleString()
    return blocks.mapInArrow(run, f"gram long, body long, skip long, one long, two long, key {kind}, mark long, lo long")


def repeated_ranges(docs: DataFrame, key: str, text: str, length: int = 400, keep: str = "none") -> tuple[DataFrame, DataFrame]:
    """(docs with columns key, mark and text, ranges (key, mark, lo, n) of repeated starts)."""
    small_batches(docs)
    keep_first = keep == "first"
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.col(text).alias("text"))
    spans = cut(_spans(docs, length))
    grams = cut(spans.groupBy("gram").agg(F.count("*").alias("all"), F.min("body").alias("low"), F.max("body").alias("high")).where("all > 1"))
    met = cut(spans.join(grams.selectExpr("gram", "low <> high as differ"), "gram"))
    order = F.struct("key", "mark", "lo")
    bodies = cut(met.groupBy("gram", "body", "differ").agg(F.count("*").alias("copies"), F.min(F.struct("key", "mark", "lo", "n", "gap")).alias("first")))
    whole = met.join(bodies.where("copies > 1").select("gram", "body", "first"), ["gram", "body"])
    if keep_first:
        whole = whole.where(order > F.struct("first.key", "first.mark", "first.lo"))
    found = [whole.select("key", "mark", "lo", F.col("n").cast("long").alias("n"))]
    mixed = bodies.where("differ").select("gram", "body", "copies", "first.*")
    sizes = mixed.groupBy("gram").agg(F.count("*").alias("bodies"))
    texts = cut(_with_bytes(docs, mixed.join(sizes, "gram"), length))
    few, many = texts.where(F.col("bodies") <= HOT), texts.where(F.col("bodies") > HOT).dropDuplicates(["gram", "body"])
    of = ["gram", "body", "base", "key", "mark", "lo", "n", "bytes"]
    bucket = F.pmod(F.xxhash64("gram"), F.lit(max(1, few.count() // BUCKET)))
    dealt = few.withColumn("base", F.lit(0).cast("long")).select(bucket.alias("bucket"), *[F.col(c).cast("long") if c == "n" else F.col(c) for c in of])
    parts = []
    if many.limit(1).count():
        blocks = cut(_blocks(many, length).withColumn("block", F.expr(f"gap div {_block(length)}")))
        by = ["gram", "block", "core"]
        twice = blocks.select(*by, "body").distinct().groupBy(*by).agg(F.count("*").alias("k")).where("k > 1")
        left = cut(blocks.join(twice, by).select(*by, "k", "body", "skip", F.col("n").alias("m")))
        pieces = many.drop("n").join(left, ["gram", "body"]).withColumnRenamed("m", "n")
        small = pieces.where(F.col("k") <= HOT).select(F.xxhash64(*by).alias("bucket"), "gram", "body", F.col("skip").alias("base"), "key", "mark", (F.col("lo") + F.col("skip")).alias("lo"), "n", F.expr(f"substring(bytes, int(skip) + 1, int(n) + {length - 1})").alias("bytes"))
        dealt = dealt.unionByName(small.withColumn("bucket", F.pmod("bucket", F.lit(max(1, left.where(F.col("k") <= HOT).count() // (4 * BUCKET))))))
        starts = cut(_starts(pieces.where(F.col("k") > HOT).drop("k", "block", "core"), length))
        classes = starts.groupBy("one", "two").agg(F.count("*").alias("k"), F.min(F.struct("key", "mark", "lo", "skip")).alias("first")).where("k > 1")
        again = starts.join(classes, ["one", "two"])
        if keep_first:
            again = again.where(F.struct("key", "mark", "lo", "skip") > F.col("first"))
        parts.append(again.select("gram", "body", "skip", F.lit(1).cast("long").alias("n")))
    parts.append(_by_suffixes(dealt, length, keep_first))
    ranges = reduce(DataFrame.unionByName, parts)
    # A body's first copy stands for it; without keep_first, bodies with copies are whole already.
    firsts = mixed.select("gram", "body", "key", "mark", "lo")
    found.append(ranges.join(firsts, ["gram", "body"]).select("key", "mark", (F.col("lo") + F.col("skip")).alias("lo"), "n"))
    return docs, reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, keep: str = "none") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of each row.

    keep: "none" removes all bytes of every ``length``-byte string that starts anywhere
    else, "first" leaves those of its first start. ``kept`` holds the remaining bytes,
    which need not be valid UTF-8; ``n_spans`` counts maximal removed runs.
    """
    rows, ranges = repeated_ranges(docs, key, text, length, keep)
    lists = ranges.groupBy("key", "mark").agg(F.collect_set(F.struct("lo", "n")).alias("ranges"))  # a repeated row brings its ranges again
    met = rows.join(lists, rows.key.eqNullSafe(lists.key) & (rows.mark == lists.mark), "left").select(rows.key, "text", "ranges")

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw, offsets = flat(strings(batch.column("text")))
        lists = batch.column("ranges")
        each = lists.flatten()
        size = lists.value_lengths().fill_null(0).to_numpy()
        of = np.repeat(np.arange(len(lists)), size)
        lo, n = (each.field(c).to_numpy() for c in ("lo", "n"))
        edges = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edges, offsets[of] + lo, 1)
        np.add.at(edges, offsets[of] + lo + n + length - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(raw)]
        begins[edge] = gone[edge]
        runs = np.concatenate([[0], np.cumsum(begins)])
        left = raw[~gone]
        ends = offsets - before[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(left))]).cast(pa.binary())
        return {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(before[offsets])), "n_spans": pa.array(np.diff(runs[offsets])), "kept": kept}

    out = with_columns(met, make, "n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept")
