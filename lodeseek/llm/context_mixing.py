"""Language-model scores by logistic context mixing of hashed-context bit predictors.

A text is lower-cased (A-Z) and read as words, each ended by one space byte or by the end
of the text; words may be empty. A word is told by up to three bits, each asked only where
its answer is open: has it followed the word before it in training; if not, has it occurred
in this text; if not, in training. A yes leaves the word to its share of what was counted
there, and three times no leaves it to be spelled, with a stop, bit by bit. Which space
byte ends a word is predicted from its last byte. The probabilities of all texts sum to one
at most.

Every bit is predicted by mixing: predictors count zeros and ones in hashed contexts, their
stretched probabilities are mixed with weights that a gate picks, and a table of observed
frequencies refines the result. The contexts of the three bits are how often the word
before has been seen, which bits the last words of the text needed and how the text has
gone so far; those of spelled bits are the word's last one to four bytes, and all of it.
Weights and tables are learnt online in one pass over the training texts.

A training text is predicted from counts without the word at hand, so that it doesn't
count as a copy of itself; another copy does.

1. Slices of documents become their distinct words and the running text as indexes into
   them.
2. A slice asks ranges of hash values how often its words (64 bits) and its pairs of words
   (32 bits and more) occur in all training texts; ranges add up and answer. Nothing of
   this is broadcast, and it grows with the corpus.
3. Words that occur once in training stand for those that never do: spelling is learnt from
   them. Its tables follow their number up to 2**TABLE_BITS slots.
4. Weights are learnt by tasks side by side and averaged, and all slices are scored.

Null texts count as empty: one end token. A null key counts as the empty text for the
hold-out rule. Repeated rows are documents of their own. Without any training document
a word that the text has not had is spelled with even bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import small_batches
from .common import SPACES, cut, flat, lower, mixed, prefix_sums, release, slices, span_hashes, strings

#: Text bytes of a slice, and words of a range, on average.
SLICE, RANGE = 1 << 20, 1 << 20
#: Slots of the largest tables at most, as a power of two, and of those of the single predictors.
TABLE_BITS = 22
ORDERS = (1, 2, 3, 4, 0)
ORDER_BITS = (18, 20, 21, 21, 22)
#: Slots of a table in one row while it is summed.
CHUNK = 1 << 16
#: Tasks that build tables, each of which sends all of its own, and tasks that learn weights: so many at least, and one for so many rare words.
TABLE_TASKS, MODEL_TASKS, TASK_WORDS = 12, 64, 1 << 18
#: Symbols that are predicted at once.
STEP = 1 << 15
#: Learning rate; added to both counts of a context.
RATE, DELTA = 0.1, 0.05
GATES, BUCKETS = 4 * 4 * 8, 32
STOP = 0x20
#: Slices that a reader holds at once.
GROUP = 8
#: Hash of the empty word, and what stands for the word before the first one.
EMPTY, START = np.uint64(0), np.uint64(0x9FB21C651E98DF25)
#: The three bits before spelling: predictors, slots of their table as a power of two, gates.
CHOICES, CHOICE_BITS, CHOICE_GATES = 4, 18, 3 * 16 * 5
_MOST = 65_535
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOG = np.log(np.arange(_MOST + 2) + DELTA).astype(np.float32)
_SEEN = np.digitize(np.arange(_MOST + 2), [1, 3, 31]).astype(np.int8)
_KIND = np.zeros(256, np.int64)
_KIND[list(SPACES)] = np.arange(1, 7)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its key as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and the ends of the spans in them."""
    size = ends - starts
    stops = np.cumsum(size)
    total = int(stops[-1]) if len(stops) else 0
    return raw[np.arange(total) + np.repeat(starts - (stops - size), size)], stops


def _pack(data: bytes) -> bytes:
    """The size and the compressed bytes; Spark's own compression codes no bytes by how often they occur."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Packed byte planes of an array, which compress better than the values."""
    x = np.ascontiguousarray(x.astype(kind))
    return _pack(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def _values(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray, kind: str) -> bytes:
    """Packed byte planes of the steps between ascending keys."""
    return _planes(np.diff(keys.astype(kind), prepend=np.zeros(1, kind)), kind)


def _sums(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_values(data, kind), dtype=kind)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Starts, ends, delimiters (0: end of text) and rows of all words, empty ones included."""
    spaces = np.flatnonzero(_IS_SPACE[raw])
    at = np.concatenate([spaces, offsets[1:]])
    is_end = np.zeros(len(at), bool)
    is_end[len(spaces) :] = True
    row = np.concatenate([np.searchsorted(offsets, spaces, "right") - 1, np.arange(len(offsets) - 1)])
    order = np.lexsort((at, row))
    at, is_end, row = at[order], is_end[order], row[order]
    starts = np.concatenate([[0], at[:-1] + ~is_end[:-1]]) if len(at) else at
    mark = np.where(is_end, 0, raw[np.minimum(at, max(0, len(raw) - 1))]) if len(raw) else np.zeros(len(at), np.uint8)
    return starts, at, mark.astype(np.uint8), row


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have about ``SLICE`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.get_total_buffer_size()
        if size >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sliced(docs: DataFrame) -> DataFrame:
    """One row a slice: its documents' key, held_out, n_bytes and lengths (in words), its distinct words, and the text as indexes."""
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"slice long, key array<{kind}>, held_out array<boolean>, n_bytes array<long>, lengths binary, words binary, sizes binary, text binary, marks binary, total long, pieces long, n long, ends long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in _gathered(batches):
            for first, raw, offsets in slices(strings(batch.column(1)), SLICE):
                raw, rows = lower(raw), len(offsets) - 1
                train = ~batch.column(2).slice(first, rows).to_numpy().astype(bool)
                starts, ends, mark, row = _words(raw, offsets)
                hashes = np.zeros(len(starts), np.uint64)
                for a in range(0, len(starts), 1 << 17):  # sums over short stretches
                    b = min(len(starts), a + (1 << 17))
                    low = int(starts[a])
                    hashes[a:b] = span_hashes(prefix_sums(raw[low : int(ends[b - 1])]), starts[a:b] - low, ends[a:b] - low)
                _, at, of, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")  # frequent words have small indexes
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                at, of = at[order], rank[of]
                data, _ = _gather(raw, starts[at], ends[at])
                learnt = train[row]
                lengths, real = np.bincount(row, minlength=rows), int((learnt & (ends > starts)).sum())
                one = [number, _planes(lengths), _pack(data.tobytes()), _planes(ends[at] - starts[at]), _planes(of), _pack(mark.tobytes()), len(mark), int(learnt.sum()), real, int(train.sum())]
                per_row = lambda x: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), x)
                keys = batch.column(0).slice(first, rows).combine_chunks()
                cols = [per_row(keys), per_row(pa.array(~train)), per_row(pa.array(np.diff(offsets)))]
                cells = [pa.array([x]) for x in one]
                yield pa.RecordBatch.from_arrays([cells[0], *cols, *cells[1:]], names=[f.split()[0] for f in schema.split(", ")])
                number += 1

    return docs.select("key", "text", "held_out").mapInArrow(run, schema)


def _running(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, whether learnt from, text as indexes, hashes of the distinct words, of each word with the one before)."""
    lengths, text, sizes = (_values(row[c]).astype(np.int64) for c in ("lengths", "text", "sizes"))
    learnt = np.repeat(~np.array(row["held_out"], bool), lengths)
    raw, ends = np.frombuffer(_unpack(row["words"]), np.uint8), np.cumsum(sizes)
    hashes = np.zeros(len(sizes), np.uint64)
    for a in range(0, len(sizes), 1 << 17):
        b = min(len(sizes), a + (1 << 17))
        low = int(ends[a] - sizes[a])
        hashes[a:b] = span_hashes(prefix_sums(raw[low : int(ends[b - 1])]), ends[a:b] - sizes[a:b] - low, ends[a:b] - low)
    own = hashes[text]
    before = np.roll(own, 1)
    before[_starts(lengths)] = START
    return lengths, learnt, text, hashes, mixed(before * np.uint64(0x2545F4914F6CDD1D) + own)


def _told(sliced: DataFrame, bits: int) -> DataFrame:
    """(slice, part, words, pairs, known): for a range of a slice's words and pairs, in order of hashes, how often training has them.

    known: how many different words of the range training has, in one row a range (the others: 0).
    """
    names = ["slice", "part", "words", "word_times", "pairs", "pair_times"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("slice", "held_out", "lengths", "words", "sizes", "text")}
                _, learnt, text, hashes, pairs = _running(row)
                both, of = np.unique(pairs >> np.uint64(32 - bits), return_inverse=True)
                order = np.argsort(hashes)
                times = [np.bincount(text, learnt, len(hashes))[order], np.bincount(of, learnt, len(both))]
                hashes = hashes[order]
                parts = [((hashes >> np.uint64(33)) >> np.uint64(31 - bits)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)]
                there = np.union1d(*parts)
                cuts = [list(zip(np.searchsorted(p, there).tolist(), np.searchsorted(p, there, "right").tolist(), strict=True)) for p in parts]
                cols = [[_steps(hashes[a:b], "<u8") for a, b in cuts[0]], [_planes(times[0][a:b]) for a, b in cuts[0]], [_steps(both[a:b], "<u4") for a, b in cuts[1]], [_planes(times[1][a:b]) for a, b in cuts[1]]]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(there), pa.int64()), pa.array(there, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=names)

    def add(lows: list[np.ndarray], times: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        keys, of = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(of, np.concatenate(times), len(keys))
        ends = np.cumsum([len(x) for x in lows]).tolist()
        return [_planes(total[of[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], keys, total

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        of = lambda read, c, kind: [read(x.as_py(), kind) for x in got.column(c)]
        words, keys, total = add(of(_sums, "words", "<u8"), of(_values, "word_times", "<u4"))
        pairs, _, _ = add(of(_sums, "pairs", "<u4"), of(_values, "pair_times", "<u4"))
        known = np.zeros(got.num_rows, np.int64)
        known[0] = ((total > 0) & (keys != EMPTY)).sum()
        yield pa.RecordBatch.from_arrays([*[got.column(c).combine_chunks() for c in ("slice", "part")], pa.array(words, pa.binary()), pa.array(pairs, pa.binary()), pa.array(known)], names=["slice", "part", "words", "pairs", "known"])

    questions = sliced.mapInArrow(ask, "slice long, part int, words binary, word_times binary, pairs binary, pair_times binary")
    return questions.groupBy("part").applyInArrow(answer, "slice long, part int, words binary, pairs binary, known long")


def _counted(sliced: DataFrame, told: DataFrame, bits: int) -> DataFrame:
    """Slices with the answers: words by falling count, counts of words and of pairs in the text, and the words to be spelled.

    Only words that training has once at most are spelled. once: which of them this
    slice's training texts hold; empty: the index of the empty word, or -1.
    """
    kind = sliced.schema["key"].dataType.simpleString()
    names = ["key", "held_out", "n_bytes", "lengths", "text", "marks", "last", "counts", "pairs", "spelled", "sizes", "once", "rare", "empty"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        lengths, learnt, text, hashes, pairs = _running(row)
        right = right.sort_by("part")
        count, often = (np.concatenate([_values(x.as_py()) for x in right.column(c)]).astype(np.int64) for c in ("words", "pairs"))
        count[np.argsort(hashes)] = count.copy()  # answers come in order of hashes
        _, of = np.unique(pairs >> np.uint64(32 - bits), return_inverse=True)
        own = np.bincount(text, learnt, len(hashes))
        sizes, raw = _values(row["sizes"]).astype(np.int64), np.frombuffer(_unpack(row["words"]), np.uint8)
        ends = np.cumsum(sizes)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        last = np.where(sizes > 0, raw[np.maximum(0, ends - 1)], 0) if len(raw) else np.zeros(len(sizes), np.uint8)
        rare = order[count[order] <= 1]
        data, _ = _gather(raw, (ends - sizes)[rare], ends[rare])
        none = np.flatnonzero(sizes == 0)
        cells = [_planes(lengths), _planes(rank[text]), row["marks"], _pack(last[order].astype(np.uint8).tobytes()), _planes(count[order]), _planes(often[of]), _pack(data.tobytes()), _planes(sizes[rare]), _pack(((count[rare] == 1) & (own[rare] == 1)).tobytes()), len(rare), int(rank[none[0]]) if len(none) else -1]
        return pa.table([*[left.column(c) for c in names[:3]], *[pa.array([x]) for x in cells]], names=names)

    schema = f"key {kind}, held_out array<boolean>, n_bytes array<long>, lengths binary, text binary, marks binary, last binary, counts binary, pairs binary, spelled binary, sizes binary, once binary, rare long, empty long"
    return sliced.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, schema)


@dataclass
class Totals:
    """What training holds: words with empty ones, documents, and for the base score words, ends and distinct words."""

    pieces: int
    docs: int
    n: int
    v: int


def _size_class(x: np.ndarray) -> np.ndarray:
    """0, 1, 2-3, 4-7 and so on, up to class 15."""
    return np.minimum(15, np.ceil(np.log2(np.maximum(x, 0) + 1))).astype(np.int64)


def _choices(row: dict, totals: Totals, shares: bool = True) -> dict:
    """The words of a slice's texts: where they start, how they are told (level 0 to 2, 3: spelled), the share there if asked for, and contexts of the bits."""
    lengths, text = _values(row["lengths"]).astype(np.int64), _values(row["text"]).astype(np.int64)
    count, pair = _values(row["counts"]).astype(np.int64), _values(row["pairs"]).astype(np.int64)
    doc, starts = np.repeat(np.arange(len(lengths)), lengths), _starts(lengths)
    learnt = (~np.array(row["held_out"], bool))[doc].astype(np.int64)
    place = np.arange(len(text)) - starts[doc]
    own, pair = np.maximum(0, count[text] - learnt), np.maximum(0, pair - learnt)
    shift = lambda x, fill: np.where(place > 0, np.roll(x, 1), fill)
    before = np.maximum(0, shift(count[text], totals.docs) - learnt)
    order = np.argsort(doc * len(count) + text, kind="stable")
    same = (doc * len(count) + text)[order]
    run_start = np.maximum.accumulate(np.where(np.diff(same, prepend=-1) != 0, np.arange(len(same)), 0))
    earlier = np.empty(len(text), np.int64)
    earlier[order] = np.arange(len(same)) - run_start

    def so_far(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x) - x
        return total - total[starts][doc]

    asked, said = np.zeros((3, len(text)), bool), np.zeros((3, len(text)), bool)
    asked[0] = before > 0
    said[0] = asked[0] & (pair > 0)
    asked[1] = ~said[0] & (place > 0)
    said[1] = asked[1] & (earlier > 0)
    asked[2] = ~said[0] & ~said[1] & (totals.pieces - learnt > 0)
    said[2] = asked[2] & (own > 0)
    level = np.where(said.any(0), said.argmax(0), 3)
    inside = None
    if shares:
        share = own / np.maximum(1, totals.pieces - learnt)
        taken = np.minimum(so_far(np.where(earlier == 0, share, 0.0)), 0.999)
        inside = np.choose(level, [np.minimum(1, pair / np.maximum(1, before)), earlier / np.maximum(1, place), np.minimum(1, share / (1 - taken)), 1.0])
    past = [shift(level, 4)]
    for _ in range(2):
        past.append(shift(past[-1], 4))
    size = _size_class(before)
    went = so_far(said[0].astype(np.int64)) * 8 // np.maximum(1, place)
    contexts = [
        ((size * 5 + past[0]) * 5 + past[1]) * 5 + past[2],
        np.where(before >= 32, before, size * 5 + past[0]),  # a frequent word is told by its count
        went * 16 + _size_class(place),
        (size * 16 + shift(_size_class(pair), 0)) * 5 + past[0],
    ]
    gate = (size * 5 + past[0]).astype(np.int64)
    return {"doc": doc, "text": text, "order": order, "count": count, "own": own, "learnt": learnt, "level": level, "inside": inside, "asked": asked, "said": said, "contexts": np.array(contexts, np.uint64), "gate": gate}


def _choice_bits(told: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, slots by predictor, gates, values) of about ``STEP`` bits at once."""
    for n in range(3):
        every = np.flatnonzero(told["asked"][n])
        for a in range(0, len(every), STEP):
            at = every[a : a + STEP]
            slots = [(mixed(told["contexts"][k][at] * np.uint64(16) + np.uint64(4 * k + n)) >> np.uint64(64 - CHOICE_BITS)).astype(np.int64) for k in range(CHOICES)]
            yield at, np.array(slots), n * 80 + told["gate"][at], told["said"][n][at].astype(np.int64)


def _stretched(table: np.ndarray, slots: np.ndarray, value: np.ndarray | int = 0, without: np.ndarray | int = 0) -> np.ndarray:
    """Inputs of the mixer from zeros and ones of each slot, without ``without`` occurrences of ``value``."""
    zeros = np.maximum(0, table[slots, 0] - without * (1 - value))
    ones = np.maximum(0, table[slots, 1] - without * value)
    return np.vstack([np.log(ones + 0.4) - np.log(zeros + 0.4), np.full((1, slots.shape[1]), 0.3)]).astype(np.float32)


def _spelled(row: dict) -> pa.Array:
    raw, sizes = _unpack(row["spelled"]), _values(row["sizes"]).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _once(row: dict) -> pa.Array:
    return _spelled(row).filter(pa.array(np.frombuffer(_unpack(row["once"]), bool)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _symbols(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about ``STEP`` symbols: (symbol, contexts by order, word). Each word is followed by its stop."""
    raw, offsets = flat(column.cast(pa.large_binary()))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets + np.arange(len(offsets)), offsets[at] + at + STEP, "right")) - 1)
        size = np.diff(offsets[at : end + 1]) + 1
        stops = np.cumsum(size)
        word = np.repeat(np.arange(end - at), size)
        symbol = np.full(int(stops[-1]), STOP, np.uint8)
        inside = np.ones(len(symbol), bool)
        inside[stops - 1] = False
        symbol[inside] = raw[offsets[at] : offsets[end]]
        place = np.arange(len(symbol)) - np.repeat(stops - size, size)
        contexts = np.zeros((len(ORDERS), len(symbol)), np.uint64)
        recent = np.zeros(len(symbol), np.uint64)
        for k in range(1, max(ORDERS) + 1):  # bytes before the word's start count as 0
            before = np.zeros(len(symbol), np.uint64)
            before[k:] = symbol[:-k]
            before[place < k] = 0
            recent |= (before + (place >= k)) << np.uint64(9 * (k - 1))
            contexts[ORDERS.index(k)] = mixed(recent + np.uint64(k << 40))
        sums = prefix_sums(symbol)
        begin = np.repeat(stops - size, size)
        contexts[ORDERS.index(0)] = span_hashes(sums, begin, begin + place) ^ np.uint64(0x5851F42D4C957F2D)
        yield symbol, contexts, word + at
        at = end


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    x = (context ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _bits(symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, node, value) of the bits of each symbol, the highest first."""
    wide = symbol.astype(np.uint64)
    for k in range(8):
        yield k, (np.uint64(1) << np.uint64(k)) | (wide >> np.uint64(8 - k)), (symbol >> (7 - k)) & 1


def _sizes(distinct: int) -> list[int]:
    """Bits of each predictor's table: eight slots for a word, within bounds."""
    wanted = max(14, math.ceil(math.log2(8 * distinct + 1)))
    return [min(wanted, TABLE_BITS, b) for b in ORDER_BITS]


def _shrunk(pairs: np.ndarray) -> np.ndarray:
    """Zeros and ones scaled down to ``_MOST`` at most, in proportion; what was seen stays seen."""
    scale = np.maximum(1, pairs.max(1, keepdims=True) / _MOST)
    return np.maximum(np.floor(pairs / scale), pairs > 0).astype(np.int64)


def _tables(counted: DataFrame, sizes: list[int], tasks: int) -> list[np.ndarray]:
    """Zeros and ones seen in each slot, in proportion: arrays of shape (slots, 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 << b, np.uint32) for b in sizes]
        for row in _rows(batches):
            for symbol, contexts, _ in _symbols(_once(row)):
                for _, node, value in _bits(symbol):
                    for k, b in enumerate(sizes):
                        np.add.at(total[k], _slots(contexts[k], node, b) * 2 + value, np.uint32(1))  # of the table's own kind: others are many times slower
        for k, t in enumerate(total):
            for n, chunk in enumerate(t.reshape(-1, min(len(t), CHUNK))):
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([zlib.compress(chunk.astype("<u4"), 1)], pa.binary())], names=["k", "n", "part"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts:
            for x in part.column("part"):
                total = total + np.frombuffer(zlib.decompress(x.as_buffer()), "<u4").astype(np.int64)
        small = _shrunk(total.reshape(-1, 2)).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([zlib.compress(small, 1)], pa.binary())], names=["k", "n", "part"])

    kinds = "k int, n int, part binary"
    out = [np.zeros(2 << b, np.uint16) for b in sizes]
    for r in counted.select("spelled", "sizes", "once").coalesce(tasks).mapInArrow(count, kinds).groupBy("k", "n").applyInArrow(add, kinds).toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.part), "<u2")
        out[r.k][r.n * len(part) : (r.n + 1) * len(part)] = part
    return [t.reshape(-1, 2) for t in out]


@dataclass
class Mixer:
    """The weights of each gate, and the ones and all seen at each bucket of each gate."""

    weights: np.ndarray
    ones: np.ndarray
    seen: np.ndarray
    squares: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        """Weights to start from: the whole word so far counts for more, the more it has been seen."""
        weights = np.zeros((4, GATES // 4, len(ORDERS) + 1))
        for level, (own, others) in enumerate(((0.0, 0.3), (0.5, 0.15), (0.8, 0.06), (0.95, 0.01))):
            weights[level, :, :-1] = others
            weights[level, :, ORDERS.index(0)] = own
        return cls.of(weights.reshape(GATES, -1))

    @classmethod
    def choices(cls) -> Mixer:
        """For the bits before spelling: all predictors count alike."""
        return cls.of(np.full((CHOICE_GATES, CHOICES + 1), 0.3))

    @classmethod
    def of(cls, weights: np.ndarray) -> Mixer:
        gates = len(weights)
        middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5) * 0.5))
        return cls(weights, np.tile(middle * 4, (gates, 1)), np.full((gates, BUCKETS), 4.0), np.full(weights.shape, 1e-3))

    def gained(self, start: Mixer) -> Iterator[tuple[int, np.ndarray]]:
        """(gate, row) of what can be added up over tasks: mass, weights times mass, outcomes."""
        mass = (self.seen - start.seen).sum(1)
        for g in np.flatnonzero(mass).tolist():
            yield g, np.concatenate([[mass[g]], self.weights[g] * mass[g], self.ones[g] - start.ones[g], self.seen[g] - start.seen[g]])

    def take(self, gate: int, row: np.ndarray) -> None:
        """The sum of such rows over all tasks, for a mixer that has learnt nothing."""
        w = self.weights.shape[1]
        self.weights[gate] = row[1 : 1 + w] / row[0]
        self.ones[gate] += row[1 + w : 1 + w + BUCKETS]
        self.seen[gate] += row[1 + w + BUCKETS :]

    def predict(self, zeros: list[np.ndarray], ones: list[np.ndarray], bit: int):
        """(inputs, gate, mixed, bucket, refined) from the counts of each predictor."""
        inputs = np.empty((len(ORDERS) + 1, len(zeros[0])), np.float32)
        for k, (z, o) in enumerate(zip(zeros, ones, strict=True)):
            inputs[k] = _LOG[o] - _LOG[z]
        inputs[-1] = 0.3
        level = [_SEEN[np.minimum(zeros[k] + ones[k], _MOST)] for k in (ORDERS.index(0), ORDERS.index(3))]
        gate = (level[0].astype(np.int64) * 4 + level[1]) * 8 + bit
        return inputs, gate, *self.mix(inputs, gate)

    def mix(self, inputs: np.ndarray, gate: np.ndarray):
        """(mixed, bucket, refined) of stretched probabilities."""
        weights = np.ascontiguousarray(self.weights.T.astype(np.float32))
        dot = inputs[0] * weights[0][gate]
        for k in range(1, len(inputs)):
            dot += inputs[k] * weights[k][gate]
        dot = np.clip(dot.astype(np.float64), -12, 12)
        p = 1 / (1 + np.exp(-dot))
        bucket = np.clip(((dot / 0.5) + BUCKETS / 2).astype(np.int64), 0, BUCKETS - 1)
        refined = (self.ones[gate, bucket] + 0.02) / (self.seen[gate, bucket] + 0.04)
        return p, bucket, np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)

    def learn(self, inputs: np.ndarray, gate: np.ndarray, p: np.ndarray, bucket: np.ndarray, value: np.ndarray, times: np.ndarray | None = None) -> None:
        """One step towards ``value``: the mean gradient of each gate, and the outcomes of its buckets; ``times``: how often each occurs."""
        gates = len(self.weights)
        total = np.bincount(gate, times, gates)
        error = value - p if times is None else (value - p) * times
        for k in range(len(inputs)):
            slope = np.bincount(gate, error * inputs[k], gates) / np.maximum(total, 1e-9)
            self.squares[:, k] += slope * slope
            self.weights[:, k] += RATE * slope / np.sqrt(self.squares[:, k])
        at = gate * BUCKETS + bucket
        self.ones += np.bincount(at, value if times is None else value * times, gates * BUCKETS).reshape(gates, BUCKETS)
        self.seen += np.bincount(at, times, gates * BUCKETS).reshape(gates, BUCKETS)


def _seen(tables: list[np.ndarray], contexts: np.ndarray, node: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    zeros, ones = [], []
    for k, t in enumerate(tables):
        found = t.view("<u4").ravel()[_slots(contexts[k], node, len(t).bit_length() - 1)].astype(np.int64)  # both counts at once
        zeros.append((found & 0xFFFF).astype(np.int32))
        ones.append((found >> 16).astype(np.int32))
    return zeros, ones


@dataclass
class Model:
    """All that is learnt but for the counts of words and pairs."""

    spelling: Mixer
    choices: Mixer
    table: np.ndarray
    tails: np.ndarray


#: Sums over tasks are told apart by kind: mixers by gate, the table of choices in chunks, the tails.
_SPELLING, _CHOICES, _TABLE, _TAILS = range(4)


def _tail_places(row: dict, told: dict) -> np.ndarray:
    """Last byte of each word (0 for the empty one) times 8 and the kind of what ends it (0: the text's end)."""
    return np.frombuffer(_unpack(row["last"]), np.uint8)[told["text"]].astype(np.int64) * 8 + _KIND[np.frombuffer(_unpack(row["marks"]), np.uint8)]


def _learn(counted: DataFrame, tables, totals: Totals, tasks: int) -> Model:
    """Each task's mixers over its slices, averaged by what the gates have seen, and the sums of its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, choices = Mixer.fresh(), Mixer.choices()
        table, tails = np.zeros((1 << CHOICE_BITS, 2)), np.zeros(256 * 8)
        for row in _rows(batches):
            for symbol, contexts, _ in _symbols(_once(row)):
                for bit, node, value in _bits(symbol):
                    zeros, ones = _seen(tables.value, contexts, node)
                    for z, o in zip(zeros, ones, strict=True):  # without the word itself, which every table has
                        np.subtract(z, 1 - value, out=z)
                        np.subtract(o, value, out=o)
                    inputs, gate, p, bucket, _ = spelling.predict(zeros, ones, bit)
                    spelling.learn(inputs, gate, p, bucket, value)
            told = _choices(row, totals)
            trained = told["learnt"] > 0
            told["asked"] &= trained
            tails += np.bincount(_tail_places(row, told)[trained], minlength=len(tails))
            for _, slots, gate, value in _choice_bits(told):
                inputs = _stretched(table, slots)
                p, bucket, _ = choices.mix(inputs, gate)
                choices.learn(inputs, gate, p, bucket, value)
                np.add.at(table.reshape(-1), (slots * 2 + value).ravel(), 1.0)
        out = [(_SPELLING, *x) for x in spelling.gained(Mixer.fresh())] + [(_CHOICES, *x) for x in choices.gained(Mixer.choices())]
        out += [(_TABLE, n, part) for n, part in enumerate(table.reshape(-1, CHUNK)) if part.any()] + [(_TAILS, 0, tails)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([zlib.compress(x[2].astype("<f8").tobytes(), 1) for x in out], pa.binary())], names=["kind", "n", "row"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts:
            for x in part.column("row"):
                total = total + np.frombuffer(zlib.decompress(x.as_buffer()), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["kind", "n", "row"])

    model = Model(Mixer.fresh(), Mixer.choices(), np.zeros((1 << CHOICE_BITS, 2)), np.zeros(256 * 8))
    kinds = "kind int, n int, row binary"
    for r in counted.coalesce(tasks).mapInArrow(run, kinds).groupBy("kind", "n").applyInArrow(add, kinds).toLocalIterator():
        row = np.frombuffer(r.row)
        if r.kind == _TABLE:
            model.table.reshape(-1, CHUNK)[r.n] = row
        elif r.kind == _TAILS:
            model.tails[:] = row
        else:
            (model.spelling if r.kind == _SPELLING else model.choices).take(r.n, row)
    tails = model.tails.reshape(256, 8)[:, :7] + 0.05
    model.tails = np.pad(np.log10(tails / tails.sum(1, keepdims=True)), ((0, 0), (0, 1))).ravel()
    return model


def _scored(counted: DataFrame, tables, model, totals: Totals, kind: str) -> DataFrame:
    """The scores of all documents of all slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = model.value
        for row in _rows(batches):
            told = _choices(row, totals)
            size, spelled, count = len(row["held_out"]), _spelled(row), told["count"]
            spell = np.zeros(len(count))
            first = len(count) - len(spelled)
            once = np.frombuffer(_unpack(row["once"]), np.uint8)
            for symbol, contexts, word in _symbols(spelled):
                own = once[word]
                for bit, node, value in _bits(symbol):
                    zeros, ones = _seen(tables.value, contexts, node)
                    less = own & value
                    for z, o in zip(zeros, ones, strict=True):  # without the word itself, which every table has
                        np.subtract(z, own - less, out=z)
                        np.subtract(o, less, out=o)
                    *_, p = got.spelling.predict(zeros, ones, bit)
                    spell[first:] += np.bincount(word, np.log10(np.where(value == 1, p, 1 - p)), len(spelled))
            score = np.where(told["level"] == 3, spell[told["text"]], np.log10(np.maximum(told["inside"], 1e-300)))
            for at, slots, gate, value in _choice_bits(told):
                _, _, p = got.choices.mix(_stretched(got.table, slots, value, told["learnt"][at]), gate)
                score[at] += np.log10(np.where(value == 1, p, 1 - p))
            score += got.tails[_tail_places(row, told)]
            real = told["text"] != row["empty"]
            seen = count[told["text"]]
            base = np.where(real, np.log10((seen + 1) / (totals.n + totals.v + 1)), 0)
            add = lambda x: np.bincount(told["doc"], x, size)
            own, end = add(score), math.log10((totals.docs + 1) / (totals.n + totals.v + 1))
            known = add(real & (seen > 0)).astype(np.int64) + (totals.docs > 0)
            n_bytes = np.array(row["n_bytes"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["key"], key_type), pa.array(row["held_out"], pa.bool_()), pa.array(add(real).astype(np.int64) + 1), pa.array(known), pa.array(np.full(size, totals.n)), pa.array(add(base) + end), pa.array(own), pa.array(-own * math.log2(10) / np.maximum(1, n_bytes))], names=names)

    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    key_type = to_arrow_type(counted.schema["key"].dataType.elementType)
    return counted.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row of ``docs``.

    held: which rows are not learnt from; by default ``held_out`` of the key. base_score
    is the add-one unigram score over words and one end token, in log10.
    """
    held = held_out(F.col(key)) if held is None else held
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    sliced = cut(_sliced(rows), group=GROUP)
    length, pieces, n, ends = sliced.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "pieces", "n", "ends")]).first()
    bits = min(31, (length // RANGE).bit_length())
    told = cut(_told(sliced, bits))
    v = told.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    counted = cut(_counted(sliced, told.drop("known"), bits), group=GROUP)
    release(sliced, told)
    totals = Totals(pieces, ends, n + ends, v + (ends > 0))
    once = counted.agg(F.coalesce(F.sum("rare"), F.lit(0))).first()[0]
    tables = spark.sparkContext.broadcast(_tables(counted, _sizes(once), max(TABLE_TASKS, once // TASK_WORDS)))
    model = spark.sparkContext.broadcast(_learn(counted, tables, totals, max(MODEL_TASKS, once // TASK_WORDS)))
    return _scored(counted, tables, model, totals, rows.schema["key"].dataType.simpleString()).withColumnRenamed("key", key)
