"""Language-model scores in which every bit of every word is predicted by mixing.

The running text, the three bits that tell how a word is found and the spelling of words
that training doesn't have are those of ``context_mixing``. What stood there as a share of
counts is told here by bits as well:

- A word that has followed the word before it in training is told by bits of its hash: at
  each place where the words that have followed there part. Predictors are how often they
  have followed, how many different ones they are, and how often words of those bits
  follow any word of the range.
- A word that training has, but that neither followed nor stood in the text, is told by
  bits of its hash among all words of training, from how often they occur and how many
  they are.
- A word that stood in the text before is told by the distance to where it last stood: the
  number of its bits, then its bits.
- What ends a word is told by three bits, from its last byte and from what ended the word
  before.

Their stretched probabilities are mixed with learnt weights that a gate picks, and refined,
as all other bits are. Bits of the same contexts are predicted once and looked up where
they recur, which changes no prediction: those of hashes where counts meet, for each pair
of words once, and the others for each slice. Each range of words learns weights of its
own. Costs of words travel in steps of a 16th of a bit, rounded up.
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

from . import context_mixing as cm
from .arrow import small_batches
from .common import cut, mixed, release

#: Bits of a word's hash that tell it from others that followed the same word, and from all others beyond a range's.
FOLLOW_BITS, WORD_BITS = 24, 40
#: Levels of hashes that a range counts over all words before, and steps of a bit in which costs travel.
SHARED_LEVELS, COST_STEPS = 16, 16
TRIE_GATES, EVENT_BITS, EVENT_GATES = 16 * 16, 18, 3 * 32 * 8
_EXPONENT, _DISTANCE, _MARK = range(3)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Runs of equal values numbered from 0."""
    return np.cumsum(np.diff(x, prepend=x[:1]) != 0)


def _grade(x: np.ndarray) -> np.ndarray:
    """0, 1, 2-3, 4-7 and so on, up to class 15."""
    return np.minimum(15, np.frexp(x)[1]).astype(np.int64)


def _graded(x: np.ndarray) -> np.ndarray:
    """Counts of the same class as ``x``, with and without one occurrence, of which there are few different ones."""
    low = 1 << (np.frexp(np.maximum(1, x).astype(float))[1].astype(np.int64) - 1)
    return np.where(x <= low, x, low + 1)


def _node_inputs(nodes: np.ndarray, side: int, without: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer and gates, without so many occurrences on that side."""
    less = lambda row, at: np.maximum(0, nodes[row + at] - without) if at == side and without else nodes[row + at]
    stretch = lambda zeros, ones: np.log((ones + 0.4).astype(np.float32)) - np.log((zeros + 0.4).astype(np.float32))
    zeros, ones = less(0, 0), less(0, 1)
    inputs = np.vstack([stretch(zeros, ones), stretch(nodes[2], nodes[3]), stretch(less(4, 0), less(4, 1)), np.full(nodes.shape[1], 0.3, np.float32)])
    return inputs, _grade(zeros + ones) * 16 + _grade(nodes[2] + nodes[3])


def _tries(group: np.ndarray, path: np.ndarray, times: np.ndarray, kinds: np.ndarray | None, width: int, shared: bool):
    """(nodes, steps): where entries of a group part, and (entries, node, bit) by level.

    Entries are in order of group and path. A node has, for either side, how often its
    entries occur, how many kinds they are (None: one each), how often any group has that side, and the
    occurrences that leave another one behind.
    """
    nodes, steps, total = [np.zeros((8, 0))], [], 0
    at, g = np.arange(len(path)), _numbered(group)
    finest = np.bincount((path >> np.uint64(width - SHARED_LEVELS)).astype(np.int64), times, 1 << SHARED_LEVELS) if shared else None
    for depth in range(width):
        keep = np.bincount(g)[g] > 1 if len(g) else np.zeros(0, bool)
        at, g = at[keep], _numbered(g[keep])
        if not len(at):
            break
        bit = ((path[at] >> np.uint64(width - 1 - depth)) & np.uint64(1)).astype(np.int64)
        child = g * 2 + bit
        here = lambda x: np.bincount(child, x, 2 * (int(g[-1]) + 1)).reshape(-1, 2)  # noqa: B023, E731
        entries = here(None)
        parts = (entries > 0).all(1)
        if parts.any():
            t = times[at]
            around = np.zeros((int(parts.sum()), 2))
            if shared and depth < SHARED_LEVELS:
                every = finest.reshape(2 << depth, -1).sum(1).reshape(-1, 2)
                first = at[np.flatnonzero(np.diff(g, prepend=-1))]
                around = every[(path[first] >> np.uint64(width - depth)).astype(np.int64)[parts]]
            nodes.append(np.vstack([here(t)[parts].T, (entries if kinds is None else here(kinds[at]))[parts].T, around.T, here(t * (t > 1))[parts].T]))
            on = np.flatnonzero(parts[g])
            steps.append((at[on], (total + np.cumsum(parts) - 1)[g[on]], bit[on]))
            total += len(around)
        g = _numbered(child)
    return np.hstack(nodes), steps


def _trie_mixer() -> cm.Mixer:
    return cm.Mixer.of(np.tile([0.8, 0.1, 0.1, 0.0], (TRIE_GATES, 1)))


def _costs(group: np.ndarray, path: np.ndarray, times: np.ndarray, width: int, kinds: np.ndarray | None = None, shared: bool = False) -> np.ndarray:
    """Bits that tell each entry within its group, as it is and without one of its occurrences: shape (2, entries)."""
    nodes, steps = _tries(group, path, times, kinds, width, shared)
    mixer = _trie_mixer()
    for a in range(0, nodes.shape[1], cm.STEP):
        some = nodes[:, a : a + cm.STEP]
        for side in (0, 1):
            inputs, gate = _node_inputs(some, side, 1)
            p, bucket, _ = mixer.mix(inputs, gate)
            mixer.learn(inputs, gate, p, bucket, np.full(len(p), side), some[6 + side])
    told = np.zeros((2, nodes.shape[1], 2))  # whether without, node, side
    for a in range(0, nodes.shape[1], cm.STEP):
        some = nodes[:, a : a + cm.STEP]
        *_, p = mixer.mix(*_node_inputs(some, 0, 0))
        told[0, a : a + cm.STEP] = -np.log2(np.array([1 - p, p])).T
        for side in (0, 1):
            *_, p = mixer.mix(*_node_inputs(some, side, 1))
            told[1, a : a + cm.STEP, side] = -np.log2(p if side else 1 - p)
    told = told.reshape(2, -1)
    out = np.zeros((2, len(path)))
    for at, node, bit in steps:
        which = node * 2 + bit
        for k in (0, 1):
            out[k][at] += told[k][which]
    return out


def _steps_of(costs: np.ndarray) -> np.ndarray:
    return np.minimum(65_535, np.ceil(costs * COST_STEPS)).astype(np.int64)


def _follows(lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word 32 bits for the word before it and ``FOLLOW_BITS`` for itself."""
    before = np.roll(own, 1)
    before[cm._starts(lengths)] = cm.START
    return ((mixed(before * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) << np.uint64(FOLLOW_BITS)) | (mixed(own) >> np.uint64(64 - FOLLOW_BITS))


def _running(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths, learnt, text, hashes, _ = cm._running(row)
    return lengths, learnt, text, hashes, _follows(lengths, hashes[text])


def _told(sliced: DataFrame, bits: int) -> DataFrame:
    """(slice, part, words, word_costs, word_more, pairs, pair_costs, pair_more, known, kinds, mass): as in ``context_mixing``, with what tells words and pairs.

    Pairs are dealt by the word before; their counts are ``_graded``. Costs are those
    without one occurrence where training texts of the slice have the word or pair; more
    are the plain ones of those that its other texts have, too. kinds, mass: the different words that training has
    in the range and their occurrences, in one row a range (the others: 0).
    """
    names = ["slice", "part", "words", "word_times", "pairs", "pair_times"]
    wide = 32 + FOLLOW_BITS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("slice", "held_out", "lengths", "words", "sizes", "text")}
                _, learnt, text, hashes, pairs = _running(row)
                both, of = np.unique(pairs, return_inverse=True)
                order = np.argsort(hashes)
                asked = lambda at, n: np.bincount(at, learnt, n) * 2 + (np.bincount(at, ~learnt, n) > 0)  # noqa: B023, E731
                times = [asked(text, len(hashes))[order], asked(of, len(both))]
                hashes = hashes[order]
                parts = [((hashes >> np.uint64(33)) >> np.uint64(31 - bits)).astype(np.int64), (both >> np.uint64(wide - bits)).astype(np.int64)]
                there = np.union1d(*parts)
                cuts = [list(zip(np.searchsorted(p, there).tolist(), np.searchsorted(p, there, "right").tolist(), strict=True)) for p in parts]
                cols = [[cm._steps(hashes[a:b], "<u8") for a, b in cuts[0]], [cm._planes(times[0][a:b]) for a, b in cuts[0]], [cm._steps(both[a:b], "<u8") for a, b in cuts[1]], [cm._planes(times[1][a:b]) for a, b in cuts[1]]]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(there), pa.int64()), pa.array(there, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=names)

    def add(lows: list[np.ndarray], times: list[np.ndarray], tell) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        keys, of = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(of, np.concatenate(times), len(keys)).astype(np.int64)
        there = np.flatnonzero(total > 0)
        costs = np.zeros((2, len(keys)), np.int64)
        costs[:, there] = _steps_of(tell(keys[there], total[there]))
        costs[1, total <= 1] = 0  # without its one occurrence it isn't told here
        ends = np.cumsum([len(x) for x in lows]).tolist()
        return keys, of, total, costs, list(zip([0, *ends[:-1]], ends, strict=True))

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        read = lambda how, c, kind: [how(x.as_py(), kind) for x in got.column(c)]
        one = lambda keys, total: _costs(np.zeros(len(keys), np.int64), (keys << np.uint64(bits)) >> np.uint64(64 - WORD_BITS), total, WORD_BITS)
        two = lambda keys, total: _costs((keys >> np.uint64(FOLLOW_BITS)).astype(np.int64), keys & np.uint64((1 << FOLLOW_BITS) - 1), total, FOLLOW_BITS, shared=True)
        asked = [read(cm._values, c, "<u4") for c in ("word_times", "pair_times")]
        known, kinds, mass = (np.zeros(got.num_rows, np.int64) for _ in range(3))
        cells = []
        for c, tell, ask in zip(("words", "pairs"), (one, two), asked, strict=True):
            keys, of, total, costs, cuts = add(read(cm._sums, c, "<u8"), [x >> 1 for x in ask], tell)
            if c == "words":
                known[0], kinds[0], mass[0] = ((total > 0) & (keys != cm.EMPTY)).sum(), (total > 0).sum(), total.sum()
            else:
                total = _graded(total)
            where = [(of[a:b], x) for (a, b), x in zip(cuts, ask, strict=True)]
            cells.append([cm._planes(total[at]) for at, _ in where])
            cells.append([cm._planes(costs[(x > 1).astype(np.int64), at], "<u2") for at, x in where])
            cells.append([cm._planes(costs[0, at[(x > 1) & (x & 1 == 1)]], "<u2") for at, x in where])
        cells = [pa.array(x, pa.binary()) for x in cells]
        yield pa.RecordBatch.from_arrays([*[got.column(c).combine_chunks() for c in ("slice", "part")], *cells, *[pa.array(x) for x in (known, kinds, mass)]], names=["slice", "part", "words", "word_costs", "word_more", "pairs", "pair_costs", "pair_more", "known", "kinds", "mass"])

    questions = sliced.mapInArrow(ask, "slice long, part int, words binary, word_times binary, pairs binary, pair_times binary")
    return questions.groupBy("part").applyInArrow(answer, "slice long, part int, words binary, word_costs binary, word_more binary, pairs binary, pair_costs binary, pair_more binary, known long, kinds long, mass long")


def _part_costs(told: DataFrame, bits: int) -> np.ndarray:
    """Bits that tell each range among all, by the words that training has there."""
    rows = told.where("kinds > 0").select("part", "kinds", "mass").collect()
    rows.sort()
    part, kinds, mass = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    out = np.zeros((2, 1 << bits))
    out[:, part] = _costs(np.zeros(len(part), np.int64), part.astype(np.uint64), mass.astype(float), max(1, bits), kinds.astype(float))
    return _steps_of(out)


def _counted(sliced: DataFrame, told: DataFrame, parts, bits: int) -> DataFrame:
    """As in ``context_mixing``, with what tells each word of the text that training has."""
    kind = sliced.schema["key"].dataType.simpleString()
    names = ["key", "held_out", "n_bytes", "lengths", "text", "marks", "last", "counts", "pairs", "costs", "spelled", "sizes", "once", "rare", "empty"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        lengths, learnt, text, hashes, pairs = _running(row)
        right = right.sort_by("part")
        read = lambda c, kind: np.concatenate([cm._values(x.as_py(), kind) for x in right.column(c)]).astype(np.int64)
        by_hash = np.argsort(hashes)
        count = np.empty(len(hashes), np.int64)
        count[by_hash] = read("words", "<u4")  # answers come in order of hashes

        def costs(of: np.ndarray, c: str) -> np.ndarray:
            """Of each word of the text, by its place among the answers."""
            told = read(f"{c}_costs", "<u2")
            plain, other = told.copy(), np.bincount(of, ~learnt, len(told)) > 0
            plain[(np.bincount(of, learnt, len(told)) > 0) & other] = read(f"{c}_more", "<u2")
            return np.where(learnt, told[of], plain[of])

        place = np.empty(len(hashes), np.int64)
        place[by_hash] = np.arange(len(hashes))
        _, of = np.unique(pairs, return_inverse=True)
        often, follow = read("pairs", "<u4")[of], costs(of, "pair")
        alone = costs(place[text], "word") + parts.value[learnt.astype(np.int64), ((hashes >> np.uint64(33)) >> np.uint64(31 - bits)).astype(np.int64)[text]]
        tell = np.where(often > learnt, follow, np.where(count[text] > learnt, alone, 0))
        own = np.bincount(text, learnt, len(hashes))
        sizes, raw = cm._values(row["sizes"]).astype(np.int64), np.frombuffer(cm._unpack(row["words"]), np.uint8)
        ends = np.cumsum(sizes)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        last = np.where(sizes > 0, raw[np.maximum(0, ends - 1)], 0) if len(raw) else np.zeros(len(sizes), np.uint8)
        rare = order[count[order] <= 1]
        data, _ = cm._gather(raw, (ends - sizes)[rare], ends[rare])
        none = np.flatnonzero(sizes == 0)
        often = np.where(often > learnt, (1 << np.maximum(0, _grade((often - learnt).astype(float)) - 1)) + learnt, 0)  # its class is what is used
        cells = [cm._planes(lengths), cm._planes(rank[text]), row["marks"], cm._pack(last[order].astype(np.uint8).tobytes()), cm._planes(count[order]), cm._planes(often), cm._planes(np.minimum(65_535, tell), "<u2"), cm._pack(data.tobytes()), cm._planes(sizes[rare]), cm._pack(((count[rare] == 1) & (own[rare] == 1)).tobytes()), len(rare), int(rank[none[0]]) if len(none) else -1]
        return pa.table([*[left.column(c) for c in names[:3]], *[pa.array([x]) for x in cells]], names=names)

    schema = f"key {kind}, held_out array<boolean>, n_bytes array<long>, lengths binary, text binary, marks binary, last binary, counts binary, pairs binary, costs binary, spelled binary, sizes binary, once binary, rare long, empty long"
    return sliced.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, schema)


@dataclass
class Events:
    """What is told by a few bits: kind, two contexts, number of bits and code of each, and the word it is of."""

    kind: np.ndarray
    first: np.ndarray
    second: np.ndarray
    width: np.ndarray
    code: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, *parts: tuple) -> Events:
        """From (kind, first, second, width, code, word) of each kind."""
        full = [[np.broadcast_to(x, p[-1].shape).astype(np.int64) for x in p] for p in parts]
        return cls(*[np.concatenate(x) for x in zip(*full, strict=True)])

    def distinct(self, flag: np.ndarray) -> tuple[Events, np.ndarray, np.ndarray]:
        """(each different one, flag included, as ``word``; which one each is; how often it occurs)."""
        small = ((((self.kind * 2 + flag) * 256 + self.first) * 32 + self.second) * 64 + self.width).astype(np.uint64)
        _, at, of, times = np.unique((small << np.uint64(40)) | self.code.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
        return Events(*[x[at] for x in (self.kind, self.first, self.second, self.width, self.code, flag)]), of, times

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(events, slots by predictor, gates, values) of the highest bit of each, then of the next one, and so on.

        A bit is told with the bits before it, beyond five with the first three only.
        """
        u = lambda x: x.astype(np.uint64)
        for j in range(int(self.width.max()) if len(self.width) else 0):
            at = np.flatnonzero(self.width > j)
            kind, first, second, width, code = (x[at] for x in (self.kind, self.first, self.second, self.width, self.code))
            prefix = (code >> (width - min(j, 3)) if j > 5 else code >> (width - j)) | (1 << min(j, 6))
            node = ((kind * 64 + width) * 64 + j) * 128 + prefix
            slots = [(mixed(u(node * 4 + k) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(u(c))) >> np.uint64(64 - EVENT_BITS)).astype(np.int64) for k, c in enumerate((first * 32 + second, first, second + 256))]
            yield at, np.array(slots), (kind * 32 + np.minimum(width, 31)) * 8 + min(j, 7), (code >> (width - 1 - j)) & 1


def _event_mixer() -> cm.Mixer:
    return cm.Mixer.of(np.tile([0.6, 0.2, 0.2, 0.0], (EVENT_GATES, 1)))


def _events(row: dict, told: dict) -> Events:
    """Distances of words that stood in the text before, and what ends each word."""
    doc, size = told["doc"], len(told["text"])
    back, order = np.zeros(size, np.int64), told["order"]
    back[order[1:]] = np.diff(order)  # of the same word in the same text, where it is used
    far = np.flatnonzero(told["level"] == 1)
    gap = back[far]
    exponent = np.frexp(gap.astype(float))[1].astype(np.int64) - 1
    place = far - np.searchsorted(doc, doc[far])
    prior = (told["gate"] % 5)[far]
    last, mark = np.divmod(cm._tail_places(row, told), 8)
    ended = np.where(np.diff(doc, prepend=-1) != 0, 7, np.roll(mark, 1))
    return Events.of((_EXPONENT, np.minimum(31, np.frexp(place.astype(float))[1]), prior, 5, exponent, far), (_DISTANCE, exponent, 0, exponent, gap - (1 << exponent), far), (_MARK, last, ended, 3, mark, np.arange(size)))


@dataclass
class Model(cm.Model):
    """Of events, too, in place of tails."""

    events: cm.Mixer
    event_table: np.ndarray


_SPELLING, _CHOICES, _TABLE, _EVENTS, _EVENT_TABLE = range(5)


def _learn(counted: DataFrame, tables, totals: cm.Totals, tasks: int) -> Model:
    """Each task's mixers over its slices, averaged by what the gates have seen, and the sums of its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, choices, events = cm.Mixer.fresh(), cm.Mixer.choices(), _event_mixer()
        table, event_table = np.zeros((1 << cm.CHOICE_BITS, 2)), np.zeros((1 << EVENT_BITS, 2))
        for row in cm._rows(batches):
            for symbol, contexts, _ in cm._symbols(cm._once(row)):
                for bit, node, value in cm._bits(symbol):
                    zeros, ones = cm._seen(tables.value, contexts, node)
                    for z, o in zip(zeros, ones, strict=True):  # without the word itself, which every table has
                        np.subtract(z, 1 - value, out=z)
                        np.subtract(o, value, out=o)
                    inputs, gate, p, bucket, _ = spelling.predict(zeros, ones, bit)
                    spelling.learn(inputs, gate, p, bucket, value)
            told = cm._choices(row, totals, shares=False)
            trained = told["learnt"] > 0
            told["asked"] &= trained
            for _, slots, gate, value in cm._choice_bits(told):
                inputs = cm._stretched(table, slots)
                p, bucket, _ = choices.mix(inputs, gate)
                choices.learn(inputs, gate, p, bucket, value)
                np.add.at(table.reshape(-1), (slots * 2 + value).ravel(), 1.0)
            every = _events(row, told)
            different, _, times = every.distinct(told["learnt"][every.word])
            times = times * different.word  # of training texts
            for at, slots, gate, value in different.bits():
                inputs = cm._stretched(event_table, slots)
                p, bucket, _ = events.mix(inputs, gate)
                events.learn(inputs, gate, p, bucket, value, times[at])
                np.add.at(event_table.reshape(-1), (slots * 2 + value).ravel(), np.tile(times[at].astype(float), len(slots)))
        out = [(_SPELLING, *x) for x in spelling.gained(cm.Mixer.fresh())] + [(_CHOICES, *x) for x in choices.gained(cm.Mixer.choices())] + [(_EVENTS, *x) for x in events.gained(_event_mixer())]
        out += [(k, n, part) for k, t in ((_TABLE, table), (_EVENT_TABLE, event_table)) for n, part in enumerate(t.reshape(-1, cm.CHUNK)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([zlib.compress(x[2].astype("<f8").tobytes(), 1) for x in out], pa.binary())], names=["kind", "n", "row"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts:
            for x in part.column("row"):
                total = total + np.frombuffer(zlib.decompress(x.as_buffer()), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["kind", "n", "row"])

    model = Model(cm.Mixer.fresh(), cm.Mixer.choices(), np.zeros((1 << cm.CHOICE_BITS, 2)), np.zeros(0), _event_mixer(), np.zeros((1 << EVENT_BITS, 2)))
    mixers, counts = {_SPELLING: model.spelling, _CHOICES: model.choices, _EVENTS: model.events}, {_TABLE: model.table, _EVENT_TABLE: model.event_table}
    kinds = "kind int, n int, row binary"
    for r in counted.coalesce(tasks).mapInArrow(run, kinds).groupBy("kind", "n").applyInArrow(add, kinds).toLocalIterator():
        row = np.frombuffer(r.row)
        if r.kind in counts:
            counts[r.kind].reshape(-1, cm.CHUNK)[r.n] = row
        else:
            mixers[r.kind].take(r.n, row)
    return model


def _scored(counted: DataFrame, tables, model, totals: cm.Totals, kind: str) -> DataFrame:
    """The scores of all documents of all slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = model.value
        for row in cm._rows(batches):
            told = cm._choices(row, totals, shares=False)
            size, spelled, count, text = len(row["held_out"]), cm._spelled(row), told["count"], told["text"]
            spell = np.zeros(len(count))
            first = len(count) - len(spelled)
            once = np.frombuffer(cm._unpack(row["once"]), np.uint8)
            for symbol, contexts, word in cm._symbols(spelled):
                own = once[word]
                for bit, node, value in cm._bits(symbol):
                    zeros, ones = cm._seen(tables.value, contexts, node)
                    less = own & value
                    for z, o in zip(zeros, ones, strict=True):  # without the word itself, which every table has
                        np.subtract(z, own - less, out=z)
                        np.subtract(o, less, out=o)
                    *_, p = got.spelling.predict(zeros, ones, bit)
                    spell[first:] += np.bincount(word, np.log10(np.where(value == 1, p, 1 - p)), len(spelled))
            costs = cm._values(row["costs"], "<u2") * (-math.log10(2) / COST_STEPS)
            score = np.choose(told["level"], [costs, 0.0, costs, spell[text]])  # level 1: by where the word last stood
            for at, slots, gate, value in cm._choice_bits(told):
                _, _, p = got.choices.mix(cm._stretched(got.table, slots, value, told["learnt"][at]), gate)
                score[at] += np.log10(np.where(value == 1, p, 1 - p))
            every = _events(row, told)
            different, of, _ = every.distinct(told["learnt"][every.word])
            each = np.zeros(len(different.kind))
            for at, slots, gate, value in different.bits():
                _, _, p = got.events.mix(cm._stretched(got.event_table, slots, value, different.word[at]), gate)
                each[at] += np.log10(np.where(value == 1, p, 1 - p))
            score += np.bincount(every.word, each[of], len(score))
            real = text != row["empty"]
            seen = count[text]
            base = np.where(real, np.log10((seen + 1) / (totals.n + totals.v + 1)), 0)
            add = lambda x: np.bincount(told["doc"], x, size)  # noqa: B023, E731
            own, end = add(score), math.log10((totals.docs + 1) / (totals.n + totals.v + 1))
            known = add(real & (seen > 0)).astype(np.int64) + (totals.docs > 0)
            n_bytes = np.array(row["n_bytes"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["key"], key_type), pa.array(row["held_out"], pa.bool_()), pa.array(add(real).astype(np.int64) + 1), pa.array(known), pa.array(np.full(size, totals.n)), pa.array(add(base) + end), pa.array(own), pa.array(-own * math.log2(10) / np.maximum(1, n_bytes))], names=names)

    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    key_type = to_arrow_type(counted.schema["key"].dataType.elementType)
    return counted.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """The columns of ``context_mixing.score_documents``, with scores of mixed bits alone."""
    held = cm.held_out(F.col(key)) if held is None else held
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    sliced = cut(cm._sliced(rows), group=cm.GROUP)
    length, pieces, n, ends = sliced.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "pieces", "n", "ends")]).first()
    bits = min(31, (length // cm.RANGE).bit_length())
    told = cut(_told(sliced, bits))
    v = told.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    parts = spark.sparkContext.broadcast(_part_costs(told, bits))
    counted = cut(_counted(sliced, told.drop("known", "kinds", "mass"), parts, bits), group=cm.GROUP)
    release(sliced, told)
    totals = cm.Totals(pieces, ends, n + ends, v + (ends > 0))
    once = counted.agg(F.coalesce(F.sum("rare"), F.lit(0))).first()[0]
    tables = spark.sparkContext.broadcast(cm._tables(counted, cm._sizes(once), max(cm.TABLE_TASKS, once // cm.TASK_WORDS)))
    model = spark.sparkContext.broadcast(_learn(counted, tables, totals, max(cm.MODEL_TASKS, once // cm.TASK_WORDS)))
    return _scored(counted, tables, model, totals, rows.schema["key"].dataType.simpleString()).withColumnRenamed("key", key)
