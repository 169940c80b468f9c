"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Every code point gets a class from a table; a finite
automaton over the classes says where tokens start. Its transitions are functions on
eight states, whose composition is associative: lanes of a text slice compose their
functions side by side, a scan over lanes gives each lane its entry state, and a second
sweep marks the starts. The byte slices between starts are merged once per distinct
slice, many slices in step, and kept in a bounded cache.

Null texts count as empty and give no ids. Ids are packed as little-endian unsigned
32-bit integers, and ``id_ends`` holds the byte offset where each id's bytes end, so a
range of ids can be decoded without the text. Rows are encoded one by one, so repeated
rows give repeated results, and an empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import with_columns
from .common import prefix_sums, slices, span_hashes, strings

# Symbols of the automaton.
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_LAST, WHITE_LAST, WHITE_MID = range(8)
# Its states: what the text so far ends in.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: Code points that ``\s`` matches.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters a lane takes in a sweep.
LANE = 128
#: Slices of more bytes are merged one by one with a heap.
LONG = 64
#: Distinct slices kept in a worker's cache before it starts anew.
CACHE = 150_000
_NONE = np.int32(2**31 - 1)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, at [first of text * 64 + symbol * 8 + state]."""
    step, start = np.zeros((2, 8, 8), np.uint8), np.ones((2, 8, 8), bool)
    for first in (0, 1):
        for state in range(8):
            now = FRESH if first else state
            for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
                step[first, symbol, state] = run
                start[first, symbol, state] = now not in (run, AFTER_SPACE)
            for symbol, left in ((QUOTE_1, ONE_LEFT), (QUOTE_2, TWO_LEFT)):
                inside = now in (IN_OTHERS, AFTER_SPACE)
                step[first, symbol, state] = IN_OTHERS if inside else left
                start[first, symbol, state] = not inside
            step[first, SPACE_LAST, state] = AFTER_SPACE
            step[first, WHITE_LAST, state] = FRESH
            step[first, WHITE_MID, state] = IN_WHITE
            start[first, WHITE_MID, state] = now != IN_WHITE
            if now in (ONE_LEFT, TWO_LEFT):
                step[first, LETTER, state] = FRESH if now == ONE_LEFT else ONE_LEFT
                start[first, LETTER, state] = False
    return step.ravel(), start.ravel()


STEP, START = _automaton()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_MID for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = WHITE_MID
    return out


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's input: classes, told apart by the next two characters of the same text."""
    symbol = code_point_classes()[points]
    n = len(points)
    after = np.zeros(n, bool)  # the next character is in the same text
    after[:-1] = ~first[1:]
    white = symbol == WHITE_MID
    last = white & after
    last[:-1] &= ~white[1:]
    symbol[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    at = np.flatnonzero((points == 39) & after)
    if len(at):
        one = points[at + 1]
        two = np.where(after[at + 1], points[np.minimum(at + 2, n - 1)], 0)
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[pair]] = QUOTE_2
    return symbol


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a token. first: which start a text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // LANE)
    code = np.zeros(lanes * LANE, np.uint8)
    code[:n] = (_symbols(points, first) << 3) + (first.astype(np.uint8) << 6)
    code = np.ascontiguousarray(code.reshape(lanes, LANE).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for column in code:
        whole = STEP[column[:, None] + whole]
    reach = 1
    while reach < lanes:  # whole[i] becomes the composition of all lanes up to i
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), 1)
        reach *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((LANE, lanes), bool)
    for k, column in enumerate(code):
        at = column + state
        out[k] = START[at]
        state = STEP[at]
    return out.T.ravel()[:n]


class Vocabulary:
    """The ranks of byte strings, with the ranks of the pairs that make them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pair_keys = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.letters[np.arange(total) + np.repeat(self.begins[ids] - (ends - size), size)]


def _merge_long(v: Vocabulary, piece: bytes) -> list[int]:
    """The ids of one slice, by a heap of pairs."""
    ids, n = [int(v.of_byte[b]) for b in piece], len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    begin, end = list(range(n)), list(range(1, n + 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := v.ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, stop = heapq.heappop(heap)
        m = after[k] if alive[k] else n
        if m >= n or end[m] != stop:
            continue
        ids[k], end[k], alive[m] = rank, stop, False
        after[k] = after[m]
        if after[k] < n:
            before[after[k]] = k
            if (r := v.ranks.get(piece[begin[k] : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
        if (p := before[k]) >= 0 and (r := v.ranks.get(piece[begin[p] : stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ids[k] for k in range(n) if alive[k]]


def _merge_many(v: Vocabulary, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all slices of at most ``width`` bytes one after another, and their number in each."""
    m = len(pieces)
    size = np.array([len(p) for p in pieces])
    inside = np.arange(width)[None, :] < size[:, None]
    ids = np.zeros((m, width), np.int32)
    ids[inside] = v.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full((m, width), _NONE, np.int32)
    pair = inside[:, 1:]
    rank[:, :-1][pair] = v.pair_rank(ids[:, :-1][pair], ids[:, 1:][pair])
    after = np.tile(np.arange(1, width + 1), (m, 1))
    before = np.tile(np.arange(-1, width - 1), (m, 1))
    after[np.arange(m), size - 1] = width
    rows = np.arange(m)
    while len(rows):
        at = rank[rows].argmin(1)
        best = rank[rows, at]
        going = best < _NONE
        rows, at, best = rows[going], at[going], best[going]
        gone = after[rows, at]
        ids[rows, at] = best
        inside[rows, gone] = False
        rank[rows, gone] = _NONE
        rank[rows, at] = _NONE
        nxt = after[rows, gone]
        after[rows, at] = nxt
        k = np.flatnonzero(nxt < width)
        before[rows[k], nxt[k]] = at[k]
        rank[rows[k], at[k]] = v.pair_rank(best[k], ids[rows[k], nxt[k]])
        prior = before[rows, at]
        k = np.flatnonzero(prior >= 0)
        rank[rows[k], prior[k]] = v.pair_rank(ids[rows[k], prior[k]], best[k])
    return ids[inside], inside.sum(1)


class Encoder:
    """Encodes Arrow text columns; remembers the ids of distinct slices."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            groups.setdefault(0 if p in self.v.ranks or len(p) > LONG else 8 if len(p) <= 8 else 16 if len(p) <= 16 else LONG, []).append(k)
        order, pools, counts = [], [self.pool], []
        for width, members in groups.items():
            for low in range(0, len(members), 20_000):
                some = members[low : low + 20_000]
                if width:
                    ids, count = _merge_many(self.v, [pieces[k] for k in some], width)
                else:
                    each = [[r] if (r := self.v.ranks.get(pieces[k])) is not None else _merge_long(self.v, pieces[k]) for k in some]
                    ids, count = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
                order += some
                pools.append(ids)
                counts.append(count)
        count = np.concatenate(counts)
        base, at = len(self.begin), len(self.pool)
        self.pool = np.concatenate(pools)
        self.begin = np.concatenate([self.begin, at + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.slot.update(zip([hashes[k] for k in order], range(base, base + len(order)), strict=True))

    def _encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices that start at ``starts``, and their number in each slice."""
        ends = np.append(starts[1:], len(raw))
        keys, where, which = np.unique(span_hashes(prefix_sums(raw), starts, ends), return_index=True, return_inverse=True)
        if len(self.slot) > CACHE:
            self._clear()
        keys = keys.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.slot]
        if new:
            data = raw.tobytes()
            self._learn([keys[k] for k in new], [data[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        slots = np.fromiter((self.slot[h] for h in keys), np.int64, len(keys))[which]
        count = self.count[slots]
        ends = np.cumsum(count)
        return self.pool[np.arange(int(ends[-1])) + np.repeat(self.begin[slots] - (ends - count), count)], count

    def encode(self, column: pa.Array, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row, byte offset in its row where each id ends, if asked for)."""
        ids, counts, stops = [], [], []
        for _, raw, offsets in slices(strings(column)):
            if not len(raw):
                counts.append(np.zeros(len(offsets) - 1, np.int64))
                continue
            at = np.flatnonzero((raw & 0xC0) != 0x80)
            points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            first = np.zeros(len(points), bool)
            begin = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[np.searchsorted(at, begin)] = True
            starts = at[token_starts(points, first)]
            got, count = self._encode(raw, starts)
            if not np.array_equal(self.v.decode(got), raw):  # two slices with one hash: no cache for this run
                self._clear()
                data = raw.tobytes()
                cuts = [*starts.tolist(), len(raw)]
                parts = [_merge_long(self.v, p) if p not in self.v.ranks else [self.v.ranks[p]] for p in (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
                got, count = np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts])
            total = np.concatenate([[0], np.cumsum(count)])
            of_row = total[np.searchsorted(starts, offsets)]
            size = np.diff(of_row)
            ids.append(got)
            counts.append(size)
            if ends:
                stops.append(np.cumsum(self.v.lengths[got]) - np.repeat(offsets[:-1], size))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(ids, np.int32), join(counts, np.int64), join(stops, np.int64)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 32-bit values as one binary a row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: str, text: str = "text", offsets: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and, if asked for, ``id_ends`` of column ``text``.

    vocabulary: path of a rank file, read by the driver and sent to executors (a fixed
    size). decoded: the name of a column for the bytes that the packed ids decode to, in
    the same pass. Null and empty texts give 0 tokens; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if vocabulary not in _encoders:
            _encoders.clear()
            _encoders[vocabulary] = Encoder(shared.value)
        ids, counts, stops = _encoders[vocabulary].encode(batch.column(text), offsets)
        out = {"n_tokens": pa.array(counts, pa.int64()), "ids": packed(ids, counts)}
        if offsets:
            out["id_ends"] = packed(stops, counts)
        if decoded:
            out[decoded] = _decoded(shared.value, out["ids"])
        return out

    return with_columns(docs, make, "n_tokens long, ids binary" + ", id_ends binary" * offsets + (f", `{decoded}` binary" if decoded else ""))


def _decoded(v: Vocabulary, ids: pa.Array) -> pa.Array:
    return pa.array([v.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).tobytes() for x in ids.to_pylist()], pa.binary())


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of column ``ids`` in column ``out`` (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: _decoded(shared.value, batch.column(ids))}

    return with_columns(encoded, make, f"`{out}` binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded bytes."""
    done = encode(docs.select("doc_id", "text"), vocabulary, offsets=False, decoded="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
