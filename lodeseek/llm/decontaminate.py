"""Benchmark passages in training documents, found by suffix arrays over the documents.

Words are runs of digits, A-Z in either case and characters beyond ASCII. A window is
``WINDOW`` consecutive words of a benchmark item (the test), or all words of an item that
has fewer; a document's word is hit if it lies inside an occurrence of any window.

A batch of documents is a shard. Words that no item has can't be part of a match, so a
shard keeps the runs of known words that are as long as the shortest window, and sorts
the suffixes of those runs. Test suffixes are then binary-searched in the shard's suffix
array (those whose first few words the shard doesn't have in a row have no place to look
for and are left out by a look-up the other way, so a shard's work follows its own size and
not the benchmark's); the two suffixes around a suffix's place give its longest verbatim
match, and where that is a window or more, two more searches give the interval of all its
occurrences.
Suffixes are compared by the length of their common prefix, which is found by doubling
over sums of word hashes (64 bits), so a comparison doesn't walk over long matches.

Equal windows are looked up in a document once, whatever the number of items and
positions that have them; a document's items are the union over its distinct windows.
Documents aren't shuffled. The test goes to every task in blocks of ``BLOCK_BYTES`` of
text; each block is one more pass over the documents in the same plan.

Null texts have no words, items without words have no windows. Items are told apart by
their id as text (null: empty); rows of one id are one item. Repeated documents each get
their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrow import parts, small_batches, with_columns
from .common import flat, lower, mixed, own_name, powers, prefix_sums, slices, span_hashes, spans_of_words, strings

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 4 << 20

#: First words by which test suffixes are left out (the shortest window's, if it has fewer).
FIRST = 4

_ITEM_WORD = np.zeros(256, bool)
_ITEM_WORD[0x30:0x3A] = _ITEM_WORD[0x61:0x7B] = _ITEM_WORD[0x80:] = True
_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _pieces(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a text into pieces of about ``limit`` bytes that end outside words."""
    at = 0
    while at < len(raw):
        end = at + limit
        while end < len(raw) and _ITEM_WORD[raw[end]]:
            some = np.flatnonzero(~_ITEM_WORD[raw[end : end + limit]])
            end += int(some[0]) if len(some) else limit
        yield at, min(end, len(raw))
        at = end


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the index of each row's first word (one more at the end)."""
    found, firsts, n = [], [np.zeros(1, np.int64)], 0
    for _, raw, offsets in slices(column, common.SLICE_BYTES):
        raw = lower(raw)
        cuts = [(0, len(raw))] if len(offsets) > 2 else list(_pieces(raw, common.SLICE_BYTES))
        ends = np.zeros(len(offsets) - 1, np.int64)
        for a, b in cuts:
            starts, stops, first = spans_of_words(raw[a:b], offsets if len(offsets) > 2 else np.array([0, b - a]), _ITEM_WORD)
            found.append(span_hashes(prefix_sums(raw[a:b]), starts, stops))
            ends += first[1:]
        firsts.append(n + ends)
        n = int(firsts[-1][-1])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(firsts)


def _sums(keys: np.ndarray) -> np.ndarray:
    up, _ = powers(len(keys))
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * up[:-1], out=sums[1:])
    return sums


def _grams(sums: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the ``words`` words from each start on."""
    _, down = powers(len(sums) - 1)
    return mixed((sums[starts + words] - sums[starts]) * down[starts])


class Test:
    """A block of the benchmark: its words as codes from 1, a 0 after each item, and its windows."""

    __test__ = False

    def __init__(self, texts: pa.Array, ids: list[str | None], window: int):
        hashes, first = _hashes(texts)
        n = np.diff(first)
        self.window = window
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        item = np.repeat(np.arange(len(n)), n)
        self.codes = np.zeros(len(codes) + len(n), np.int64)
        self.codes[np.arange(len(codes)) + item] = codes + 1
        self.sums = _sums(mixed(self.codes.astype(np.uint64)))
        begins, sizes = (first[:-1] + np.arange(len(n))), np.minimum(n, window)
        per = np.where(n > 0, n - sizes + 1, 0)
        self.item = np.repeat(np.arange(len(n)), per)
        self.at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.starts = np.repeat(begins, per) + self.at
        self.size = np.repeat(sizes, per)
        self.shortest = int(self.size.min()) if len(self.size) else 0
        self.most = int(n.max(initial=0))
        self.first = min(FIRST, self.shortest)
        grams = _grams(self.sums, self.starts, self.first)
        self.by_gram = np.argsort(grams, kind="stable")
        self.grams = np.unique(grams)
        self.gram_bounds = np.append(np.searchsorted(grams[self.by_gram], self.grams), len(grams))
        self.ids = np.array([i or "" for i in ids], object)
        words = np.zeros((len(self.starts), window), np.int64)
        for k in range(window):
            some = self.size > k
            words[some, k] = self.codes[self.starts[some] + k]
        _, self.same = np.unique(words, axis=0, return_inverse=True)  # equal windows have one number
        self.same = self.same.reshape(-1)
        order = np.lexsort((self.item, self.same))
        bounds = np.searchsorted(self.same[order], np.arange(self.same.max(initial=-1) + 2))
        sets: dict[tuple, int] = {}
        self.group = np.array([sets.setdefault(tuple(sorted(set(self.ids[self.item[order[a:b]]]))), len(sets)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
        self.groups = list(sets)  # the sets of items that have a window, each once


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by doubling."""
    n, width = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].reshape(-1)
    while True:
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank[order] = fresh
        width *= 2
        if not n or fresh[-1] == n - 1 or width > n:
            return order


class Shard:
    """Suffixes of the runs of known words of some documents, and where test suffixes match them."""

    def __init__(self, test: Test, hashes: np.ndarray, first: np.ndarray):
        self.test, self.first = test, first
        place = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
        known = np.flatnonzero(test.vocabulary[place] == hashes)
        row = np.searchsorted(first, known, "right") - 1
        begins = np.ones(len(known), bool)
        begins[1:] = (known[1:] != known[:-1] + 1) | (row[1:] != row[:-1])
        run = np.cumsum(begins) - 1
        long = np.bincount(run)[run] >= test.shortest if len(run) else begins
        known, run = known[long], np.unique(run[long], return_inverse=True)[1].reshape(-1)
        runs = int(run[-1]) + 1 if len(run) else 0
        at = np.arange(len(known)) + run
        self.codes = np.zeros(len(known) + runs, np.int64)
        self.codes[at] = place[known] + 1
        gaps = np.flatnonzero(self.codes == 0)
        self.codes[gaps] = -1 - np.arange(runs)  # all unlike, so no match passes the end of a run
        self.word = np.full(len(self.codes), -1)
        self.word[at] = known
        self.sums = _sums(mixed(self.codes.astype(np.uint64)))
        self.order = suffix_array(self.codes)[runs:]
        self.heads = self.codes[self.order]

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``p`` here and at ``q`` in the test share, ``most`` at most."""
        test, out = self.test, np.zeros(len(p), np.int64)
        _, down = powers(max(len(self.codes), len(test.codes)))
        step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
        while step and len(p):
            end = out + step
            fits = (end <= most) & (p + end <= len(self.codes)) & (q + end <= len(test.codes))
            i, j, a, b = p[fits], q[fits], out[fits], end[fits]
            equal = (self.sums[i + b] - self.sums[i + a]) * down[i + a] == (test.sums[j + b] - test.sums[j + a]) * down[j + a]
            out[np.flatnonzero(fits)[equal]] += step
            step >>= 1
        return out

    def _edge(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, rising: bool) -> np.ndarray:
        """The first place in [low, high) of the order that shares ``most`` words with q (rising), or the first that doesn't."""
        low, high = low.copy(), high.copy()
        while True:
            on = np.flatnonzero(low < high)
            if not len(on):
                return low
            mid = (low[on] + high[on]) // 2
            meets = self.common(self.order[mid], q[on], most[on]) >= most[on]
            up = ~meets if rising else meets
            low[on[up]], high[on[~up]] = mid[up] + 1, mid[~up]

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a test suffix, its longest match, its place) for those with a match of a window or more."""
        test = self.test
        here = np.unique(_grams(self.sums, np.arange(len(self.codes) - test.first + 1), test.first))
        place = np.minimum(np.searchsorted(test.grams, here), len(test.grams) - 1)
        met = place[test.grams[place] == here]
        n = test.gram_bounds[met + 1] - test.gram_bounds[met]
        asked = np.sort(test.by_gram[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(test.gram_bounds[met], n)])
        q = test.starts[asked]
        bottom, top = (np.searchsorted(self.heads, test.codes[q], side) for side in ("left", "right"))
        low, high = bottom.copy(), top.copy()
        most = np.full(len(q), test.most + 1)
        while True:
            on = np.flatnonzero(low < high)
            if not len(on):
                break
            mid = (low[on] + high[on]) // 2
            p, to = self.order[mid], q[on]
            met = self.common(p, to, most[on])
            less = self.codes[p + met] < test.codes[to + met]
            low[on[less]], high[on[~less]] = mid[less] + 1, mid[~less]
        longest = np.zeros(len(q), np.int64)
        for side, there in ((low - 1, low > bottom), (low, low < top)):
            on = np.flatnonzero(there)
            longest[on] = np.maximum(longest[on], self.common(self.order[side[on]], q[on], most[on]))
        found = longest >= test.size[asked]
        return asked[found], longest[found], low[found]

    def interval(self, asked: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the order around ``place`` that shares ``words`` words with test suffixes."""
        q = self.test.starts[asked]
        low, high = (np.searchsorted(self.heads, self.test.codes[q], side) for side in ("left", "right"))
        return self._edge(q, low, place, words, True), self._edge(q, place, high, words, False)

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the intervals one after the other: which interval, and the first word of an occurrence."""
        n = high - low
        of = np.repeat(np.arange(len(n)), n)
        return of, self.word[self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]]

    def row(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, dict[int, list[str]]]:
        """Starts and ends of the hit runs of words, and the items by row."""
        test = self.test
        asked, _, place = self.search()
        _, once = np.unique(test.same[asked], return_index=True)
        asked, place = asked[once], place[once]
        of, word = self.occurrences(*self.interval(asked, place, test.size[asked]))
        ends = word + test.size[asked][of]
        edge = np.zeros(int(self.first[-1]) + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, ends, -1)
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        hit = np.flatnonzero(hit[1:] != hit[:-1])
        items: dict[int, set[str]] = {}
        pairs = np.unique(np.stack([self.row(word), test.group[test.same[asked]][of]]), axis=1)
        for row, group in zip(*pairs.tolist(), strict=True):
            items.setdefault(row, set()).update(test.groups[group])
        return hit[::2], hit[1::2], {row: sorted(some) for row, some in items.items()}


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Test]:
    """The items in blocks of about ``BLOCK_BYTES``; one is in the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        some = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow()
        test = Test(strings(some.column("text")), some.column("id").to_pylist(), window)
        if len(test.starts):
            yield test


def _merged(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([(r["start"], r["end"]) for r in old] + new):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def match_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hits and items after its own columns (of the same names: instead of them).

    hits: the runs of hit words, as indices of words, end exclusive. items: the ids, as
    text and sorted, of the items that have a window in the document.
    """
    spark = docs.sparkSession
    clash = text.lower() in ("n_words", "hits", "items")  # then the text has to outlive the first block's results
    kept = own_name(docs, "text_of_match") if clash else text
    out = docs.withColumn(kept, F.col(text)) if clash else docs

    def searched(test, again: bool):
        def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = strings(batch.column(kept))
            hashes, first = _hashes(texts)
            n = len(texts)
            spans: list[list] = [[] for _ in range(n)]
            items: dict[int, list[str]] = {}
            if test is not None and len(hashes):
                shard = Shard(test.value, hashes, first)
                if len(shard.order):
                    starts, ends, items = shard.hits()
                    for row, start, end in _by_row(starts, ends, first):
                        spans[row].append((start, end))
            listed = [items.get(k, []) for k in range(n)]
            if again:
                spans = [_merged(old, new) if new else [(r["start"], r["end"]) for r in old] for old, new in zip(batch.column("hits").to_pylist(), spans, strict=True)]
                listed = [sorted({*old, *new}) if new else old for old, new in zip(batch.column("items").to_pylist(), listed, strict=True)]
            of_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rows = [[{"start": a, "end": b} for a, b in some] for some in spans]
            return {"n_words": pa.array(np.diff(first)), "hits": pa.array(rows, of_spans), "items": pa.array(listed, pa.list_(pa.string()))}

        return make

    again = False
    for test in _blocks(benchmark, item, item_text, window):
        out, again = with_columns(out, searched(spark.sparkContext.broadcast(test), again), _FOUND), True
    if not again:
        out = with_columns(out, searched(None, False), _FOUND)
    return out.drop(kept) if clash else out


def _by_row(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of runs of words, cut where a row ends and counted from its first word."""
    for start, end, row in zip(starts.tolist(), ends.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist(), strict=True):
        while start < end:
            stop = min(end, int(first[row + 1]))
            if stop > start:
                yield row, start - int(first[row]), stop - int(first[row])
            start, row = stop, row + 1


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    kept = {c: own_name(docs, f"own_{k}") for k, c in enumerate(docs.columns)}
    found = match_documents(docs.withColumnsRenamed(kept), benchmark, kept[text], item, item_text, window)
    return found.where(F.size("hits") == 0).select(*[F.col(k).alias(c) for c, k in kept.items()])


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, position, words, doc, at): the longest verbatim match of every test suffix, a window or more long.

    item: the item's id as text. position: the suffix's first word in the item; suffixes
    shorter than a window aren't listed. words: the length. doc, at: where it is, the
    least document and word of several. Items with repeated ids are listed as one.
    """
    small_batches(docs)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"item string, position long, words long, doc {kind}, at long"
    out = None
    for test in _blocks(benchmark, item, item_text, window):

        def run(batches: Iterator[pa.RecordBatch], held=spark.sparkContext.broadcast(test)) -> Iterator[pa.RecordBatch]:
            for batch in (b for whole in batches for b in parts([whole])):
                hashes, first = _hashes(strings(batch.column(1)))
                if not len(hashes):
                    continue
                shard = Shard(held.value, hashes, first)
                asked, longest, place = shard.search()
                of, word = shard.occurrences(*shard.interval(asked, place, longest))
                row = shard.row(word)
                ranks = pc.rank(batch.column(0), "ascending", null_placement="at_start", tiebreaker="min").to_numpy()[row]
                order = np.lexsort((word - first[row], ranks, of))
                _, best = np.unique(of[order], return_index=True)
                at = order[best]
                source = asked[of[at]]
                yield pa.RecordBatch.from_arrays([pa.array(held.value.ids[held.value.item[source]].tolist(), pa.string()), pa.array(held.value.at[source]), pa.array(longest[of[at]]), batch.column(0).take(pa.array(row[at])), pa.array(word[at] - first[row[at]])], names=["item", "position", "words", "doc", "at"])

        some = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("item", "position").agg(F.min(F.struct((-F.col("words")).alias("less"), "doc", "at")).alias("best"))
    return best.select("item", "position", (-F.col("best.less")).alias("words"), "best.doc", "best.at")


def digests(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    found = match_documents(docs.select(key, "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle() -> str:
    return r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM win),
    dw AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT dw.r, dw.size, dw.i, win.item_id FROM dw JOIN win ON win.size = dw.size AND win.s = dw.s),
    h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
    t AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
    SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r"""
