"""Quality rules, and an isolation forest over their statistics.

Each text gets counts (words, symbols, repeated lines and words, capitals, ...) in
one pass over its bytes. Fixed rules reject some; the rest is judged by an isolation
forest on ratios of the counts: over random splits, an anomalous document is alone after
a short path. Trees are grown from labelled rows, few of them bad, and the threshold is
the one that rejects most bad labelled rows among those that reject at most
``MAX_LOSS`` of the good ones.

Trees draw their rows from all labelled rows, and the threshold is set on the scores of all
of them. Without any labelled row the forest rejects nothing. A null text is empty; rows
that repeat are judged alike; null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import with_columns
from .common import _IS_WORD, cut, mixed, own_name, prefix_sums, release, slices, span_hashes, spans_of_words, strings, window_hashes

#: Labelled rows up to which the driver grows the forest; more are drawn, grown and scored by tasks.
LOCAL = 8192
#: Steps of a score of 1 in which the scores of more rows are counted, and types of a tree's arrays.
GRID, _KINDS = 1 << 16, (np.int8, np.float64, np.int32, np.float32)
#: Trees, rows of each, and the share of bad rows among them.
TREES, TREE_ROWS, BAD_SHARE = 200, 2048, 0.005
#: Good labelled rows that the threshold may reject.
MAX_LOSS = 0.005
#: Fixed rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _CAPITAL, _MARK = (_table(x) for x in (SYMBOLS, bytes(range(65, 91)), b".,;:!?"))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets])


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row; ``keys`` differ between rows."""
    return np.bincount(row[np.unique(keys, return_index=True)[1]], minlength=rows)


def _lines(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines that hold a word."""
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(raw)]
    if not len(starts):
        return starts, starts, starts
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10)
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    return starts[full], ends[full], np.searchsorted(offsets, starts[full], "right") - 1


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, raw, offsets in slices(strings(column)):
        rows = len(offsets) - 1
        sums = prefix_sums(raw)
        starts, ends, first = spans_of_words(raw, offsets)
        of_row = np.repeat(np.arange(rows), np.diff(first))
        salt = mixed(np.arange(1, rows + 1, dtype=np.uint64))
        words = span_hashes(sums, starts, ends)
        got = {"n_words": np.diff(first), "n_distinct_words": _distinct(words ^ salt[of_row], of_row, rows)}
        got["word_chars"] = _per_row(_IS_WORD[raw] & ((raw & 0xC0) != 0x80), offsets)
        for name, flags in (("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_marks", _MARK)):
            got[name] = _per_row(flags[raw], offsets)
        a, b, row = _lines(raw, offsets, starts)
        got["n_lines"] = np.bincount(row, minlength=rows)
        got["n_dup_lines"] = got["n_lines"] - _distinct(span_hashes(sums, a, b) ^ salt[row], row, rows)
        twice = np.zeros(len(words) + 2, bool)
        windows = window_hashes(words, 3)
        if len(windows):
            inside = of_row[: len(windows)] == of_row[2:]
            at = np.flatnonzero(inside)
            _, which, times = np.unique(windows[at] ^ salt[of_row[at]], return_inverse=True, return_counts=True)
            at = at[times[which] > 1]
            for k in range(3):
                twice[at + k] = True
        got["n_repeat_words"] = _per_row(twice[: len(words)], first)
        for c in COUNTS:
            out[c].append(got[c])
    return {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``COUNTS`` (long); columns of these names are replaced."""
    return with_columns(docs, lambda batch: {c: pa.array(v.astype(np.int64)) for c, v in text_counts(batch.column(text)).items()}, ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that hardly depend on the length of a text.

    Repeated lines and digits are left out: licences and telephone numbers make them
    frequent in good texts too.
    """
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(1, c["n_words"]), np.maximum(1, c["word_chars"]), np.maximum(1, c["n_lines"])
    return np.column_stack(
        [
            c["word_chars"] / words,
            np.sqrt(c["n_symbols"] / words),
            np.sqrt(c["n_repeat_words"] / words),
            np.sqrt(c["n_capitals"] / chars),
            c["n_marks"] / words,
            np.log1p(words / lines),
            c["n_distinct_words"] / np.power(words, 0.8),
        ]
    )


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = np.asarray(counts["n_words"])
    return (n < MIN_WORDS) | (100 * np.asarray(counts["n_repeat_words"]) > MAX_REPEAT_PERCENT * n)


def _average_path(n: float) -> float:
    """The mean path to a leaf of a random tree over n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as arrays: the feature (-1: leaf), the value to split at, the left child, and the path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    scale: float
    threshold: float = np.inf

    @staticmethod
    def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
        feature, value, left, path, todo = [0], [0.0], [0], [0.0], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or not len(open_):
                feature[node], path[node] = -1, level + _average_path(len(rows))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            below = x[rows, f] <= cut
            for side in (rows[below], rows[~below]):
                todo.append((len(feature), side, level + 1))
                for column, start in ((feature, 0), (value, 0.0), (left, 0), (path, 0.0)):
                    column.append(start)
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    @classmethod
    def fit(cls, x: np.ndarray, bad: np.ndarray, seed: int = 0) -> IsolationForest:
        """Trees over random rows of ``x``, of which ``BAD_SHARE`` are bad as far as there are any."""
        rng = np.random.default_rng(seed)
        good_at, bad_at = np.flatnonzero(~bad), np.flatnonzero(bad)
        n = min(TREE_ROWS, len(x))
        few = min(len(bad_at), max(1, round(BAD_SHARE * n))) if len(good_at) else n
        trees = []
        for _ in range(TREES):
            rows = np.concatenate([rng.choice(bad_at, min(few, len(bad_at)), replace=False), rng.choice(good_at, min(n - few, len(good_at)), replace=False)])
            trees.append(cls._grow(x[rows], rng, 3 * int(np.ceil(np.log2(max(2, n)))) // 2))
        return cls(trees, max(1e-9, _average_path(n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that are alone soon."""
        wide = max(len(t[0]) for t in self.trees)
        feature, value, left, path = (np.stack([np.pad(t[k], (0, wide - len(t[k]))) for t in self.trees]).ravel() for k in range(4))
        roots = np.arange(len(self.trees)) * wide
        out = np.empty(len(x))
        for at in range(0, len(x), 256):  # all trees at once, some rows at a time
            some = x[at : at + 256]
            row = np.repeat(np.arange(len(some)), len(roots))
            node, base = np.tile(roots, len(some)), np.tile(roots, len(some))
            going = np.arange(len(node))
            while len(going):
                going = going[feature[node[going]] >= 0]
                n = node[going]
                node[going] = base[going] + left[n] + (some[row[going], feature[n]] > value[n])
            out[at : at + 256] = path[node].reshape(len(some), -1).mean(1)
        return 2.0 ** (-out / self.scale)

    def calibrate(self, x: np.ndarray, bad: np.ndarray) -> None:
        """The least threshold over which at most ``MAX_LOSS`` of the good rows score; none without bad rows."""
        score = self.score(x)
        good = np.sort(score[~bad])
        if not bad.any() or not len(good):
            return
        floor = good[max(0, int(np.ceil(len(good) * (1 - MAX_LOSS))) - 1)]
        cuts = np.unique(score[score >= floor])
        if not len(cuts):
            return
        # Of the cuts allowed, the one with the most rejected bad rows less rejected good rows; the higher one in ties.
        gain = [(score[bad] > c).mean() - (score[~bad] > c).mean() for c in cuts]
        best = len(cuts) - 1 - int(np.argmax(gain[::-1]))
        above = score[score > cuts[best]]
        self.threshold = float((cuts[best] + above.min()) / 2) if len(above) else float(cuts[best])


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, counts) of all rows, written."""
    return cut(with_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text"))


def fit_forest(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> IsolationForest | None:
    """A forest and its threshold from all labelled rows; None where no labelled row has a document."""
    rows = _counted(docs, key, text)
    forest = _fitted(rows, labels, key, quality)
    release(rows)
    return forest


def _fitted(rows: DataFrame, labels: DataFrame, key: str, quality: str) -> IsolationForest | None:
    """``fit_forest`` on rows (key, counts); many labelled rows stay on the executors."""
    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(quality).alias("quality"))
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    met = cut(rows.where(passed).join(known, "key").select("key", *COUNTS, (F.col("quality") == 0).alias("bad")))
    good, bad = met.agg(F.count_if(~F.col("bad")), F.count_if("bad")).first()
    if good + bad > LOCAL:
        forest = _spread(met, good, bad)
    elif good + bad:
        some = met.orderBy(F.xxhash64("key"), "key", *COUNTS).toArrow()
        x, of = features({c: some.column(c).to_numpy() for c in COUNTS}), some.column("bad").to_numpy().astype(bool)
        forest = IsolationForest.fit(x, of)
        forest.calibrate(x, of)
    else:
        forest = None
    release(met)
    return forest


def _spread(rows: DataFrame, good: int, bad: int, seed: int = 0) -> IsolationForest:
    """A forest of which each tree draws its rows from all ``rows`` (key, counts, bad) and is grown by one task.

    A row's draw for a tree is a hash of the row and the tree; those with the least values
    are taken. The threshold comes from the scores of all rows, counted in steps of 1 / GRID.
    """
    spark, n = rows.sparkSession, min(TREE_ROWS, good + bad)
    few = min(bad, max(1, round(BAD_SHARE * n))) if good else n
    wanted, there = np.array([min(n - few, good), few]), np.array([good, bad])
    limit = np.minimum(1.0, (wanted + 8 * np.sqrt(wanted) + 32) / np.maximum(1, there))
    size = features({c: np.zeros(0) for c in COUNTS}).shape[1]
    names = [f"x{k}" for k in range(size)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            of, row = batch.column("bad").to_numpy(zero_copy_only=False).astype(bool), batch.column("row").to_numpy().view(np.uint64)
            most = limit[of.astype(np.int64)]
            for tree in range(TREES):
                place = (mixed(row ^ mixed(np.array([seed * TREES + tree + 1], np.uint64))) >> np.uint64(11)) / 2.0**53
                at = np.flatnonzero(place < most)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(place[at]), pa.array(of[at]), *[pa.array(x[at, k]) for k in range(size)]], names=["tree", "place", "bad", *names])

    def grow(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([(c, "ascending") for c in ("bad", "place", *names)])
        of = batch.column("bad").to_numpy().astype(bool)
        at = np.concatenate([np.flatnonzero(of)[: wanted[1]], np.flatnonzero(~of)[: wanted[0]]])
        x = np.column_stack([batch.column(c).to_numpy() for c in names])[at]
        tree = IsolationForest._grow(x, np.random.default_rng([seed, key[0].as_py()]), 3 * int(np.ceil(np.log2(max(2, n)))) // 2)
        cells = [x.astype(kind).tobytes() for x, kind in zip(tree, _KINDS, strict=True)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["tree", "feature", "value", "left", "path"])

    drawn = rows.withColumn("row", F.xxhash64("key", *COUNTS)).mapInArrow(draw, "tree int, place double, bad boolean, " + ", ".join(f"{c} double" for c in names))
    grown = drawn.groupBy("tree").applyInArrow(grow, "tree int, feature binary, value binary, left binary, path binary").orderBy("tree").collect()
    forest = IsolationForest([tuple(np.frombuffer(r[c], kind) for c, kind in zip(("feature", "value", "left", "path"), _KINDS, strict=True)) for r in grown], max(1e-9, _average_path(n)))
    shared = spark.sparkContext.broadcast(forest)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(features({c: batch.column(c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([batch.column("bad"), pa.array(np.ceil(score * GRID).astype(np.int32))], names=["bad", "step"])

    steps = rows.mapInArrow(rate, "bad boolean, step int").groupBy("step").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")).orderBy("step").toArrow()
    forest.threshold = _threshold(*(steps.column(c).to_numpy() for c in ("step", "good", "bad")))
    shared.destroy()
    return forest


def _threshold(step: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """``IsolationForest.calibrate`` on counts of rows whose scores are above (step - 1) / GRID, at most step / GRID."""
    if not good.sum() or not bad.sum():
        return np.inf
    first = int(np.searchsorted(np.cumsum(good), max(1, int(np.ceil(good.sum() * (1 - MAX_LOSS))))))
    over = lambda x: (x.sum() - np.cumsum(x))[first:] / x.sum()
    gain = over(bad) - over(good)
    best = first + len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float(step[best] + step[best + 1] - 1) / 2 / GRID if best + 1 < len(step) else float(step[best]) / GRID


def _verdicts(counts: dict[str, np.ndarray], model: IsolationForest | None) -> dict[str, pa.Array]:
    failed = base_failed(counts)
    score = model.score(features(counts)) if model else None
    out = {"base_failed": pa.array(failed), "anomaly": pa.nulls(len(failed), pa.float64()) if score is None else pa.array(score)}
    return out | {"kept": pa.array(~failed if score is None else ~failed & (score <= model.threshold))}


_VERDICTS = "base_failed boolean, anomaly double, kept boolean"


def judge(docs: DataFrame, forest: IsolationForest | None, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, ``base_failed``, ``anomaly`` (null without a forest) and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts = text_counts(batch.column(text))
        return {c: pa.array(v.astype(np.int64)) for c, v in counts.items()} | _verdicts(counts, shared.value)

    return with_columns(docs, make, ", ".join(f"{c} long" for c in COUNTS) + f", {_VERDICTS}")


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    row = own_name(docs, "row")
    rows = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias(row))
    return judge(rows, fit_forest(docs, labels, key, text)).where("kept").select(f"{row}.*")


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of the rules, base_failed, kept and the anomaly score; texts are read once."""
    rows = _counted(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(_fitted(rows, labels, "doc_id", "quality"))
    judged = with_columns(rows, lambda batch: _verdicts({c: batch.column(c).to_numpy() for c in COUNTS}, shared.value), _VERDICTS)
    return judged.select(F.col("key").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", "anomaly")
