"""Helpers that several operators share: written intermediate tables and numpy views of Arrow text.

``cut`` writes a DataFrame to the folder that executors and driver share and reads it
back, so that a lost executor costs one task and not the whole lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.shared import shared_dir

#: The bytes of ``[\x20\x09-\x0D]``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text bytes that numpy works on at once (a single longer text is taken alone).
SLICE_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEY = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def cut(df: DataFrame, group: int = 0) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``group``: rows of a row group, for rows of megabytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeseek-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.row.count.limit": group} if group else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote; nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def running(sizes: Column) -> Column:
    """For each entry of an array of integers, the sum of those before it.

    In blocks of the root of its size, so the work grows with its 1.5th power; an
    accumulator that carries the sums so far would be copied at every step.
    """
    add = lambda a, x: a + x
    none = F.lit(0).cast("long")

    def within(each: Column, wide: Column) -> Column:
        total = lambda at, n: F.aggregate(F.slice(each, at, n), none, add)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / wide).cast("int")), lambda b: total(b * wide + 1, wide))

        def out(sums: Column) -> Column:
            starts = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), none, add))
            return let(starts, lambda before: F.transform(each, lambda _, i: F.get(before, F.floor(i / wide).cast("int")) + total(i - i % wide + 1, i % wide)))

        return let(blocks, out)

    wide = lambda each: F.ceil(F.sqrt(F.size(each))).cast("int")
    made = let(F.transform(sizes, lambda x: x.cast("long")), lambda each: F.when(F.size(each) > 0, let(wide(each), lambda w: within(each, w))).otherwise(F.array().cast("array<bigint>")))
    return made


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One LargeString array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in a row, and the offsets of the rows in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    raw, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[raw]


def spans_of_words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more at the end).

    kind: for each of the 256 bytes, whether words are made of it.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = kind[raw]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = word[1:-1][edge]
    last[edge - 1] = word[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base of ``prefix_sums`` and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + SLICE_BYTES // 4)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums s with (s[e] - s[b]) * inverse**b a polynomial hash of raw[b:e]."""
    up, _ = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[raw] * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings between ``starts`` and ``ends``."""
    _, down = powers(len(sums) - 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += words[k : k + len(out)]
    return mixed(out)


def table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of numpy arrays, lists or Arrow arrays."""
    arrays = [rows[f.name] if isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
