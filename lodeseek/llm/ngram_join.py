"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Grouped prefix join. Shingles are ordered by how many documents hold them, rare ones
first. Two sets of similarity t or more share a shingle among the first
``n - ceil(t n) + 1`` of either. Documents with the same size and the same prefix form
one group, which has one posting for each of its prefix shingles; pairs of groups are
filtered by size, position and the number of shared postings, and only then expanded to
the distinct sets in them, which are verified exactly.

The counts are those of all documents, and no table of them is broadcast: documents are
dealt to slices, a slice sends its distinct shingles to ranges of hash values, a range
adds them up and answers each slice with the counts in the order of its question. The
texts are shuffled once, for both the question and the use of the answer. A shingle that
only one document holds can't be shared and gets no posting.

A posting list of m groups is not expanded to its m (m - 1) / 2 pairs. A few rounds verify
neighbours in differently shuffled orders of the list, and of the sets of a group; their
links give provisional components, and only pairs that lie across two components go on.
Pairs inside a component cannot change it, so the components are those of all links.
Pairs are held against parity sketches, whose Hamming distance bounds the symmetric
difference from below: while groups of one set are paired, of 256 bits and, in lists of
more than ``LONG`` groups, of 1,024 bits; of 2,048 bits before two sets are compared.

Words are runs of non-space bytes after lower-casing A-Z. A document of fewer words than
the shingle size has its whole word sequence as its only shingle; one without words, or
null, has an empty set and links with nothing. Sets are told apart by 126 bits of digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import small_batches
from .common import cut, lower, mixed, own_name, prefix_sums, release, slices, span_hashes, spans_of_words, strings, window_hashes
from .components import connected_components

#: Text bytes of a slice, and shingles of a range, on average.
SLICE, RANGE = 4 << 20, 1 << 20
#: Text bytes for each shingle, about; only the number of ranges depends on it.
PER_SHINGLE = 6
#: 64-bit words of a parity sketch.
SKETCH = 32
#: Columns of the small parity sketch.
SMALL = ("s0", "s1", "s2", "s3")
#: Columns of the sketch that postings of long lists carry: half of ``SKETCH``, as the other half is folded onto it.
WIDE = tuple(f"w{k}" for k in range(SKETCH // 2))
#: Shuffled orders whose neighbours are verified before the rest, and how far apart those may be.
ROUNDS, NEAR = 3, 3
#: Posting lists of more groups go through the rounds first; so many of a list are put in order at once.
LONG, CHUNK = 8, 4096
#: Groups of a posting list that meet in one block; a longer list is paired block by block.
LIST_BLOCK = 1024


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, raw, offsets in slices(strings(column)):
        raw = lower(raw)
        starts, ends, first = spans_of_words(raw, offsets)
        words = span_hashes(prefix_sums(raw), starts, ends)
        runs = window_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def _needed(n: int, percent: int) -> int:
    """The least k with 100 k >= percent n."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set, as keys that sort by (scaled) count and then by hash."""
    keys = np.sort((often.astype(np.uint64) << np.uint64(55)) | (found >> np.uint64(9)))
    return keys[: len(keys) - _needed(len(keys), percent) + 1]


def _digest(values: np.ndarray, salt: int) -> int:
    """An order-sensitive 63-bit hash of an array."""
    h = mixed(values + np.uint64(salt)) * mixed(np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(2 * salt + 1))
    return int(mixed(np.array([int(h.sum(dtype=np.uint64)) ^ len(values)], np.uint64))[0] >> np.uint64(1))


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a log scale in a byte: 0 for 1, 12 more each time they double."""
    return np.minimum(255, np.round(12 * np.log2(counts))).astype(np.uint8)


def _asked(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct leading ``32 + bits`` bits of the hashes, how often each); the first ``bits`` tell the range."""
    return np.unique(found >> np.uint64(32 - bits), return_counts=True)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of an array, which compress better than the values."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _values(data: pa.Buffer, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _small_sketch(found: np.ndarray) -> np.ndarray:
    """256 parities of a set as four 64-bit values; they differ at no more places than the sets do."""
    bits = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketch(found: np.ndarray) -> bytes:
    bits = np.bincount((mixed(found) >> np.uint64(53)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _counted(sliced: DataFrame, size: int, bits: int) -> DataFrame:
    """(slice, part, scaled): for each range of a slice's distinct shingles, in order, in how many documents they are."""

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [s for b in batches for s in shingle_sets(b.column("text"), size)]
        keys, times = _asked(np.concatenate(found), bits)
        part = (keys >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)) if len(keys) else []
        low = [_planes(keys[a:b].astype("<u4")) for a, b in spans]
        each = [_planes(np.minimum(times[a:b], 65_535).astype("<u2")) for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(spans), pa.int64()), pa.array(part[first]), pa.array(low, pa.binary()), pa.array(each, pa.binary())], names=["slice", "part", "low", "times"])

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        low = [_values(x.as_buffer(), "<u4") for x in got.column("low")]
        times = np.concatenate([_values(x.as_buffer(), "<u2") for x in got.column("times")])
        _, of = np.unique(np.concatenate(low), return_inverse=True)
        scaled = _scaled(np.bincount(of, times))[of]
        ends = np.cumsum([len(x) for x in low]).tolist()
        told = [scaled[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*[got.column(c).combine_chunks() for c in ("slice", "part")], pa.array(told, pa.binary())], names=["slice", "part", "scaled"])

    questions = sliced.groupBy("slice").applyInArrow(ask, "slice long, part int, low binary, times binary")
    return questions.groupBy("part").applyInArrow(answer, "slice long, part int, scaled binary")


def _profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row a document: key, mark, n (set size), id and check (of the set), grp (size and prefix), slice, and with postings:

    tokens and places (prefix shingles of other documents, too; once for each group of a
    slice), sketch, s0..s3 and shingles (once for each set of a slice).
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(31, max(0, (total // (PER_SHINGLE * RANGE)).bit_length()))
    sliced = docs.withColumn("slice", F.pmod(F.xxhash64("key", "mark"), F.lit(total // SLICE + 1)))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("n", "id", "check", "grp", "tokens", "places", "sketch", "shingles", *SMALL)}
        sets = [s for b in left.select(["text"]).to_batches() for s in shingle_sets(b.column(0), size)]
        keys, _ = _asked(np.concatenate(sets), bits) if sets else (None, None)
        right = right.sort_by("part")
        told = np.frombuffer(b"".join(right.column("scaled").to_pylist()), np.uint8)
        if sets and len(told) != len(keys):
            raise RuntimeError("a slice has changed between its question and the answer")
        groups, seen = set(), set()
        for found in sets:
            row = dict.fromkeys(out) | {"n": len(found), "id": _digest(found, 11), "check": _digest(found, 12)}
            if len(found):
                often = told[np.searchsorted(keys, found >> np.uint64(32 - bits))]
                first = prefix(found, often, percent)
                row["grp"] = grp = _digest(first, len(found))
                common = np.flatnonzero(first >> np.uint64(55))
                if len(common) and grp not in groups:
                    groups.add(grp)
                    row |= {"tokens": first[common].astype(np.int64), "places": common.astype(np.int32)}
                if len(common) and row["id"] not in seen:
                    seen.add(row["id"])
                    row |= {"sketch": _sketch(found), "shingles": found.astype("<u8").tobytes()} | dict(zip(SMALL, _small_sketch(found).tolist(), strict=True))
            for c, x in out.items():
                x.append(row[c])
        made = [pa.array(out[f.name], f.type) for f in schema]
        return pa.table([left.column("key"), left.column("mark"), left.column("slice"), *made], names=["key", "mark", "slice", *schema.names])

    long, int_ = pa.int64(), pa.int32()
    schema = pa.schema([("n", long), ("id", long), ("check", long), ("grp", long), ("tokens", pa.list_(long)), ("places", pa.list_(int_)), ("sketch", pa.binary()), ("shingles", pa.binary()), *((c, long) for c in SMALL)])
    kind = docs.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, mark long, slice long, n long, id long, check long, grp long, tokens array<long>, places array<int>, sketch binary, shingles binary, s0 long, s1 long, s2 long, s3 long"
    return sliced.groupBy("slice").cogroup(_counted(sliced, size, bits).groupBy("slice")).applyInArrow(run, ddl)


def _linked(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) of sets that have a similarity of ``percent`` or more."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH) for c in ("sa", "sb"))
            apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
            common = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            fit = 100 * common >= percent * (na + nb - common)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(fit))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([left, right]))
                common = int((both[1:] == both[:-1]).sum())
                fit.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))

    def both(of: DataFrame, column: str) -> DataFrame:
        left = bodies.select(F.col("id").alias("a"), F.col(column).alias("sa"))
        right = bodies.select(F.col("id").alias("b"), F.col(column).alias("sb"))
        return of.join(left, "a").join(right, "b")

    close = cut(both(pairs, "sketch").mapInArrow(near, "a long, b long"))
    linked = cut(both(close, "shingles").mapInArrow(same, "a long, b long"))
    release(close)
    return linked


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b, of rows (id, n, id_p, n_p)."""
    low = F.col("id") < F.col("id_p")
    return rows.select(F.least("id", "id_p").alias("a"), F.greatest("id", "id_p").alias("b"), F.when(low, F.col("n")).otherwise(F.col("n_p")).alias("na"), F.when(low, F.col("n_p")).otherwise(F.col("n")).alias("nb")).distinct()


def _sizes_fit(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _neighbours(lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, id_p, n_p) of entries (list, length, id, n) that are next to each other in shuffled order ``k`` of a list."""
    mixed_up = F.xxhash64("id", F.lit(k))
    chunk = F.pmod(F.xxhash64("id", F.lit(-1 - k)), F.ceil(F.col("length") / CHUNK).cast("long"))
    w = Window.partitionBy("list", "chunk").orderBy("mixed_up", "id")
    prior = lists.withColumn("chunk", chunk).withColumn("mixed_up", mixed_up).select("id", "n", F.array(*[F.lag(F.struct("id", "n"), j).over(w) for j in range(1, NEAR + 1)]).alias("before")).select("id", "n", F.explode("before").alias("p"))
    return prior.where("p is not null and id <> p.id").select("id", "n", F.col("p.id").alias("id_p"), F.col("p.n").alias("n_p")).where(_sizes_fit(percent, "n", "n_p"))


def _wide(groups: DataFrame, bodies: DataFrame) -> DataFrame:
    """``groups`` (grp, id) with the columns ``WIDE`` of their sets' sketches."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64).reshape(-1, SKETCH)
            half = whole[:, : len(WIDE)] ^ whole[:, len(WIDE) :]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), *[pa.array(np.ascontiguousarray(x)) for x in half.T]], names=["grp", *WIDE])

    return groups.join(bodies, "id").select("grp", "sketch").mapInArrow(fold, ", ".join(f"{c} long" for c in ("grp", *WIDE)))


def _across(postings: DataFrame, of_group: DataFrame) -> DataFrame:
    """Postings with what is known of their groups, of the lists that hold more than one component."""
    p = postings.join(of_group, "grp")
    split = p.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("token")
    return p.join(split, "token", "left_semi")


def _met(p: DataFrame, sketches: tuple[tuple[str, ...], ...], percent: int) -> DataFrame:
    """(grp_a, grp_b, n_a, n_b, pos_a, pos_b) for each list of ``p`` in which two groups meet that one shared shingle and the sketches leave.

    sketches: each is a set of columns whose bits are held against the sizes; null lets a pair pass.

    The list of a token with more than ``LIST_BLOCK`` groups is cut by ranges of set sizes,
    of which only a range and its neighbours can hold similar sets, and by hash into parts;
    each pair of parts is a key of its own, so a long list is spread over many tasks.
    """
    parts = F.ceil(F.col("length") / LIST_BLOCK).cast("int")
    ratio = 1.0001 * math.log(100 / percent) if percent < 100 else 1.0  # similar sizes are in one range or in neighbours
    size = F.when(parts > 1, F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")).otherwise(0)
    p = p.withColumns({"parts": parts, "size": size, "part": F.pmod(F.xxhash64("grp"), parts).cast("int")})
    upto = F.sequence(F.lit(0), F.col("parts") - 1)
    around = F.when(F.col("parts") > 1, F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).otherwise(F.array(F.lit(0)))
    kept = ("grp", "n", "pos", "low", "high", *[c for s in sketches for c in s])
    a = p.select("token", "size", F.col("part").alias("i"), F.explode(upto).alias("j"), *[F.col(x).alias(f"{x}_a") for x in kept])
    b = p.select("token", F.explode(around).alias("size"), "parts", "part", *kept).select("token", "size", F.explode(upto).alias("i"), F.col("part").alias("j"), *[F.col(x).alias(f"{x}_b") for x in kept])
    most = "(least(pos_a, pos_b) + 1 + least(n_a - pos_a - 1, n_b - pos_b - 1))"
    across = "grp_a < grp_b and least(low_a, low_b) < greatest(high_a, high_b)"
    apart = [" + ".join(f"bit_count({c}_a ^ {c}_b)" for c in s) for s in sketches]
    near = [F.expr(f"coalesce({100 + percent} * ({x}) <= {100 - percent} * (n_a + n_b), true)") for x in apart]
    met = a.join(b, [*[a[c] == b[c] for c in ("token", "size", "i", "j")], F.expr(across), F.expr(_sizes_fit(percent, "n_a", "n_b")), F.expr(_enough(percent, most)), *near])
    return met.select("grp_a", "grp_b", "n_a", "n_b", "pos_a", "pos_b")


def _enough(percent: int, common: str) -> str:
    return f"{common} * {100 + percent} >= {percent} * (n_a + n_b)"


def _group_pairs(p: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(grp_a, grp_b) of groups in ``p`` (see ``_across``) that the filters leave and whose sets are not all in one component.

    With c shared prefix shingles, the last of them at positions i and j, two sets share
    c + min(n - i - 1, m - j - 1) shingles at most; each shared shingle alone bounds the
    overlap by min(i, j) + 1 + min(n - i - 1, m - j - 1). Sketches are those of groups
    that consist of one set. Sets of a template meet on most of its shingles and are alike
    for a small sketch, so in long lists, whose pairs grow with their square, they are held
    against the wide one as well.
    """
    short, long = p.where(F.col("length") <= LONG), p.where(F.col("length") > LONG)
    wide = _wide(long.where("id is not null").select("grp", "id").distinct(), bodies)
    met = _met(short, (SMALL,), percent).unionByName(_met(long.join(wide, "grp", "left"), (SMALL, WIDE), percent))
    pairs = met.groupBy("grp_a", "grp_b", "n_a", "n_b").agg(F.count("*").alias("shared"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    return pairs.where(_enough(percent, "(shared + least(n_a - pos_a - 1, n_b - pos_b - 1))")).select("grp_a", "grp_b")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows with key, mark, n and id of the set; sets with id, key, mark and their component c)."""
    small_batches(docs)
    rows = cut(_profiles(docs, size, percent))
    # Distinct sets, each with the row that stands for it; copies of a set need no comparison.
    best = F.min(F.struct(F.col("key").isNull().alias("unkeyed"), "key", "mark")).alias("first")
    sets = cut(rows.where("n > 0").groupBy("id", "check", "n", "grp").agg(best, F.min(F.when(F.col("shingles").isNotNull(), F.col("slice"))).alias("slice"), *[F.min(c).alias(c) for c in SMALL]).select("id", "n", "grp", "slice", *SMALL, "first.key", "first.mark"))
    every = rows.where("tokens is not null").select("grp", "n", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "grp", "n", F.col("x.places").alias("pos")).distinct()
    lists = every.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    postings = cut(every.join(lists, "token"))
    groups = sets.groupBy("grp").agg(F.count("*").alias("length"), F.min("id").alias("id"))
    several = groups.where("length > 1").select(F.col("grp").alias("list"), "length")
    met = postings.select("grp").distinct().unionByName(several.select(F.col("list").alias("grp"))).distinct()
    wanted = sets.join(met, "grp", "left_semi").select("id", "slice")
    bodies = cut(rows.where("shingles is not null").select("id", "slice", "sketch", "shingles").join(wanted, ["id", "slice"]))
    listed = postings.where(F.col("length") > LONG).join(groups.select("grp", "id"), "grp").select(F.col("token").alias("list"), "length", "id", "n")
    inside = sets.withColumnRenamed("grp", "list").join(several, "list").select("list", "length", "id", "n")
    some = cut(listed.unionByName(inside))
    near = reduce(DataFrame.unionByName, [_neighbours(some, k, percent) for k in range(ROUNDS)])
    links = _linked(_pairs(near), bodies, percent)
    provisional = connected_components(links).withColumnRenamed("component", "c")
    members = cut(sets.join(met, "grp", "left_semi").select("grp", "id", "n", *SMALL).join(provisional, "id", "left").withColumn("c", F.coalesce("c", "id")))
    of_group = members.groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high"), *[F.when(F.count("*") == 1, F.min(c)).alias(c) for c in ("id", *SMALL)])
    torn = of_group.where("low < high").select(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b"))
    across = cut(_across(postings, of_group))
    pairs = cut(_group_pairs(across, bodies, percent).unionByName(torn))
    a, b = (members.select(*[F.col(x).alias(f"{x}_{side}") for x in ("grp", "id", "n", "c")]) for side in "ab")
    expanded = pairs.join(a, "grp_a").join(b, "grp_b").where("c_a <> c_b and (grp_a <> grp_b or id_a < id_b)")
    rest = _linked(_pairs(expanded.select(F.col("id_a").alias("id"), F.col("n_a").alias("n"), F.col("id_b").alias("id_p"), F.col("n_b").alias("n_p"))), bodies, percent)
    of = connected_components(links.unionByName(rest)).withColumnRenamed("component", "c")
    classes = cut(sets.select("id", "key", "mark").join(of, "id", "left").withColumn("c", F.coalesce("c", "id")))
    release(sets, postings, bodies, some, links, members, across, pairs, rest)
    return rows.select("key", "mark", "n", "id"), classes


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``.

    key: a long column. component_id is the smallest key reachable by links of similarity
    ``percent`` / 100 or more, the row's own included; a row with a null key stays null
    where it is linked with no other. Rows with one key and different texts are documents
    of their own.
    """
    rows, classes = _classes(_keyed(docs, key, text), size, percent)
    least = classes.groupBy("c").agg(F.min("key").alias("component_id"))
    named = classes.join(least, "c").select("id", "component_id")
    out = rows.withColumn("set_id", F.when(F.col("n") > 0, F.col("id"))).join(named.withColumnRenamed("id", "set_id"), "set_id", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class, the row with the least key stays.

    Rows without words are no duplicates of anything and all stay. Null keys come last.
    """
    _, classes = _classes(_keyed(docs, key, text), size, percent)
    best = F.min(F.struct(F.col("key").isNull().alias("unkeyed"), "key", "mark")).alias("best")
    kept = classes.groupBy("c").agg(best).select(F.coalesce("best.key", F.lit(0)).alias("at"), "best.unkeyed", "best.mark")
    by = ["at", "unkeyed", "mark"]
    kept = kept.withColumnsRenamed(dict(zip(by, names := [own_name(docs, f"class_{c}") for c in by], strict=True)))
    row = docs.withColumns(dict(zip(names, (F.coalesce(key, F.lit(0)), F.col(key).isNull(), F.xxhash64(text)), strict=True)))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = row.where(worded).join(kept, names, "left_semi").dropDuplicates(names)
    return once.unionByName(row.where(~worded)).select(*docs.columns)
