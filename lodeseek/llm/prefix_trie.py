"""The prefix trie of rebuilt conversations, merged family by family first.

Conversations are in families of ``FAMILY`` ids, and each is rebuilt on the first turns of
its family's base (how many tells a hash of its id). Turns travel as 16-byte digests of
role and text with the text's length. The turns of a family are brought together (the
base's first), read in order, and become a small trie; only its combined nodes, with the
few conversations through them, are shuffled by key and merged to the global trie. A
node's key is the chained digest of its turns.

A node belongs to its smallest member, whose turns from there on are nodes of its own as
well. So a sum over a subtree is a sum over the members of the top: each member tells the
sum over those of its own nodes that lie below. That needs one pass over the families'
chains from the end to the start (a running sum), whatever the depth, and no rounds.

The ids that end at a node are sorted by ranges, joined to pieces of ``PIECE`` bytes and
hashed piece by piece. Families are read row by row, and a family with more than
``NODES`` nodes is sent on in parts, which the merge adds up; a SHA-256 and the chain of a
conversation's digests are sequential, so one conversation is read by one task.

Rows without a conversation id are left out; null roles and texts are empty. Turns are in
order of turn (null first), then role, the text's first 64 characters and the digest.
Repeated rows are turns of their own. The base of a negative id is towards zero, as the
remainder is. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ids of a family; how many lengths of the shared start there are.
FAMILY, STARTS = 5, 9
#: Nodes of a family that are held at once; bytes of ids that are hashed at once.
NODES, PIECE = 50_000, 1 << 20
ROOT = bytes(16)

_NODES = "base long, key binary, parent binary, depth long, bytes long, members array<long>, ends array<long>"


def _turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(base, conv, turn, role, head, mark, bytes), each family in one task, its base first, in order of turns."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    conv = F.col(key).cast("long")
    mark = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col(key).isNotNull()).select((conv - conv % FAMILY).alias("base"), conv.alias("conv"), F.col(turn).alias("turn"), role.alias("role"), F.left(text, F.lit(64)).alias("head"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "head", "mark")


class _Family:
    """The trie of one family while its rows are read."""

    def __init__(self, base: int):
        self.base, self.conv = base, None
        self.first: list[tuple[bytes, int]] = []  # of the base
        self.nodes: dict[bytes, list] = {}

    def _step(self, key: bytes, parent: bytes | None, size: int) -> None:
        self.at = key
        self.nodes.setdefault(key, [parent, self.depth, size, [], []])[3].append(self.conv)

    def _turn(self, mark: bytes, size: int) -> None:
        self.depth += 1
        self._step(hashlib.blake2b(self.at + mark, digest_size=16).digest(), self.at, size)

    def start(self, conv: int) -> None:
        self.end()
        self.conv, self.depth, self.seen = conv, 0, 0
        self._step(ROOT, None, 0)
        self.shared = 0 if conv == self.base else zlib.crc32(str(conv).encode()) % STARTS
        for mark, size in self.first[: self.shared]:
            self._turn(mark, size)

    def add(self, mark: bytes, size: int) -> None:
        if self.conv == self.base and len(self.first) < STARTS - 1:
            self.first.append((mark, size))
        if self.seen >= self.shared:
            self._turn(mark, size)
        self.seen += 1

    def end(self) -> None:
        if self.conv is not None:
            self.nodes.setdefault(self.at, [None, self.depth, 0, [], []])[4].append(self.conv)

    def rows(self) -> Iterator[tuple]:
        for key, (parent, depth, size, members, ends) in self.nodes.items():
            yield self.base, key, parent, depth, size, members, ends
        self.nodes = {}


def _family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["base", "key", "parent", "depth", "bytes", "members", "ends"]
    held: list[tuple] = []

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        held.clear()
        return out

    family = None
    for batch in batches:
        for base, conv, mark, size in zip(*(batch.column(c).to_pylist() for c in ("base", "conv", "mark", "bytes")), strict=True):
            if family is None or base != family.base:
                if family is not None:
                    family.end()
                    held.extend(family.rows())
                family = _Family(base)
            if conv != family.conv:
                family.start(conv)
            family.add(mark, size)
            if len(family.nodes) >= NODES:
                held.extend(family.rows())
            if len(held) >= NODES:
                yield sent()
    if family is not None:
        family.end()
        held.extend(family.rows())
    if held:
        yield sent()


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        now, ids, size = None, [], 0

        def close() -> None:
            if ids:
                rows.append([now, ids[0], ",".join(map(str, ids))])

        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if key != now or size >= PIECE:
                    close()
                    now, ids, size = key, [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "at", "piece"])
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "at", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, found = [], []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        found.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                digest.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    ends = nodes.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv"))
    joined = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, "key binary, at long, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "at").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256.

    conv_id, depth: the smallest member and the number of turns, which name the node.
    parent_conv_id: the smallest member of the node above (root: null). n_convs: members;
    n_children, n_leaves: nodes right below, and nodes without any in the subtree.
    saved_tokens: over the subtree, the UTF-8 bytes of a node's last text for each member
    but one. ends_sha256: of the ids of the members that end here.
    """
    families = cut(_turns(conversations, key, turn, role, text).mapInArrow(_family_nodes, _NODES))
    merged = families.groupBy("key").agg(F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members").cast("long")).alias("n_convs"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"))
    nodes = cut(merged)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    own = nodes.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.col("conv_id").alias("conv"), "depth", F.lit(None).cast("binary").alias("key"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")).where("saved > 0 or leaf > 0")
    chains = families.select("base", F.explode("members").alias("conv"), "depth", "key", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    below = Window.partitionBy("base", "conv").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = chains.unionByName(own).repartition("base").select("key", F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaf")).where("key is not null")
    subtrees = summed.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    told = nodes.join(subtrees, "key").join(_end_digests(families), "key", "left")
    top = nodes.where("depth = 0").select("conv_id").first()
    above = nodes.where("n_children > 0 and depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    parent = F.when(F.col("depth") == 1, F.lit(top and top[0])).otherwise(F.col("above"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return told.join(above, "parent", "left").select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def oracle() -> str:
    return """WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT c, l, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(regexp_extract_all(CAST(c AS VARCHAR), '.'), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h FROM t),
    re AS (SELECT h.c, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
    n AS (SELECT l[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM re) GROUP BY ALL),
    k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    w AS (SELECT n.p, n.d, (n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE strlen(n.p[n.d].t) END AS saved, CAST(n_children IS NULL AS BIGINT) AS leaf FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
    s AS (SELECT p[1:u] AS p, u AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT p, saved, leaf, unnest(range(d + 1)) AS u FROM w) GROUP BY ALL),
    e AS (SELECT l AS p, len(l) AS d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM re GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN s ON s.p = n.p AND s.d = n.d LEFT JOIN k ON k.p = n.p AND k.d = n.d LEFT JOIN e ON e.p = n.p AND e.d = n.d LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""
