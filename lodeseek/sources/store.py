"""Chunk tables in Parquet: replaced by key and merged on read, partitioned by source, a version at a time."""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "id string, source string, source_id string, space string, title string, url string, acl_groups array<string>, updated_at timestamp, chunk_idx int, heading string, text string, embedding array<float>"
CODE_CHUNKS = "id string, repo string, path string, symbol string, kind string, signature string, doc string, line_start int, line_end int, text string, embedding array<float>"

_NULL = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of a null


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class _Entry:
    """What a version has of a partition: rows (data), deleted keys (delete) or counts (facets); or a stream's last batch.

    folder: below ``root``. leaf: the partition's folder in it. keys: of deleted rows, the
    columns, comma-joined. seq: the version that wrote it; a delete holds for older data.
    """

    kind: str
    value: str | None
    folder: str
    leaf: str
    keys: str
    seq: int


_MANIFEST = "kind string, value string, folder string, leaf string, keys string, seq long"


class Store:
    """A table below ``root``, partitioned by ``partition``, for one writer at a time and many readers.

    An upsert appends its rows and a table of the keys that it replaces; a purge writes
    keys only. Both are as large as the change. A reader merges them: a row is left out if
    its key was deleted after it was written. ``compact`` folds a partition's rows and
    deleted keys to plain rows.

    A version is a list of which folder holds what; it counts once it is in ``versions``,
    where it gets by one rename, and the highest is current. So there is one at any time,
    a reader sees whole tables only, and a crash leaves the last version in force. Of two
    writers at once the later fails with ``Conflict`` (on a store with atomic renames).
    The ``keep`` newest versions stay readable, older ones are deleted with the folders
    that only they use.

    facets: columns whose values are counted with every version, by partition; a write
    counts what it adds and what it replaces, and reads of the old rows only keys and
    these columns, of the partitions it touches.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = CHUNKS, partition: str = "source", keep: int = 2, facets: tuple[str, ...] = ()):
        self.spark, self.root, self.schema, self.partition, self.keep, self.counted = spark, root.rstrip("/"), schema, partition, keep, facets
        self.columns = spark.createDataFrame([], schema).columns

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def versions(self) -> list[int]:
        """The complete versions, ascending."""
        return sorted(int(v) for v in self._names("versions") if "_SUCCESS" in self._names(f"versions/{v}"))

    def exists(self) -> bool:
        return bool(self.versions())

    def _entries(self, version: int) -> list[_Entry]:
        return [_Entry(*r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/versions/{version}").collect()]

    def _folders(self, version: int) -> dict[str | None, str]:
        """The newest data folder of each partition."""
        return {e.value: e.folder for e in sorted(self._entries(version), key=lambda e: e.seq) if e.kind == "data"}

    def _current(self) -> list[_Entry]:
        known = self.versions()
        if known:
            return self._entries(known[-1])
        if self._names("data"):
            raise RuntimeError(f"{self.root} has data but no complete version: its first write has not ended")
        raise LookupError(f"there is no store at {self.root} yet: index something into it first")

    def _head(self) -> tuple[list[int], list[_Entry]]:
        """The versions that there are, and the entries of the last: what a write builds on."""
        known = self.versions()
        return known, self._entries(known[-1]) if known else []

    def _seq(self) -> Column:
        return F.split("batch", "-")[0].cast("long")

    def _rows(self, entries: list[_Entry]) -> DataFrame:
        """The live rows of some partitions: one scan, and an anti-join for each set of columns that rows were deleted by."""
        data = [f"{self.root}/{e.folder}/{e.leaf}" for e in entries if e.kind == "data"]
        if not data:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch string").option("basePath", f"{self.root}/data").parquet(*data).withColumn("batch", self._seq())
        oldest = min(e.seq for e in entries if e.kind == "data")
        for keys in sorted({e.keys for e in entries if e.kind == "delete"}):
            folders = sorted({f"{self.root}/{e.folder}" for e in entries if e.kind == "delete" and e.keys == keys and e.seq > oldest})
            if folders:
                names = keys.split(",")
                listed = self.spark.read.option("basePath", f"{self.root}/deletes").parquet(*folders)
                gone = listed.withColumn("seq", self._seq()).groupBy(*names).agg(F.max("seq").alias("seq"))
                same = [rows[c].eqNullSafe(gone[c]) for c in names]
                rows = rows.join(gone, [*same, rows["batch"] < gone["seq"]], "left_anti")
        return rows.select(*self.columns)

    def read(self) -> DataFrame:
        """The current rows; an error where there is no store."""
        return self._rows(self._current())

    def facets(self, column: str | None = None) -> DataFrame:
        """(column, value, n) of the kept counts, of one column or all; points aren't read."""
        found = self._facets([e for e in self._current() if e.kind == "facets"])
        found = found if column is None else found.where(F.col("column") == column)
        return found.groupBy("column", "value").agg(F.sum("n").alias("n"))

    def _facets(self, entries: list[_Entry]) -> DataFrame:
        kind = "part string, column string, value string, n long"
        folders = [f"{self.root}/{e.folder}/{e.leaf}" for e in entries]
        if not folders:
            return self.spark.createDataFrame([], kind)
        # The folder's own name for the partition would clash with a counted column of that name.
        return self.spark.read.schema(f"{kind}, batch string").option("basePath", f"{self.root}/facets").parquet(*folders).select("part", "column", "value", "n")

    def _count(self, rows: DataFrame, sign: int) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in self.counted])).alias("f")
        return rows.select(F.col(self.partition).cast("string").alias("part"), each).groupBy("part", "f.column", "f.value").agg((F.count("*") * sign).alias("n"))

    def _listed(self, kind: str, folder: str, seq: int) -> list[_Entry]:
        """An entry for each partition of a folder that was written partitioned."""
        leaves = [n for n in self._names(folder) if "=" in n]
        values = [urllib.parse.unquote(n.partition("=")[2]) for n in leaves]
        return [_Entry(kind, None if v == _NULL else v, folder, n, "", seq) for v, n in zip(values, leaves, strict=True)]

    def _commit(self, known: list[int], change: Callable[[int, str], list[_Entry] | None]) -> None:
        """The version after ``known``: what ``change`` (of its number and a name for its folders) writes and returns; None: no new version."""
        number = known[-1] + 1 if known else 0
        batch = f"{number:010d}-{uuid.uuid4().hex[:12]}"
        entries = change(number, batch)
        if entries is None:
            return
        if str(number) in self._names("versions") and number not in self.versions():  # what a crash has left incomplete
            self._delete(f"versions/{number}")
        pending = f"pending/{batch}"
        rows = [(e.kind, e.value, e.folder, e.leaf, e.keys, e.seq) for e in entries]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.root}/{pending}")
        self._publish(pending, number)
        versions = [*known, number]
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {e.folder for v in kept for e in self._entries(v)}
        for v in old:
            for folder in {e.folder for e in self._entries(v)} - used - {""}:
                self._delete(folder)
            self._delete(f"versions/{v}")

    def _publish(self, pending: str, number: int) -> None:
        jvm = self.spark._jvm
        source, _ = self._path(pending)
        target, fs = self._path(f"versions/{number}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            raise Conflict(f"{self.root} has got a version {number} from another writer; this write isn't in force")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # fails where the target exists, also if it came since
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"{self.root} has got a version {number} from another writer; this write isn't in force") from e
            raise

    def _append(self, rows: DataFrame, batch: str, seq: int) -> list[_Entry]:
        folder = f"data/batch={batch}"
        rows.select(*self.columns).write.partitionBy(self.partition).parquet(f"{self.root}/{folder}")
        return self._listed("data", folder, seq)

    def _write_facets(self, counts: DataFrame, batch: str, seq: int) -> list[_Entry]:
        folder = f"facets/batch={batch}"
        kept = counts.groupBy("part", "column", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        kept.withColumn("of", F.col("part")).repartition("of").write.partitionBy("of").parquet(f"{self.root}/{folder}")
        return self._listed("facets", folder, seq)

    def write(self, rows: DataFrame) -> None:
        """Replaces the whole table."""

        def change(seq: int, batch: str) -> list[_Entry]:
            data = self._append(rows, batch, seq)
            return data + (self._write_facets(self._count(self._rows(data), 1), batch, seq) if self.counted else [])

        self._commit(self.versions(), change)

    def upsert(self, rows: DataFrame, keys: tuple[str, ...] = ("source", "source_id"), purge_missing: bool = False, stream: tuple[str, int] | None = None) -> None:
        """Rows of the keys in ``rows`` are replaced; with ``purge_missing``, other keys of the same partitions go too.

        keys: the partition column among them. stream: a name and the number of a batch;
        a batch that is in the store already changes nothing.
        """
        if self.partition not in keys:
            raise ValueError(f"{self.partition} has to be one of the keys")
        known, before = self._head()
        if stream and any(e.kind == "batch" and e.value == stream[0] and e.seq >= stream[1] for e in before):
            return

        def change(seq: int, batch: str) -> list[_Entry] | None:
            data = self._append(rows, batch, seq)
            if not data and not stream:
                self._delete(f"data/batch={batch}")
                return None
            touched = {e.value for e in data}
            old = [e for e in before if e.value in touched and e.kind != "batch"]
            out = [e for e in before if e.value not in touched and e.kind != "batch"]
            out += [e for e in before if e.kind == "batch" and not (stream and e.value == stream[0])]
            out += [_Entry("batch", stream[0], "", "", "", stream[1])] if stream else []
            counts = self._count(self._rows(data), 1) if self.counted else None
            if purge_missing:
                old = []
            elif any(e.kind == "data" for e in old):
                gone = self._rows(data).select(*keys).distinct()
                out += self._delete_keys(gone, keys, touched, batch, seq)
                if self.counted:
                    listed = self.spark.read.parquet(f"{self.root}/deletes/batch={batch}")
                    counts = counts.unionByName(self._facets([e for e in old if e.kind == "facets"])).unionByName(self._count(_semi(self._rows(old), listed, "left_semi"), -1))
            out += [e for e in old if e.kind != "facets"]
            return out + data + (self._write_facets(counts, batch, seq) if self.counted else [])

        self._commit(known, change)

    def _delete_keys(self, gone: DataFrame, keys: tuple[str, ...] | list[str], values: set, batch: str, seq: int) -> list[_Entry]:
        folder = f"deletes/batch={batch}"
        gone.write.parquet(f"{self.root}/{folder}")
        return [_Entry("delete", v, folder, "", ",".join(keys), seq) for v in values]

    def purge(self, wanted: DataFrame) -> None:
        """Deletes the rows whose values in the columns of ``wanted``, the partition column among them, it lists; null equals null."""
        self._current()  # an error where there is no store
        known, before = self._head()
        wanted = wanted.distinct()
        touched = {None if r[0] is None else str(r[0]) for r in wanted.select(self.partition).distinct().collect()} & {e.value for e in before if e.kind == "data"}
        if not touched:
            return
        if wanted.columns == [self.partition]:
            self._commit(known, lambda *_: [e for e in before if e.value not in touched or e.kind == "batch"])
            return
        old = [e for e in before if e.value in touched and e.kind != "batch"]

        def change(seq: int, batch: str) -> list[_Entry]:
            out = self._delete_keys(wanted, wanted.columns, touched, batch, seq)
            if self.counted:
                listed = self.spark.read.parquet(f"{self.root}/deletes/batch={batch}")
                out += self._write_facets(self._facets([e for e in old if e.kind == "facets"]).unionByName(self._count(_semi(self._rows(old), listed, "left_semi"), -1)), batch, seq)
            return out + [e for e in before if e not in old or e.kind != "facets"]

        self._commit(known, change)

    def compact(self, most_deletes: int = 0, most_folders: int = 1) -> list[str | None]:
        """Folds partitions with more than so many tables of deleted keys or data folders to plain rows; which ones."""
        self._current()
        known, before = self._head()
        number = lambda kind: {v: sum(e.kind == kind and e.value == v for e in before) for v in {e.value for e in before if e.kind == "data"}}
        deletes, folders = number("delete"), number("data")
        chosen = {v for v in folders if deletes[v] > most_deletes or folders[v] > most_folders}
        if chosen:
            old = [e for e in before if e.value in chosen and e.kind in ("data", "delete")]
            self._commit(known, lambda seq, batch: [e for e in before if e not in old] + self._append(self._rows(old), batch, seq))
        return sorted(chosen, key=str)

    def vacuum(self) -> None:
        """Deletes what broken-off writes have left; no other writer may be at work."""
        used = {e.folder for v in self.versions() for e in self._entries(v)}
        for kind in ("data", "deletes", "facets"):
            for name in self._names(kind):
                if f"{kind}/{name}" not in used:
                    self._delete(f"{kind}/{name}")
        self._delete("pending")

    def count(self) -> int:
        """How many rows there are; none where there is no store yet."""
        return self.read().count() if self.exists() else 0


def _semi(old: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    same = [old[c].eqNullSafe(listed[c]) for c in listed.columns]
    return old.join(listed, same, how)


def removed(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """``old`` without the rows that ``wanted`` lists by some columns; null equals null."""
    return _semi(old, wanted.distinct(), "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return removed(old, new.select(*keys)).select(*old.columns).unionByName(new.select(*old.columns))


def changed_only(new: DataFrame, old: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """Rows of ``new`` whose text isn't in ``old`` under the same keys."""
    known = old.select(*keys, F.md5(text).alias("digest")).distinct()
    return new.withColumn("digest", F.md5(text)).join(known, [*keys, "digest"], "left_anti").drop("digest")
