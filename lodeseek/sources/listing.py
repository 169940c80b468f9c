"""Files below a folder, listed and read by tasks.

Spark's own reader of files keeps an entry for each of them on the driver. Here a task
lists folders and goes on into those it finds, until it has seen ``MOST`` entries; folders
that are left then are dealt to the tasks of the next round. The rounds stand as tables in
the shared folder, and the driver has counts only.
"""

from __future__ import annotations

import errno
import os
import stat
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.sources.shared import shared_dir

ENTRIES = "rel string, folder boolean, bytes long, millis long"
#: Entries after which a task leaves the folders that it finds to the next round; folders dealt to a task; entries of a batch.
MOST, FOLDERS, ROWS = 20_000, 1_024, 4_096
#: Bytes of content that a batch is sent on with, and what opening a file counts for where the session has no setting of its own.
BYTES, OPEN_COST = 4 << 20, 16 << 10


def _passed_over(name: str, folder: bool) -> bool:
    """Whether Spark's readers, too, leave out files or folders of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
    return hidden or name.endswith("._COPYING_")


def _entries(fs: pafs.FileSystem | None, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, milliseconds of its last change); without ``fs`` of a local or mounted folder, entry by entry."""
    if fs is not None:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                known = entry.stat()
            except OSError as e:
                if e.errno in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link to nothing
                    continue
                raise
            yield entry.name, stat.S_ISDIR(known.st_mode), known.st_size, known.st_mtime_ns // 1_000_000


class Tree:
    """A folder: ``name`` as rows have it, ``base`` on its file system, which ``address`` opens (None: local or mounted)."""

    def __init__(self, spark: SparkSession, name: str, base: str, address: str | None = None):
        self.spark, self.name, self.base, self.address = spark, name, base.rstrip("/"), address

    def files(self) -> DataFrame:
        """(url, rel, modificationTime, bytes) of the files that aren't empty."""
        spark, path, rounds = self.spark, f"{shared_dir(self.spark)}/lodeseek-{uuid.uuid4().hex}", []
        todo, left = spark.range(0, 1, 1, 1).select(F.lit("").alias("rel")), 1
        while left:
            rounds.append(f"{path}/{len(rounds)}")
            todo.mapInArrow(_walk(self.address, self.base), ENTRIES).write.parquet(rounds[-1])
            folders = spark.read.schema(ENTRIES).parquet(rounds[-1]).where("folder").select("rel")
            left = folders.count()
            todo = folders.repartition(max(1, min(left, max(spark.sparkContext.defaultParallelism, left // FOLDERS))))
        found = spark.read.schema(ENTRIES).parquet(*rounds).where("not folder")
        return found.select(F.concat(F.lit(f"{self.name}/"), "rel").alias("url"), "rel", F.timestamp_millis("millis").alias("modificationTime"), "bytes")

    def contents(self, rows: DataFrame, wanted: Column) -> DataFrame:
        """``rows`` of ``files`` with ``content`` in place of ``bytes``, null where it isn't ``wanted``.

        Files are dealt to tasks by how many they are and what they hold, as Spark's reader does.
        """
        conf = self.spark._jsparkSession.sessionState().conf()
        opened = conf.filesOpenCostInBytes()
        opened = OPEN_COST if opened == 4 << 20 else opened
        rows = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
        many, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("wanted"), F.col("bytes") + opened)), F.lit(0))).first()
        tasks = max(min(many, self.spark.sparkContext.defaultParallelism), -(-size // conf.filesMaxPartitionBytes()), 1)
        dealt = rows.drop("bytes").repartition(int(tasks), "url")
        made = T.StructType([*dealt.schema.fields, T.StructField("content", T.BinaryType())])
        return dealt.mapInArrow(_read(self.address, self.base, len(self.name)), made).drop("wanted")


def _walk(address: str | None, base: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple[str, bool, int, int]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["rel", "folder", "bytes", "millis"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(address)[0] if address else None
        given = [rel for b in batches for rel in b.column(0).to_pylist()]
        found: list[str] = []
        rows: list[tuple[str, bool, int, int]] = []
        seen = 0
        while given or found and seen < MOST:
            rel = (given or found).pop()
            for name, folder, size, millis in _entries(fs, f"{base}/{rel}".rstrip("/") or "/"):
                seen += 1
                if _passed_over(name, folder):
                    continue
                below = f"{rel}/{name}" if rel else name
                if folder and seen < MOST:
                    found.append(below)
                elif folder or size:
                    rows.append((below, folder, size, millis))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows + [(rel, True, 0, 0) for rel in found])

    return walk


def _read(address: str | None, base: str, named: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the content of the files whose ``url`` is ``named`` characters for the folder and the path below it."""

    def content(fs: pafs.FileSystem | None, path: str) -> bytes:
        with open(path, "rb") if fs is None else fs.open_input_stream(path) as file:
            return file.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(address)[0] if address else None
        for batch in batches:
            at = dict(zip(batch.schema.names, range(batch.num_columns), strict=True))
            start, held, got = 0, 0, []
            for url, wanted in zip(batch.column(at["url"]).to_pylist(), batch.column(at["wanted"]).to_pylist(), strict=True):
                got.append(content(fs, base + url[named:]) if wanted else None)
                held += len(got[-1] or b"")
                if held >= BYTES or start + len(got) == batch.num_rows:
                    part = batch.slice(start, len(got))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*at, "content"])
                    start, held, got = start + len(got), 0, []

    return read


def qualified(spark: SparkSession, root: str) -> tuple[str, str, str]:
    """(scheme, path, whole address) of ``root`` as Spark's readers take it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path)
    return path.toUri().getScheme(), path.toUri().getPath(), path.toString()


def tree(spark: SparkSession, root: str) -> Tree | None:
    """The folder ``root``; None where it isn't one that Python reaches (stores that only Spark reads, patterns of names, single files)."""
    scheme, base, name = qualified(spark, root)
    if scheme == "file":
        return Tree(spark, base.rstrip("/"), base) if os.path.isdir(base) else None
    try:
        fs, base = pafs.FileSystem.from_uri(name)
        return Tree(spark, name.rstrip("/"), base, name) if fs.get_file_info(base).type == pafs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None
