"""Data sinks for wiki pages: Markdown files and the state of a synchronisation, visible only once a write has ended well.

Tasks write to a folder of their own below ``.staging``, where scans don't look; a commit on
the driver moves what the tasks that count have written, an abort deletes the job's
staging folder. So a failed task, or one that ran twice, leaves nothing to be seen; a task
that still runs when its job is given up may leave files in the staging folder. ``path`` is a folder or address that the
driver and all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging"
#: Threads that move files at a commit, and files of a part, of which a commit lists one at a time.
MOVES, PART = 16, 4_096


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs, base.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    rows: int


class _Staged(DataSourceWriter):
    """What both sinks share: a folder for the job, one in it for each attempt of a task."""

    def __init__(self, options):
        self.path, self.dry = options["path"], options.get("dryRun", "false").lower() == "true"
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        task, n = uuid.uuid4().hex, 0
        fs, base = _filesystem(self.path)
        for row in iterator:
            if not self.dry:
                self.put(fs, f"{base}/{STAGING}/{self.job}/{task}", row)
            n += 1
        self.close()
        return Written(task, n)

    def put(self, fs: pafs.FileSystem, folder: str, row: Row) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass

    def _clear(self) -> None:
        fs, base = _filesystem(self.path)
        if fs.get_file_info(f"{base}/{STAGING}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{STAGING}/{self.job}")
        if fs.get_file_info(f"{base}/{STAGING}").type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(f"{base}/{STAGING}")):
            fs.delete_dir(f"{base}/{STAGING}")

    def abort(self, messages: list) -> None:
        self._clear()

    def commit(self, messages: list) -> None:
        if not self.dry:
            fs, base = _filesystem(self.path)
            self.publish(fs, base, [f"{base}/{STAGING}/{self.job}/{m.folder}" for m in messages if m is not None and m.rows])
        self._clear()

    def publish(self, fs: pafs.FileSystem, base: str, folders: list[str]) -> None:
        raise NotImplementedError


class _MarkdownWriter(_Staged):
    """A task's folder holds numbered parts."""

    def __init__(self, options):
        super().__init__(options)
        self.made: set[str] = set()
        self.rows = 0

    def put(self, fs: pafs.FileSystem, folder: str, row: Row) -> None:
        if any(part in ("", ".", "..") for part in row.file.split("/")):
            raise ValueError(f"{row.file!r} isn't a path below the folder")
        path = f"{folder}/{self.rows // PART:09d}/{row.file}"
        if self.rows % PART == 0:
            self.made.clear()
        self.rows += 1
        above = path.rpartition("/")[0]
        if above not in self.made:
            fs.create_dir(above, recursive=True)
            self.made.add(above)
        with fs.open_output_stream(path) as out:
            out.write((row.markdown or "").encode())

    def publish(self, fs: pafs.FileSystem, base: str, folders: list[str]) -> None:
        with ThreadPoolExecutor(MOVES) as pool:
            for folder in (part for task in folders for part in sorted(i.path for i in fs.get_file_info(pafs.FileSelector(task)))):
                staged = [i.path for i in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if i.type == pafs.FileType.File]
                above = {(base + path[len(folder) :]).rpartition("/")[0] for path in staged}
                for _ in pool.map(lambda path: fs.create_dir(path, recursive=True), above):
                    pass
                for _ in pool.map(lambda paths, cut=len(folder): [fs.move(path, base + path[cut:]) for path in paths], [staged[at : at + 256] for at in range(0, len(staged), 256)]):
                    pass


class MarkdownSink(DataSource):
    """Format ``markdown``: rows with file (below ``path``) and markdown become files.

    Files that are there already are replaced, others stay. Null markdown is an empty
    file. Of rows with one file name any remains. Option dryRun: nothing is written.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return "file string, markdown string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("mode append only: other files of the folder stay")
        return _MarkdownWriter(self.options)


class _StateWriter(_Staged):
    out = None

    def put(self, fs: pafs.FileSystem, folder: str, row: Row) -> None:
        if self.out is None:
            fs.create_dir(folder, recursive=True)
            self.out = fs.open_output_stream(f"{folder}/part.json")
        now = datetime.now().isoformat(timespec="microseconds")
        self.out.write((json.dumps({"synced_at": now} | row.asDict(True), ensure_ascii=False) + "\n").encode())

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def publish(self, fs: pafs.FileSystem, base: str, folders: list[str]) -> None:
        number = max(_versions(fs, base), default=-1) + 1
        whole = f"{base}/{STAGING}/{self.job}/all"
        fs.create_dir(whole, recursive=True)
        for n, folder in enumerate(folders):
            fs.move(f"{folder}/part.json", f"{whole}/part-{n:05d}.json")
        fs.move(whole, f"{base}/{number:010d}")  # one rename: the version is there whole or not at all


def _versions(fs: pafs.FileSystem, base: str) -> list[int]:
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return []
    return [int(i.base_name) for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory and i.base_name.isdigit()]


class StateSink(DataSource):
    """Format ``pagestate``: the state of a synchronisation as JSON lines, a numbered folder below ``path`` for each run.

    ``newest_state`` reads the last of them. Option dryRun: nothing is written.
    """

    @classmethod
    def name(cls) -> str:
        return "pagestate"

    def schema(self) -> str:
        return "id string, updated string, title string, space string, file string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("mode append only: every run is a version of its own")
        return _StateWriter(self.options)


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of the last run that ended well, as ``operators.pages.load_state`` reads it; empty before the first."""
    from lodeseek.operators import pages

    fs, base = _filesystem(path)
    known = _versions(fs, base)
    return pages.load_state(spark, f"{path.rstrip('/')}/{max(known):010d}") if known else spark.createDataFrame([], pages.STATE)


def register(spark: SparkSession) -> None:
    for sink in (MarkdownSink, StateSink):
        spark.dataSource.register(sink)
