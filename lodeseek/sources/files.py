"""Scans of document folders and of folders of repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import DEFAULTS, DOC_EXTENSIONS
from lodeseek.functions.text import forward_slashes, strip
from lodeseek.operators.chunking import asciidoc_to_markdown
from lodeseek.operators.code_chunks import admitted, skipped
from lodeseek.sources import listing


#: What opening a file counts for when files are dealt to tasks, in bytes.
OPEN_COST = 64 << 10


def _small_files(spark: SparkSession) -> None:
    """Let a task of the session read up to some thousand small files, unless it has a setting of its own.

    By the default of 4 MiB for each file a task gets 32 of them, so that starting tasks
    takes longer than reading.
    """
    name = "spark.sql.files.openCostInBytes"
    if spark.conf.get(name).lower() in ("4194304", "4194304b", "4mb"):
        spark.conf.set(name, str(OPEN_COST))


def _files(spark: SparkSession, root: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(url, rel, modificationTime) of all files below ``root``, and what gives rows of them ``content``, null where a condition doesn't hold.

    Tasks list and read the files. In a store that only Spark's readers reach the driver lists them.
    """
    found = listing.tree(spark, root)
    if found is not None:
        return found.files(), lambda rows, wanted=F.lit(True): found.contents(rows, wanted)
    _small_files(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(root)
    local = lambda path: F.regexp_replace(path, "^file:/+", "/")
    base = local(F.lit(listing.qualified(spark, root)[2].rstrip("/")))
    rel = F.regexp_replace(F.substring(local("path"), F.length(base) + 1, F.lit(1 << 30)), "^/+", "")
    rows = rows.select(local("path").alias("url"), rel.alias("rel"), "modificationTime", "content")
    return rows, lambda rows, wanted=F.lit(True): rows.withColumn("content", F.when(wanted, F.col("content")))


def forward_slashes_of(root: str) -> str:
    return root.removeprefix("file:").replace("\\", "/").rstrip("/")


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, space, title, url, updated_at, text) of Markdown and text files.

    Folders with a leading dot are left out, files of white space only as well.
    """
    rows, read = _files(spark, root)
    parts = F.split("rel", "/")
    named = F.greatest(*[F.lower("rel").endswith(e) for e in DOC_EXTENSIONS])
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith("."))
    space = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(forward_slashes_of(root).rpartition("/")[2]))
    title = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    kept = read(rows.where(named & ~hidden)).withColumn("text", _text(F.col("content"))).drop("content").where(strip(F.col("text")) != "")
    return kept.select(forward_slashes(F.col("rel")).alias("source_id"), space.alias("space"), title.alias("title"), "url", F.col("modificationTime").alias("updated_at"), "text")


def with_source_labels(docs: DataFrame) -> DataFrame:
    """``docs`` with ``source``: the first folder of source_id, or local."""
    first = F.split("source_id", "/")
    return docs.withColumn("source", F.when(F.size(first) > 1, first[0]).otherwise(F.lit("local")))


def code_files(spark: SparkSession, root: str, not_repos: tuple[str, ...] = (".git", "graph")) -> DataFrame:
    """(repo, path, content) of all files of repositories below ``root``; those to be read have content.

    Where ``root`` has a folder ``repos``, the repositories are those in it.
    """
    rows, read = _files(spark, root)
    rows = rows.where(F.contains("rel", F.lit("/")))
    if not rows.where(F.startswith("rel", F.lit("repos/"))).isEmpty():
        rows = rows.where(F.startswith("rel", F.lit("repos/"))).withColumn("rel", F.substring("rel", 7, 1 << 30)).where(F.contains("rel", F.lit("/")))
    path = F.regexp_replace("rel", "^[^/]+/", "")
    wanted = admitted(path) & ~skipped(path)
    rows = rows.withColumns({"repo": F.split("rel", "/")[0], "path": path}).where(~F.col("repo").isin(*not_repos))
    return read(rows, wanted).select("repo", "path", _text(F.col("content")).alias("content"))


def asciidoc(spark: SparkSession, root: str, least: int = DEFAULTS.asciidoc_chars) -> DataFrame:
    """(chapter, stem, markdown) of AsciiDoc files that give ``least`` characters or more."""
    rows, read = _files(spark, root)
    rows = read(rows.where(F.col("rel").endswith(".asc"))).select("rel", _text(F.col("content")).alias("text"))
    made = asciidoc_to_markdown(rows, "rel", "text").where(F.length("markdown") >= least)
    parts = F.split("rel", "/")
    chapter = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("misc"))
    return made.select(chapter.alias("chapter"), F.regexp_replace(F.element_at(parts, -1), r"\.asc$", "").alias("stem"), "markdown")
