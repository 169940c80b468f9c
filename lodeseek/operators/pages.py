"""Wiki pages: subtrees, first occurrences, changes against the last synchronisation."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions.storage import to_markdown
from lodeseek.functions.text import safe_name
from lodeseek.sources.shared import forget, levels, written


def descendants(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth): the roots and all pages below, by edges (id, parent), each at its least depth.

    A page that a root has already reached is not followed again, so cycles end. depth:
    how many levels to go down, None for all.
    """
    below = written(edges.select(F.col("parent").alias("above"), F.col("id").alias("page")))

    def step(front: DataFrame) -> DataFrame:
        return front.join(below, front.id == below.above).select("root", F.col("page").alias("id"))

    found = levels(roots.select(F.col("id").alias("root"), "id"), step, ["root", "id"], "depth", depth)
    forget(below)
    return found


def subtree_counts(tree: DataFrame) -> DataFrame:
    """(root, pages): the root included."""
    return tree.groupBy("root").agg(F.count("*").alias("pages"))


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """(root, pages) of every page in ``edges`` (id, parent): the pages in its subtree, itself included.

    By doubling: a page knows how many there are up to 2**k levels below it and its
    ancestor 2**k levels above; pages add their number to that ancestor's. It takes as many
    rounds as the depth has bits, each an aggregate and a join over the pages. Pages with
    several parents, on a cycle or below one are counted by way of ``descendants``.
    """
    pairs = edges.select("id", "parent").where("id is not null").distinct()
    known = pairs.where("parent is not null")
    ids = pairs.select("id").unionByName(known.select(F.col("parent").alias("id"))).distinct()
    if not known.groupBy("id").count().where("count > 1").isEmpty():
        return subtree_counts(descendants(known, ids))
    now = written(ids.join(known, "id", "left").select("id", F.col("parent").alias("above"), F.lit(1).cast("long").alias("pages")))
    total, rounds = now.count(), 0
    while not now.where("above is not null").isEmpty():
        if 1 << rounds > total:  # whoever still has an ancestor so far up is on a cycle or below one
            break
        gained = now.where("above is not null").groupBy(F.col("above").alias("id")).agg(F.sum("pages").alias("more"))
        further = now.select(F.col("id").alias("above"), F.col("above").alias("next"))
        before, now = now, written(now.join(further, "above", "left").join(gained, "id", "left").select("id", F.col("next").alias("above"), (F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages")))
        forget(before)
        rounds += 1
    done = now.where("above is null").select(F.col("id").alias("root"), "pages")
    cyclic = now.where("above is not null").select("id")
    return done if cyclic.isEmpty() else done.unionByName(subtree_counts(descendants(known, cyclic)))


def first_occurrences(listed: DataFrame) -> DataFrame:
    """Pages (root_ord, pos, id, ...) once each, as they are listed first."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("root_ord", "pos"))
    return listed.withColumn("nth", nth).where("nth = 1").drop("nth")


def limited(listed: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` pages of the list, unchanged ones included; None: all."""
    return listed if most is None else listed.orderBy("root_ord", "pos").limit(most)


def change_set(pages: DataFrame, state: DataFrame) -> DataFrame:
    """``pages`` (id, updated, ...) with ``action``: new, updated or unchanged; times are compared as text."""
    known = state.select(F.col("id").alias("known"), F.col("updated").alias("known_updated"))
    action = F.when(F.col("known").isNull(), "new").when(F.col("known_updated").eqNullSafe(F.col("updated")), "unchanged").otherwise("updated")
    return pages.join(known, F.col("id") == F.col("known"), "left").withColumn("action", action).drop("known", "known_updated")


def sync_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def markdown_files(pages: DataFrame) -> DataFrame:
    """(id, file, markdown) of pages (id, space, title, storage)."""
    file = F.concat("space", F.lit("/"), safe_name(F.col("title")), F.lit(".md"))
    return pages.select("id", file.alias("file"), to_markdown("storage", "title").alias("markdown"))


def new_state(state: DataFrame, changes: DataFrame, synced_at: str) -> DataFrame:
    """The state after a run: pages that were seen replace their entries, others stay."""
    seen = changes.select("id", "updated", "title", "space", "file")
    rest = state.select(*seen.columns).join(seen, "id", "left_anti")
    return rest.unionByName(seen).withColumn("synced_at", F.lit(synced_at))


STATE = "id string, updated string, title string, space string, file string"


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state (STATE) that ``save_state`` wrote; empty, which means a full run, where there is none or it can't be read (which is logged)."""
    try:
        found = spark.read.schema(STATE + ", synced_at string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        if found.where(F.col("_corrupt").isNotNull() | F.col("id").isNull()).isEmpty():
            return found.select("id", "updated", "title", "space", "file")
        logging.getLogger(__name__).warning("the state at %s is broken: all pages count as new", path)
    except AnalysisException:
        logging.getLogger(__name__).info("there is no state at %s: all pages count as new", path)
    return spark.createDataFrame([], STATE)


def iso_now() -> Column:
    """The time of the query as an ISO timestamp."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def save_state(state: DataFrame, path: str, dry_run: bool = False) -> None:
    """Writes a state as JSON lines, with the time of the run; nothing in a dry run.

    path: a new folder for each run, since ``state`` may still read the last one.
    """
    if not dry_run:
        state.select("id", "updated", "title", "space", "file").withColumn("synced_at", iso_now()).write.json(path)


def write_markdown(files: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """(id, file, chars) of ``files`` (id, file, markdown), written below ``root`` unless it is a dry run.

    root: a folder or address that all executors reach. Repeated tasks write the same
    files again. Nothing is written before the result is computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for file, markdown in zip(*(batch.column(c).to_pylist() for c in ("file", "markdown")), strict=True):
                fs.create_dir(f"{base}/{file.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{file}") as out:
                    out.write((markdown or "").encode())
            yield batch

    rows = files.select("id", "file", "markdown")
    rows = rows if dry_run else rows.mapInArrow(run, rows.schema)
    return rows.select("id", "file", F.length("markdown").alias("chars"))
