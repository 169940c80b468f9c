"""Documents scanned in segments: the same lines, trails and sections whatever the size of a segment."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import chunking


def _documents():
    rng = random.Random(3)
    line = lambda: rng.choice(["# A", "## B", "### C", "###### F", "#### ", "```", "  ```py", "text", "", "#no", "====", "== T", "....", "a -- b", "image::x.png[]", "[source]"]) + rng.choice(["", " x", ""])
    return [(k, "\n".join(line() for _ in range(rng.randrange(0, 90)))) for k in range(40)] + [(None, "# T\n```\n# no\n```\n## U\nbody"), (99, None), (98, "")]


def _plain(text):
    """(pos, fenced, level, section, heading) of the lines of a text."""
    out, inside, section, trail = [], False, 0, {}
    rows = text.split("\n") if text else []
    rows = rows[:-1] if rows and rows[-1] == "" else rows
    for pos, line in enumerate(rows):
        fence, level = line.lstrip().startswith("```"), 0
        inside ^= fence
        hashes = len(line) - len(line.lstrip("#"))
        if not fence and not inside and 1 <= hashes <= 6 and line[hashes : hashes + 1].isspace():
            level, section = hashes, section + 1
            trail = {k: v for k, v in trail.items() if k < level} | {level: line[hashes:].strip()}
        out.append((pos, fence or inside, level, section, " - ".join(trail[k] for k in sorted(trail) if trail[k])))
    return out


@pytest.mark.parametrize("size", [1, 7, 20_000])
def test_any_segment_size_gives_the_same_rows(spark, monkeypatch, size):
    docs = _documents()
    df = spark.createDataFrame(docs, "id long, text string")
    rows = lambda made: sorted(map(tuple, made.collect()), key=str)
    whole = [rows(f(df, "id", "text")) for f in (chunking.asciidoc_to_markdown, chunking.sections, chunking.chunks)]
    trail = lambda segmented: rows(chunking.heading_trail(chunking.document_lines(df, "id", "text", segmented), "id", segmented).select("id", "pos", "fenced", "level", "section", "heading"))
    want = sorted(((k, *row) for k, text in docs for row in _plain(text)), key=str)
    assert trail(False) == want
    monkeypatch.setattr(chunking, "SEGMENT", size)
    assert trail(True) == want
    assert [rows(f(df, "id", "text", segmented=True)) for f in (chunking.asciidoc_to_markdown, chunking.sections, chunking.chunks)] == whole


def test_lines_of_one_long_document_are_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SEGMENT", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = "# Top\n" + "\n".join("```" if k % 7 == 0 else f"## H{k}" if k % 100 == 1 else f"line {k}" for k in range(20_000))
        trail = chunking.heading_trail(chunking.document_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", True), "id", True)
        rows = trail.withColumn("task", F.spark_partition_id()).collect()
        tasks = collections.Counter(r.task for r in rows)
        assert len(tasks) > 2 and max(tasks.values()) < 15_000
        assert sorted((r.pos, r.fenced, r.level, r.section, r.heading) for r in rows) == _plain(text)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_files_share_tasks(spark, tmp_path):
    """Some hundred small files are read by a few tasks; a session's own setting stays."""
    from lodeseek.sources import files

    name, was = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    for k in range(400):
        (tmp_path / f"f{k}.md").write_text(f"# {k}\n")
    try:
        spark.conf.set(name, "4194304")
        assert files.documents(spark, str(tmp_path)).rdd.getNumPartitions() <= 8
        assert files.documents(spark, str(tmp_path)).count() == 400
        spark.conf.set(name, "12345")
        files.documents(spark, str(tmp_path))
        assert spark.conf.get(name) == "12345"
    finally:
        spark.conf.set(name, was)
