"""Folders listed and read by tasks: the same files as by Spark's reader, none of them kept on the driver."""

import os

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import chunking
from lodeseek.sources import files, listing, sinks


def _fill(root):
    names = ["a.md", "d/b.md", "d/e/ü x%20#.md", "d/e/.hid/no.md", ".staging/no.md", "_no/x.md", "_a=1/yes.md", "d/_no.md", "d/_metadata", "_metadata_of/yes.md", "_metadata_of/_no/x.md", "d/x._COPYING_", "deep/1/2/3/4/5/6.md", "d/none.md"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "none" in name else name.encode() + b"\xff\n")
    (root / "d/empty").mkdir()
    (root / "d/link.md").symlink_to(root / "a.md")
    (root / "d/gone.md").symlink_to(root / "nowhere")
    (root / "to").symlink_to(root / "deep")


def _rows(frame):
    return sorted(tuple(r) for r in frame.select("url", "rel", "modificationTime", "content").collect())


@pytest.mark.parametrize("most", [1, 3, 20_000])
def test_the_same_files_as_sparks_reader(spark, tmp_path, monkeypatch, most):
    root = tmp_path / "a b%41"
    _fill(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    url = F.regexp_replace("path", "^file:/+", "/")
    want = _rows(found.select(url.alias("url"), F.substring(url, len(str(root)) + 2, 1 << 30).alias("rel"), "modificationTime", "content"))
    monkeypatch.setattr(listing, "MOST", most)
    monkeypatch.setattr(listing, "BYTES", 20)
    for name in (str(root), f"{root}/", f"file:{root}"):
        rows, read = files._files(spark, name)
        assert _rows(read(rows)) == want and len(want) == 8
    tree = listing.Tree(spark, str(root), str(root), f"file://{tmp_path}/a%20b%2541")  # by Arrow's file systems, as stores are
    assert _rows(tree.contents(tree.files(), F.lit(True))) == want
    rows, read = files._files(spark, str(tmp_path / "a*"))  # a pattern: by Spark's reader
    assert sorted(r.content for r in read(rows).collect()) == sorted(r[3] for r in want)
    rows, read = files._files(spark, str(root))
    assert {r.rel for r in read(rows, F.col("rel").startswith("d/")).collect() if r.content is not None} == {r[1] for r in want if r[1].startswith("d/")}
    (tmp_path / "none").mkdir()
    assert files.documents(spark, str(tmp_path / "none")).count() == 0


def test_the_driver_holds_no_files(spark, tmp_path):
    """What the driver plans with doesn't grow with the files of a scan, and folders hold their names under any form of address."""
    text = "== T\n" + "word " * 200 + "\n"
    for k in range(300):
        (tmp_path / f"c{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"c{k % 3}/s{k}.asc").write_text(text)
        (tmp_path / f"c{k % 3}/s{k}.md").write_text(text)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        scans = files.asciidoc(spark, root), files.documents(spark, root), files.code_files(spark, root)
        assert all(len(scan.inputFiles()) < 20 for scan in scans)
        assert {(r.chapter, r.stem) for r in scans[0].collect()} == {(f"c{k % 3}", f"s{k}") for k in range(300)}
        assert {r.source_id for r in scans[1].collect()} == {f"c{k % 3}/s{k}.md" for k in range(300)}


def test_a_commit_lists_a_part_at_a_time(spark, tmp_path, monkeypatch):
    """Files of one task, some twice, are published part by part; the last row of a name stays."""
    monkeypatch.setattr(sinks, "PART", 10)
    writer = sinks._MarkdownWriter({"path": str(tmp_path)})
    rows = [type("Row", (), {"file": f"d{k % 7}/f{k % 40}.md", "markdown": f"{k}"}) for k in range(95)]
    listed = []

    class Told:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def get_file_info(self, what):
            listed.append(found := self.fs.get_file_info(what))
            return found

    told = writer.write(iter(rows))
    monkeypatch.setattr(sinks, "_filesystem", lambda path, real=sinks._filesystem: (Told(real(path)[0]), real(path)[1]))
    writer.commit([told, None])
    want = {r.file: r.markdown for r in rows}
    assert {os.path.relpath(os.path.join(d, name), tmp_path): open(os.path.join(d, name)).read() for d, _, names in os.walk(tmp_path) for name in names} == want
    assert max(len(x) for x in listed if isinstance(x, list)) <= 20 and not (tmp_path / ".staging").exists()


def test_whole_documents_are_converted_where_they_are(spark):
    """Lines of AsciiDoc aren't shuffled, and a document of many blocks takes time in proportion to its lines."""
    text = "".join(f"----\n== code {k}\n----\n== T{k} \n[a]\nx -- y((( i )))\n" for k in range(30_000))
    made = chunking.asciidoc_to_markdown(spark.createDataFrame([(1, text), (2, "image::x"), (3, None), (4, "....\n----\n=="), (5, "[a]\n  \n= A")], "id long, text string").coalesce(1), "id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = "\n".join(f"```\n== code {k}\n```\n## T{k}\nx — y" for k in range(30_000)) + "\n"
    assert {r.id: r.markdown for r in made.collect()} == {1: want, 4: "```\n```\n==\n", 5: "# A\n"}
