"""Documents to chunks: lines, fences, headings, sections, packed paragraphs.

Order matters throughout, so lines carry their position, and windows run over a document's
lines. Where single documents are too long for a task, ``segmented=True`` scans them in
segments of ``SEGMENT`` lines: what a segment does to the state of the scan (fences opened,
headings set) is summed up on its own, the sums are composed over the document's segments,
of which there are few, and each segment is then read with the state it starts from. Rows
are the same; the documents are read once more for each state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodeseek.config import DEFAULTS
from lodeseek.functions.text import document_chunk_id, lines, strip

_HEADING = r"^(#{1,6})\s+(.*)$"
_LEVELS = range(1, 7)
_DELIMITER, _IMAGE, _INDEX_ENTRY = r"^(-{4,}|\.{4,}|={4,}|\*{4,})\s*$", "^image::", r"\(\(\([^)]*\)\)\)"
_ATTRIBUTES, _ASCIIDOC_HEADING = r"^\[.*\]\s*$", r"^(=+)\s+(.*)$"
#: Lines of a segment.
SEGMENT = 20_000


def _dealt(docs: DataFrame, key: str, text: str, segmented: bool) -> DataFrame:
    """(key, pos, line), and for segments (segment_doc, segment): lines, and what they are dealt by.

    segment_doc is a struct of the key, so it isn't null, and of whether the document may
    have several segments; the state of others is that of an empty text.
    """
    each = F.posexplode(lines(F.col(text))).alias("pos", "line")
    if not segmented:
        return docs.select(key, each)
    doc = F.struct(F.col(key).alias("key"), (F.coalesce(F.length(text), F.lit(0)) > SEGMENT).alias("long"))
    return docs.select(key, doc.alias("segment_doc"), each).withColumn("segment", F.expr(f"pos div {SEGMENT}").cast("int"))


def _before() -> WindowSpec:
    """The segments of a document before one."""
    return Window.partitionBy("segment_doc").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)


def _so_far(key: str, segmented: bool) -> WindowSpec:
    """The lines of a document, or of a segment, up to one."""
    return Window.partitionBy(*(("segment_doc", "segment") if segmented else (key,))).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``state``, the state at the start of their segment, null where there is none; lines stay where they are dealt."""
    return rows.join(state, ["segment_doc", "segment"], "left")


def document_lines(docs: DataFrame, key: str, text: str, segmented: bool = False) -> DataFrame:
    """(key, pos, line, fenced, level, title): level is 0 outside headings.

    A line of three backticks opens or closes a fence and belongs to it as text. With
    segments, segment_doc and segment tell which one, so that ``heading_trail`` finds the
    lines dealt by it.
    """
    each = _dealt(docs, key, text, segmented)
    fence = F.col("line").rlike(r"^\s*```")
    opened = F.lit(0)
    if segmented:
        fences = each.where("segment_doc.long").groupBy("segment_doc", "segment").agg(F.count_if(fence).alias("fences"))
        each = _with_state(each, fences.select("segment_doc", "segment", F.sum("fences").over(_before()).alias("opened")))
        opened = F.coalesce("opened", F.lit(0))
    inside = (opened + F.sum(fence.cast("int")).over(_so_far(key, segmented))) % 2 == 1
    heading = ~fence & ~F.col("inside") & F.col("line").rlike(_HEADING)
    level = F.when(heading, F.length(F.regexp_extract("line", _HEADING, 1))).otherwise(0)
    title = F.when(heading, strip(F.regexp_extract("line", _HEADING, 2)))
    return each.withColumn("inside", inside).select(key, "pos", "line", (fence | F.col("inside")).alias("fenced"), level.alias("level"), title.alias("title"), *(("segment_doc", "segment") if segmented else ()))


def heading_trail(marked: DataFrame, key: str, segmented: bool = False) -> DataFrame:
    """``marked`` lines (of ``document_lines``) with ``section`` (headings so far) and ``heading``, the titles above a line joined by " - ".

    The title of a level holds until a heading of the same or a higher level follows.
    """
    at = {k: F.when(F.col("level") == k, F.struct("pos", "title")) for k in _LEVELS}
    upto = _so_far(key, segmented)
    section = F.sum((F.col("level") > 0).cast("int")).over(upto)
    last = {k: F.last(at[k], True).over(upto) for k in _LEVELS}
    rows = marked
    if segmented:
        ends = rows.where("segment_doc.long").groupBy("segment_doc", "segment").agg(F.count_if(F.col("level") > 0).alias("headings"), *[F.max(at[k]).alias(f"last{k}") for k in _LEVELS])
        carried = [F.last(f"last{k}", True).over(_before()).alias(f"before{k}") for k in _LEVELS]
        rows = _with_state(rows, ends.select("segment_doc", "segment", F.sum("headings").over(_before()).alias("closed"), *carried))
        section = F.coalesce("closed", F.lit(0)) + section
        last = {k: F.coalesce(last[k], F.col(f"before{k}")) for k in _LEVELS}
    rows = rows.select(*marked.columns, section.alias("section"), *[last[k].alias(f"h{k}") for k in _LEVELS])
    alive: list[Column] = []
    for k in _LEVELS:
        above = [F.coalesce(F.col(f"h{j}.pos"), F.lit(-1)) for j in _LEVELS if j < k]
        holds = F.col(f"h{k}.pos") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1))
        alive.append(F.when(holds, F.nullif(F.col(f"h{k}.title"), F.lit(""))))
    return rows.select(*marked.columns, "section", F.concat_ws(" - ", *alive).alias("heading"))


def sections(docs: DataFrame, key: str, text: str, segmented: bool = False) -> DataFrame:
    """(key, section, heading, body): stripped bodies that aren't empty."""
    trail = heading_trail(document_lines(docs, key, text, segmented), key, segmented)
    own = F.filter(F.array_sort(F.collect_list(F.struct("pos", "line", "level"))), lambda r: r["level"] == 0)
    made = trail.groupBy(key, "section").agg(F.max_by("heading", "pos").alias("heading"), own.alias("own"))
    body = strip(F.array_join(F.transform("own", lambda r: r["line"]), "\n"))
    return made.select(key, "section", "heading", body.alias("body")).where("body <> ''")


def pack_paragraphs(body: Column, most: int) -> Column:
    """Texts of about ``most`` characters from whole paragraphs; a longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(body, r"\r?\n\s*\r?\n", -1), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) > most)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        joined = F.when((acc["open"] == "") | full, p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), joined.alias("open"))

    packed = F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(packed)


def chunks(docs: DataFrame, key: str, text: str, most: int = DEFAULTS.chunk_chars, segmented: bool = False) -> DataFrame:
    """(key, chunk_idx, heading, text): the chunks of each document, numbered from 0."""
    pieces = sections(docs, key, text, segmented).select(key, "section", "heading", F.posexplode(pack_paragraphs(F.col("body"), most)).alias("piece", "text"))
    order = Window.partitionBy(key).orderBy("section", "piece")
    return pieces.select(key, (F.row_number().over(order) - 1).alias("chunk_idx"), "heading", "text")


def chunk_ids(made: DataFrame, source: Column, source_id: Column) -> DataFrame:
    """``made`` chunks with their deterministic ``id``."""
    return made.withColumn("id", document_chunk_id(source, source_id, F.col("chunk_idx")))


def _once(value: Column) -> Column:
    """``value`` for a select, computed once for each row, also where filters above use it."""
    return F.explode(F.array(value))


def _prose(plain: Column) -> Column:
    """A line of AsciiDoc outside blocks, without index entries, in Markdown."""
    marks = F.translate(F.regexp_extract(plain, _ASCIIDOC_HEADING, 1), "=", "#")
    words = F.replace(F.replace(F.replace(plain, F.lit(" -- "), F.lit(" — ")), F.lit("`+"), F.lit("`")), F.lit("+`"), F.lit("`"))
    return F.when(plain.rlike(_ASCIIDOC_HEADING), F.concat(marks, F.lit(" "), strip(F.regexp_extract(plain, _ASCIIDOC_HEADING, 2)))).otherwise(words)


def _shown(own: Column) -> Column:
    """The lines of Markdown for ``own``, those of a whole AsciiDoc document: between delimiters every other run of lines is code."""
    marks = F.filter(F.transform(own, lambda line, k: F.when(line.rlike(_DELIMITER), k)), lambda k: k.isNotNull())
    runs = F.transform(F.array(marks), lambda at: F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(own))), lambda start, end: F.slice(own, start + 2, end - start - 1)))[0]

    def prose(run: Column) -> Column:
        plain = F.transform(F.filter(run, lambda line: ~line.rlike(_IMAGE)), lambda line: F.regexp_replace(line, _INDEX_ENTRY, ""))
        return F.transform(F.filter(plain, lambda line: ~line.rlike(_ATTRIBUTES)), _prose)

    fence = F.array(F.lit("```"))
    return F.flatten(F.transform(runs, lambda run, k: F.when(k == 0, prose(run)).when(k % 2 == 1, F.concat(fence, run)).otherwise(F.concat(fence, prose(run)))))


def asciidoc_to_markdown(docs: DataFrame, key: str, text: str, segmented: bool = False) -> DataFrame:
    """(key, markdown): blocks become fences; images, attributes and index entries go.

    Whole documents are converted where they are; segments are dealt by their document.
    """
    if segmented:
        each = _dealt(docs, key, text, segmented)
        mark = F.col("line").rlike(_DELIMITER)
        counts = each.where("segment_doc.long").groupBy("segment_doc", "segment").agg(F.count_if(mark).alias("marks"))
        each = _with_state(each, counts.select("segment_doc", "segment", F.sum("marks").over(_before()).alias("opened")))
        rows = each.withColumns({"mark": mark, "code": (F.coalesce("opened", F.lit(0)) + F.sum(mark.cast("int")).over(_so_far(key, segmented))) % 2 == 1})
        plain = F.regexp_replace("line", _INDEX_ENTRY, "")
        dropped = F.col("line").rlike(_IMAGE) | plain.rlike(_ATTRIBUTES)
        shown = F.when(F.col("mark"), F.lit("```")).when(F.col("code"), F.col("line")).when(dropped, F.lit(None)).otherwise(_prose(plain))
        kept = rows.select(key, "pos", shown.alias("shown")).where("shown is not null")
        whole = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda r: r["shown"]).alias("shown"))
    else:
        own = docs.select(key, _once(lines(F.col(text))).alias("own"))
        whole = own.select(key, _once(_shown(F.col("own"))).alias("shown")).where(F.size("shown") > 0)
    joined = F.regexp_replace(F.array_join("shown", "\n"), r"\n{3,}", "\n\n")
    return whole.select(key, _once(F.concat(strip(joined), F.lit("\n"))).alias("markdown"))


def line_windows(docs: DataFrame, key: str, text: str, step: int = DEFAULTS.window_lines, most: int = DEFAULTS.code_chars) -> DataFrame:
    """(key, line_start, line_end, text): windows of ``step`` lines that aren't blank."""
    body = lines(F.col(text))
    each = docs.select(key, F.size(body).alias("total"), F.posexplode(body).alias("pos", "line"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"])
    made = each.groupBy(key, "total", F.expr(f"pos div {step}").alias("n")).agg(F.array_join(own, "\n").alias("piece"))
    made = made.where(strip(F.col("piece")) != "")
    start, end = F.col("n") * step, F.least(F.col("n") * step + step, F.col("total"))
    return made.select(key, (start + 1).cast("int").alias("line_start"), end.cast("int").alias("line_end"), F.left("piece", F.lit(most)).alias("text"))
