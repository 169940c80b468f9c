"""Text helpers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends, control separators included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a line break at the end opens no further line, an empty text has none."""
    parts = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def uuid_text(seed: Column) -> Column:
    """The MD5 of a seed in the shape of a UUID."""
    return F.regexp_replace(F.md5(seed), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def document_chunk_id(source: Column, source_id: Column, chunk: Column) -> Column:
    return uuid_text(F.concat_ws("|", source, source_id, chunk.cast("string")))


def code_chunk_id(repo: Column, path: Column, symbol: Column, line: Column) -> Column:
    return uuid_text(F.concat_ws("|", repo, path, symbol, line.cast("string")))


def safe_name(title: Column) -> Column:
    """A page title as a file name of 120 characters at most."""
    plain = F.btrim(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "-"), F.lit(". "))
    name = F.regexp_replace(plain, r"(?U)\s+", " ")
    return F.left(F.when(name == "", F.lit("untitled")).otherwise(name), F.lit(120))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def accepted_variants(query: Column, variants: Column, most: int = 2) -> Column:
    """The query and up to ``most`` variants that aren't blank or the query again."""
    fit = F.filter(variants, lambda v: v.isNotNull() & (strip(v) != "") & (F.lower(strip(v)) != F.lower(query)))
    return F.concat(F.array(query), F.slice(fit, 1, most))
