"""Source files to chunks: symbols of Python files, line windows of infrastructure files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.config import CODE_FILES, CODE_SUFFIXES, DEFAULTS, SKIPPED_DIRS, SKIPPED_NAME_PARTS
from lodeseek.functions.text import code_chunk_id
from lodeseek.operators.chunking import line_windows

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(ast.unparse(b) for b in node.bases)
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    names = [a.arg for a in node.args.args]
    names += ["*" + node.args.vararg.arg] if node.args.vararg else []
    names += ["**" + node.args.kwarg.arg] if node.args.kwarg else []
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({', '.join(names)})"


def _named(tree: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    """Functions and classes of a module with their names, methods after their class."""
    for node in tree.body:
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            yield node.name, node
        if isinstance(node, ast.ClassDef):
            yield from ((f"{node.name}.{m.name}", m) for m in node.body if isinstance(m, _FUNCTIONS))


def python_symbols(path: str, content: str) -> list[dict]:
    """Chunks of one file; none where it doesn't parse, the whole module where it has no symbols and over three lines."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    rows = content.splitlines()
    out = []
    for name, node in _named(tree):
        body = "\n".join(rows[node.lineno - 1 : node.end_lineno])
        out.append({"symbol": name, "kind": type(node).__name__.removesuffix("Def").lower(), "signature": _signature(node), "doc": (ast.get_docstring(node) or "")[: DEFAULTS.doc_chars], "line_start": node.lineno, "line_end": node.end_lineno, "text": body[: DEFAULTS.code_chars]})
    if not out and len(rows) > 3:
        stem = path.rpartition("/")[2].rpartition(".")[0]
        out.append({"symbol": stem, "kind": "module", "signature": "", "doc": (ast.get_docstring(tree) or "")[: DEFAULTS.doc_chars], "line_start": 1, "line_end": len(rows), "text": content[: DEFAULTS.code_chars]})
    return out


_SYMBOL = "array<struct<symbol:string,kind:string,signature:string,doc:string,line_start:int,line_end:int,text:string>>"


def skipped(path: Column) -> Column:
    """Whether a path relative to its repository is left out: tests, vendored and generated files."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    return F.exists(parts, lambda p: p.isin(*SKIPPED_DIRS)) | F.greatest(*[F.contains(name, F.lit(p)) for p in SKIPPED_NAME_PARTS])


def admitted(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.greatest(path.endswith(".py"), name.isin(*CODE_FILES), *[name.endswith(s) for s in CODE_SUFFIXES])


def extension(path: Column) -> Column:
    """The last extension of a file name with its dot, else the name."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(found == "", name).otherwise(found)


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks with ids of files (repo, path, content)."""
    taken = files.where(admitted(F.col("path")) & ~skipped(F.col("path")))
    symbols = F.udf(python_symbols, _SYMBOL, useArrow=True)
    python = taken.where(F.col("path").endswith(".py")).select("repo", "path", F.explode(symbols("path", "content")).alias("s")).select("repo", "path", "s.*")
    other = taken.where(~F.col("path").endswith(".py")).withColumn("file", F.struct("repo", "path"))
    windows = line_windows(other, "file", "content").select("file.repo", "file.path", F.element_at(F.split("file.path", "/"), -1).alias("symbol"), F.lit("config").alias("kind"), F.lit("").alias("signature"), F.lit("").alias("doc"), "line_start", "line_end", "text")
    return python.unionByName(windows).withColumn("id", code_chunk_id(F.col("repo"), F.col("path"), F.col("symbol"), F.col("line_start")))


def scan_report(files: DataFrame) -> DataFrame:
    """(repo, seen, taken, skipped_by_name) of files (repo, path)."""
    skip = skipped(F.col("path"))
    return files.groupBy("repo").agg(F.count("*").alias("seen"), F.count_if(admitted(F.col("path")) & ~skip).alias("taken"), F.count_if(skip).alias("skipped_by_name"))


def rejected_extensions(files: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent extensions that aren't read, a top-k report."""
    rejected = files.where(~admitted(F.col("path"))).groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))
    return rejected.orderBy(F.desc("n"), "ext").limit(most)
