"""A code graph from Python files: nodes and edges of their syntax trees, names resolved by joins with a symbol table.

A file tells its definitions and, with the imports of the file applied, the dotted names
that it imports, calls and inherits from. Whose names those are is settled over all files:
a name that one definition has is EXTRACTED. A name that none has is looked up by its last
part alone, in the repository and, if that has none, in all; one definition is INFERRED.
Where there are several, every one gets an edge, and it is AMBIGUOUS.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.sources.shared import written

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FACTS = "array<struct<fact:string,kind:string,owner:string,name:string,line:int>>"


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _dotted(node: ast.AST) -> str | None:
    """The text of ``a.b.c``; what is called on a result or an element is known by its last part only, with a leading dot."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *parts[::-1]])
    return "." + parts[0] if parts else None


class _Reader(ast.NodeVisitor):
    """The facts of one file: definitions with their full names, and references by full names as far as imports tell."""

    def __init__(self, path: str, tree: ast.Module):
        self.module, self.package = module_name(path), path.endswith("__init__.py")
        self.facts: list[dict] = []
        self.names: dict[str, str] = {}
        self.scope: list[tuple[str, bool]] = [(self.module, False)]
        self._add("node", "module", "", self.module, 1)
        for node in tree.body:
            if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
                self.names[node.name] = f"{self.module}.{node.name}"
        for node in ast.walk(tree):  # imports count for the whole file, wherever they stand
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    self.names[a.asname or a.name] = f"{self._origin(node)}.{a.name}".lstrip(".")
        self.visit(tree)

    def _origin(self, node: ast.ImportFrom) -> str:
        if not node.level:
            return node.module or ""
        up = self.module.split(".")
        up = up[: len(up) - (node.level - self.package)]
        return ".".join([*up, *([node.module] if node.module else [])])

    def _add(self, fact: str, kind: str, owner: str, name: str, line: int) -> None:
        self.facts.append({"fact": fact, "kind": kind, "owner": owner, "name": name, "line": line})

    def _full(self, text: str) -> str:
        first, _, rest = text.partition(".")
        if first in ("self", "cls") and rest:
            inside = next((name for name, is_class in reversed(self.scope) if is_class), None)
            return f"{inside}.{rest}" if inside and "." not in rest else "." + rest.rpartition(".")[2]
        if first in self.names:
            return self.names[first] + ("." + rest if rest else "")
        return "." + rest.rpartition(".")[2] if rest else text

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self._add("ref", "imports", self.module, a.name, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        for a in node.names:
            self._add("ref", "imports", self.module, self._origin(node) if a.name == "*" else f"{self._origin(node)}.{a.name}".lstrip("."), node.lineno)

    def _definition(self, node, kind: str) -> None:
        owner, in_class = self.scope[-1]
        known = len(self.scope) == 1 or in_class  # as for chunks: what is nested in a function isn't a node of its own
        name = f"{owner}.{node.name}" if known else owner
        if known:
            self._add("node", kind, owner, name, node.lineno)
        if kind == "class":
            for b in node.bases:
                if known and (text := _dotted(b)):
                    self._add("ref", "inherits", name, self._full(text), node.lineno)
        self.scope.append((name, kind == "class" and known))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        self._definition(node, "function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:  # noqa: N802
        self._definition(node, "asyncfunction")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self._definition(node, "class")

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        if text := _dotted(node.func):
            self._add("ref", "calls", self.scope[-1][0], self._full(text), node.lineno)
        self.generic_visit(node)


def facts(path: str, content: str | None) -> list[dict]:
    """Definitions (node) and references (ref) of a file; none where it doesn't parse."""
    try:
        return _Reader(path, ast.parse(content or "")).facts
    except (SyntaxError, ValueError, RecursionError):
        return []


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, kind, label, repo, path, line), edges (src, dst, kind, confidence)) of ``files`` (repo, path, content).

    ids are ``repo:full.name``; imported modules that no file defines are nodes of kind
    external without a repository. Edges: contains, imports, calls, inherits, each once.
    Files that aren't Python or don't parse have no nodes. A call or base that no
    definition fits has no edge.
    """
    read = F.udf(facts, _FACTS, useArrow=True)
    told = written(files.where(F.col("path").endswith(".py")).select("repo", "path", F.explode(read("path", "content")).alias("f")).select("repo", "path", "f.*"))
    ident = F.concat("repo", F.lit(":"), "name")
    own = F.row_number().over(Window.partitionBy("repo", "name").orderBy("path", "line", "kind"))  # a name that is defined again
    nodes = told.where("fact = 'node'").withColumn("nth", own).where("nth = 1").select(ident.alias("id"), "kind", F.col("name").alias("label"), "repo", "path", "line")
    contains = told.where("fact = 'node' and owner <> ''").select(F.concat("repo", F.lit(":"), "owner").alias("src"), ident.alias("dst"), F.lit("contains").alias("kind"), F.lit("EXTRACTED").alias("confidence"))

    last = F.element_at(F.split("name", r"\."), -1)
    refs = told.where("fact = 'ref'").select("repo", F.concat("repo", F.lit(":"), "owner").alias("src"), "kind", "name", last.alias("last")).distinct()
    symbols = written(nodes.select("id", "repo", F.col("label").alias("name"), F.element_at(F.split("label", r"\."), -1).alias("last")))
    ways = (("repo", "name"), ("name",), ("repo", "last"), ("last",))  # how names are looked up, the surest way first
    for k, on in enumerate(ways):
        refs = refs.join(symbols.groupBy(*on).agg(F.count("*").alias(f"n{k}")), list(on), "left")
    by_last = F.col("kind") != "imports"  # a module isn't known by its last part
    way = F.coalesce(*[F.when((F.col(f"n{k}") > 0) & (by_last if "last" in on else F.lit(True)), F.lit(k)) for k, on in enumerate(ways)])
    refs = written(refs.withColumn("way", way))
    found = []
    for k, on in enumerate(ways):
        confidence = F.when(F.col(f"n{k}") > 1, "AMBIGUOUS").otherwise("INFERRED" if "last" in on else "EXTRACTED")
        some = refs.where(F.col("way") == k).select(*on, "src", "kind", confidence.alias("confidence"))
        found.append(some.join(symbols.select(*on, F.col("id").alias("dst")), list(on)).select("src", "dst", "kind", "confidence"))
    edges = reduce(DataFrame.unionByName, found)

    # A name that a known module doesn't define (a variable, say) leads to the module; other imports lead outside.
    left = refs.where(F.col("way").isNull() & ~by_last).select("repo", "src", "kind", F.col("name").alias("imported"), F.regexp_replace("name", r"\.[^.]*$", "").alias("name"))
    modules = symbols.groupBy("repo", "name").agg(F.min("id").alias("dst"))
    met = written(left.join(modules, ["repo", "name"], "left"))
    of_module = met.where("dst is not null").select("src", "dst", "kind", F.lit("EXTRACTED").alias("confidence"))
    external = met.where("dst is null").select("src", F.concat(F.lit("external:"), F.split("imported", r"\.")[0]).alias("dst"), "kind", F.lit("EXTRACTED").alias("confidence"))
    out = contains.unionByName(edges).unionByName(of_module).unionByName(external)
    weight = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    out = out.groupBy("src", "dst", "kind").agg(F.min_by("confidence", weight).alias("confidence"))
    strangers = external.select(F.col("dst").alias("id")).distinct().select("id", F.lit("external").alias("kind"), F.substring_index("id", ":", -1).alias("label"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))
    return nodes.unionByName(strangers), out


def merged(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one: nodes by id and edges by ends and kind, each once."""
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst", "kind"])
