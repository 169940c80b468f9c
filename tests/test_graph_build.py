"""Graphs of code: edges of all three confidences, patterns, dependents, long ways; subtree sizes by doubling."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import graph, graph_build, pages

FILES = [
    ("one", "pkg/__init__.py", "from .core import Base\n"),
    ("one", "pkg/core.py", "import os\nimport numpy.linalg as la\n\nclass Base:\n    def run(self):\n        return self.step() + os.getcwd()\n    def step(self):\n        def inner():\n            return helper()\n        return inner()\n\ndef helper():\n    return la.norm([1])\n"),
    ("one", "pkg/work.py", "from pkg.core import Base, helper as h\nfrom . import core\n\nclass Worker(Base):\n    async def go(self, x):\n        x.unique_one()\n        x.step()\n        return h() or core.helper()\n\nclass Other:\n    def step(self):\n        return x[0].unique_one()\n    def unique_one(self): pass\n"),
    ("one", "bad.py", "def ("),
    ("one", "notes.md", "# no code"),
    ("two", "main.py", "import pkg.core\nfrom pkg.work import Worker\nfrom missing.lib import thing\n\ndef start():\n    Worker().go(1)\n    pkg.core.helper()\n    nowhere()\n    start()\n"),
    ("two", "empty.py", None),
]


@pytest.fixture(scope="module")
def code(spark):
    nodes, edges = graph_build.build(spark.createDataFrame(FILES, "repo string, path string, content string"))
    return nodes.cache(), edges.cache()


def test_nodes_and_edges_of_a_repository(code):
    nodes, edges = ([tuple(r) for r in df.collect()] for df in code)
    kinds = {n[0]: n[1] for n in nodes}
    assert kinds == {
        "one:pkg": "module", "one:pkg.core": "module", "one:pkg.core.Base": "class", "one:pkg.core.Base.run": "function", "one:pkg.core.Base.step": "function", "one:pkg.core.helper": "function",
        "one:pkg.work": "module", "one:pkg.work.Worker": "class", "one:pkg.work.Worker.go": "asyncfunction", "one:pkg.work.Other": "class", "one:pkg.work.Other.step": "function", "one:pkg.work.Other.unique_one": "function",
        "two:main": "module", "two:main.start": "function", "two:empty": "module", "external:os": "external", "external:numpy": "external", "external:missing": "external",
    }
    got = {(s, d, k): c for s, d, k, c in edges}
    assert len(got) == len(edges)
    by_kind = collections.Counter(k for _, _, k in got)
    assert by_kind["contains"] == 10 and all(c == "EXTRACTED" for (_, _, k), c in got.items() if k == "contains")
    calls = {(s, d): c for (s, d, k), c in got.items() if k == "calls"}
    assert calls == {
        ("one:pkg.core.Base.run", "one:pkg.core.Base.step"): "EXTRACTED",
        ("one:pkg.core.Base.step", "one:pkg.core.helper"): "EXTRACTED",
        ("one:pkg.work.Worker.go", "one:pkg.core.helper"): "EXTRACTED",
        ("one:pkg.work.Worker.go", "one:pkg.work.Other.unique_one"): "INFERRED",
        ("one:pkg.work.Other.step", "one:pkg.work.Other.unique_one"): "INFERRED",
        ("one:pkg.work.Worker.go", "one:pkg.core.Base.step"): "AMBIGUOUS",
        ("one:pkg.work.Worker.go", "one:pkg.work.Other.step"): "AMBIGUOUS",
        ("two:main.start", "one:pkg.work.Worker"): "EXTRACTED",
        ("two:main.start", "one:pkg.work.Worker.go"): "INFERRED",
        ("two:main.start", "one:pkg.core.helper"): "EXTRACTED",
        ("two:main.start", "two:main.start"): "EXTRACTED",
    }
    imports = {(s, d) for (s, d, k) in got if k == "imports"}
    assert imports == {("one:pkg", "one:pkg.core.Base"), ("one:pkg.core", "external:os"), ("one:pkg.core", "external:numpy"), ("one:pkg.work", "one:pkg.core.Base"), ("one:pkg.work", "one:pkg.core.helper"), ("one:pkg.work", "one:pkg.core"), ("two:main", "one:pkg.core"), ("two:main", "one:pkg.work.Worker"), ("two:main", "external:missing")}
    assert {(s, d) for (s, d, k) in got if k == "inherits"} == {("one:pkg.work.Worker", "one:pkg.core.Base")}


def test_patterns_are_chains_of_joins(code):
    nodes, edges = code
    hop = graph.Hop
    found = graph.match(nodes, edges, hop(nodes=("function",), text="START"), hop(edges=("calls",), confidence=("EXTRACTED",), nodes=("class",)), hop(edges=("inherits",)), hop(edges=("contains",), text="run"))
    assert [tuple(r) for r in found.collect()] == [("two:main.start", "one:pkg.work.Worker", "one:pkg.core.Base", "one:pkg.core.Base.run", "calls", "EXTRACTED", "inherits", "EXTRACTED", "contains", "EXTRACTED")]
    callers = graph.match(nodes, edges, hop(text="pkg.core.helper"), hop(edges=("calls",), direction="in"))
    assert {r.n1 for r in callers.collect()} == {"one:pkg.core.Base.step", "one:pkg.work.Worker.go", "two:main.start"}
    around = graph.match(nodes, edges, hop(text="main.start"), hop(direction="any"))
    assert {(r.n1, r.e1) for r in around.collect()} == {("one:pkg.work.Worker", "calls"), ("one:pkg.work.Worker.go", "calls"), ("one:pkg.core.helper", "calls"), ("two:main.start", "calls"), ("two:main", "contains")}
    assert graph.match(nodes, edges, hop(nodes=("none",)), hop()).count() == 0


def test_what_a_change_may_break(spark, code):
    calls = code[1].where("kind = 'calls'")
    wanted = spark.createDataFrame([("one:pkg.core.helper",)], "id string")
    got = {r.id: r.distance for r in graph.reach(calls, wanted, backwards=True).collect()}
    assert got == {"one:pkg.core.helper": 0, "one:pkg.core.Base.step": 1, "one:pkg.work.Worker.go": 1, "two:main.start": 1, "one:pkg.core.Base.run": 2}
    assert graph.reach(calls, wanted, backwards=True, most=1).count() == 4 and graph.reach(calls, wanted).count() == 1


def test_merged_graphs(code):
    nodes, edges = graph_build.merged(code, code)
    assert nodes.count() == code[0].count() and edges.count() == code[1].count()


def test_a_way_of_many_nodes_takes_few_rounds(spark, monkeypatch):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(0, 100), (100, 2)], "src long, dst long")
    rounds = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or keep(df))
    assert [(r.step, r.id) for r in graph.path(edges, 0, n).orderBy("step").collect()] == [(k, k) for k in range(n + 1)]
    assert len(rounds) <= 2 * n.bit_length() + 1


def test_subtree_sizes_by_doubling(spark):
    rng = random.Random(2)
    up = {k: rng.choice([k - 1, rng.randrange(k)]) for k in range(1, 400)}
    sizes = collections.Counter()
    for k in range(400):
        at = k
        while at is not None:
            sizes[at] += 1
            at = up.get(at)
    frame = lambda rows: spark.createDataFrame(rows, "id long, parent long")
    got = lambda rows: {r.root: r.pages for r in pages.subtree_sizes(frame(rows)).collect()}
    assert got([(0, None), *up.items(), (5, up[5])]) == sizes
    assert got([(k, k - 1) for k in range(1, 1001)]) == {k: 1001 - k for k in range(1001)}
    assert got([]) == {} and got([(7, None), (None, 7)]) == {7: 1}
    # A cycle with a tail, beside a tree; and a page with two parents.
    assert got([(1, 3), (2, 1), (3, 2), (4, 3), (10, 11)]) == {1: 4, 2: 4, 3: 4, 4: 1, 10: 1, 11: 2}
    assert got([(2, 1), (3, 1), (4, 2), (4, 3)]) == {1: 4, 2: 2, 3: 2, 4: 1}
