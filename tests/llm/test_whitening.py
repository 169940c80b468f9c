"""Whitened embeddings against numpy's eigenvectors, exact integers and odd vectors."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import queries, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _against_numpy(rows, vectors, components=8):
    """rows of one length, as (key, component, n, deviation, whitened, explained, identity_error)."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dims)
    got = {}
    for key, component, m, deviation, whitened, explained, error in rows:
        assert m == n and error <= 1e-4
        assert abs(explained - values[component - 1] / values.sum()) <= 1e-8 * explained
        got[key, component] = (int(deviation), whitened)
    assert len(rows) == n * k == len(got)
    exact = {key: sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for (key, _), row in zip(vectors, x, strict=True)}
    assert all(exact[key] == d for (key, _), (d, _) in got.items())
    for c in range(1, k + 1):
        mine = np.array([got[key, c][1] for key, _ in vectors])
        want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6 * max(1, np.abs(want).max())


def test_query_equals_numpy(spark):
    rows = [tuple(r)[:7] for r in queries.op12_whitening(spark, SF).collect()]
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    _against_numpy(rows, vectors)


def _skewed(n=700, dims=12):
    rng = np.random.default_rng(3)
    return [(k, [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * np.geomspace(1, 50, dims) + 900)]


@pytest.mark.parametrize("parts", [1, 40])
def test_many_tasks_odd_vectors_and_clashing_columns(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK", 50)
    vectors = _skewed()
    odd = [(9001, None), (9002, [1.0] * 11 + [None]), (9003, [float("nan")] + [1.0] * 11), (9004, [float("inf")] * 12), (9005, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(parts).withColumns({c: F.lit("own") for c in ("key", "x", "n", "component", "Deviation")})
    _against_numpy([tuple(r) for r in whitening.whiten(df).collect()], vectors)


def test_lengths_are_fitted_apart(spark):
    vectors, short = _skewed(300), [(k, [float(k % 7), float(k * k % 11), 1.5 * k]) for k in range(1000, 1100)]
    df = spark.createDataFrame(vectors + short, "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in whitening.whiten(df).collect()]
    _against_numpy([r for r in rows if r[0] < 1000], vectors)
    _against_numpy([r for r in rows if r[0] >= 1000], short)


def test_repeats_nulls_and_no_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [0.5, 0.25])] * 3, kind)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 3 for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)] * 2, kind)).collect()
    assert len(line) == 20 and all((r.whitened is None) == (r.component == 2) and r.n == 10 for r in line)
    assert {round(r.explained, 12) for r in line} == {0.0, 1.0} and max(r.identity_error for r in line) < 1e-9


def test_large_entries_are_exact_and_bounded(spark):
    big = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [2.0**29, 2.0])]
    rows = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    x = [[int(1024 * max(-(2.0**30), min(2.0**30, c))) + 100000 for c in v] for _, v in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k + 1: sum((3 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for k, row in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in rows} == want


def test_rotations_equal_the_singular_value_decomposition():
    rng = np.random.default_rng(7)
    for shape in ((1, 1), (3, 5), (9, 9), (30, 8)):
        a = rng.normal(size=shape) * np.geomspace(1, 1e6, shape[1])
        sigma, v = whitening.jacobi(a)
        want = np.zeros(shape[1])
        want[: min(shape)] = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(sigma, want, rtol=1e-10, atol=1e-9 * want[0]) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
