"""Whitening against the covariance matrix, formed here in whole numbers."""

import math
import random

import numpy as np
import pytest

from panelloom.llm import whitening
from panelloom.llm.queries import QUERIES


def expected(vectors):
    whole = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n = len(whole)
    sums = [sum(c) for c in zip(*whole, strict=True)]
    off = [[n * x - s for x, s in zip(row, sums, strict=True)] for row in whole]
    centred = np.array(off, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = values.argsort()[::-1]
    return [sum(x * x for x in row) for row in off], centred, values[order], axes[:, order]


def check(rows, vectors, places, components):
    deviation, centred, values, axes = expected(vectors)
    assert len(rows) == len(vectors) * components
    got = np.full((len(vectors), components), np.nan)
    for r in rows:
        at = places[r.vec_id]
        got[at, r.component - 1] = r.whitened
        assert r.n == len(vectors) and r.deviation == deviation[at]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error <= 1e-9
    want = centred @ axes[:, :components] / np.sqrt(values[:components])
    for c in range(components):
        sign = np.sign(got[:, c] @ want[:, c])
        assert np.allclose(got[:, c], sign * want[:, c], atol=1e-7)


def test_query_against_the_covariance(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    check(QUERIES["op12_embedding_whitening"](spark, sf_dir).collect(), [r.embedding for r in given], {r.vec_id: i for i, r in enumerate(given)}, 8)


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_factors_of_many_partitions(spark, parts):
    dice = random.Random(5)
    vectors = [[dice.gauss(0, 1 + d) for d in range(5)] for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(parts)
    check(whitening.report(table).collect(), vectors, {i: i for i in range(200)}, 5)


def test_rows_that_are_left_out_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [-1.0, 5.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, None), (8, [1.0]), (9, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clash = table.selectExpr("*", "'x' AS component", "'x' AS n", "'x' AS deviation", "'x' AS whitened", "'x' AS part", "'x' AS factor")
    for t in (table, clash):
        got = whitening.report(t)
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        found = sorted(got.collect(), key=lambda r: (r.vec_id or 0, r.component))
        assert [(r.vec_id, r.component, r.n) for r in found] == [(None, 1, 4), (None, 2, 4), (1, 1, 4), (1, 2, 4), (2, 1, 4), (2, 1, 4), (2, 2, 4), (2, 2, 4)]
        whitened = np.array([r.whitened for r in found]).reshape(-1)
        assert abs(whitened[[0, 2]].sum() + whitened[[4, 5]].sum()) < 1e-9


def test_directions_without_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whitening.report(flat).collect()
    assert [r.component for r in got] == [1] * 6 and all(math.isclose(r.explained, 1) for r in got)
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(6)], "vec_id long, embedding array<double>")
    assert whitening.report(same).collect() == []
    assert whitening.report(same.limit(0)).collect() == []
    assert whitening.report(same.limit(1)).collect() == []


def test_deviation_beyond_a_long(spark):
    wide = spark.createDataFrame([(i, [9e11 * i, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    exact = {r.vec_id: r.deviation for r in whitening.whiten(wide).collect()}
    step = math.floor(1024 * 9e11)
    assert exact == {0: (3 * step) ** 2, 1: 0, 2: (3 * step) ** 2}
    assert {r.deviation for r in whitening.report(wide).collect()} == {0, None}
