import itertools

import numpy as np
import pytest

from panelloom.operators import neighbours


def test_geometric_meets_each_pair_once(spark):
    x = np.random.default_rng(1).uniform(-1, 1, (60, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    found = neighbours.geometric(points, 0.3)
    assert "SortMergeJoin" in found._jdf.queryExecution().sparkPlan().toString()
    gap = lambda i, j: float(np.sqrt(((x[i] - x[j]) ** 2).sum()))
    want = {(i, j): np.exp(-((gap(i, j) / 0.3) ** 2)) for i, j in itertools.combinations(range(60), 2) if gap(i, j) <= 0.3}
    got = found.collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.weight for r in got} == pytest.approx(want)


def test_a_region_is_many_tasks(spark):
    nodes = spark.range(200).selectExpr("id", "0 as region")
    found = neighbours.same_region(nodes)
    assert "part" in found._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")[1].split("\n")[0]
    assert found.count() == 200 * 199 / 2
