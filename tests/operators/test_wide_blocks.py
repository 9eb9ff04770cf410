import numpy as np
import pytest

from panelloom.operators import graph, models
from tests.operators.test_clustering import table


def test_blocks_stay_as_many_while_they_are_not_too_wide():
    assert [graph.wide_blocks(n) for n in (1, 4096, 4097, 100_000, 600_000)] == [1, 1, 2, 12, 12]


def test_small_distances_do_not_cancel(monkeypatch):
    monkeypatch.setattr(graph, "STRIP", 6)
    x = 1e4 + np.random.default_rng(1).normal(size=(9, 3)) * 1e-5
    assert np.allclose(graph.distances(x, x), np.sqrt(((x[:, None] - x) ** 2).sum(2)), rtol=1e-12, atol=0)


def test_rows_are_sent_as_often_however_many_they_are(spark):
    rows = table(spark, np.random.default_rng(2).normal(size=(50, 3)))
    sent = lambda n: graph._paired(rows, n, graph.wide_blocks(n), graph.wide_blocks(n)).count().agg({"count": "sum"}).first()[0]
    assert sent(600_000) == sent(100_000) == 50 * 24


def test_silhouettes_of_rules_that_change_few_labels(spark):
    x = np.random.default_rng(3).normal(size=(60, 2))
    first = (np.array([[0.0, 1.0], [0.0, -1.0], [1.0, 0.0]]), np.zeros(3))
    rules = [first, (first[0] + [[0.3, 0], [0, 0], [0, 0]], np.zeros(3)), (first[0], np.array([0.4, -0.2, -0.2]))]
    size = np.stack([np.bincount(z, minlength=3) for z in models._nearest_of(x, rules).T])
    got = models.silhouettes(table(spark, x), rules, size, len(x))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for rule, z in zip(range(3), models._nearest_of(x, rules).T, strict=True):
        fit = []
        for i in range(60):
            a = d[i, z == z[i]].sum() / max((z == z[i]).sum() - 1, 1)
            b = min(d[i, z == c].mean() for c in set(z.tolist()) - {z[i]})
            fit.append((b - a) / max(a, b) if (z == z[i]).sum() > 1 else 0.0)
        assert got[rule] == pytest.approx(np.mean(fit), abs=1e-12)
