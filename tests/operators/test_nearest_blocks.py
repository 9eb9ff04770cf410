import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import graph, neighbours
from tests.operators.test_clustering import table


def every(x, k, same=None):
    """``src, dst`` of the k nearest of one's group, ties to the least id."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    d[np.eye(len(x), dtype=bool)] = np.inf
    if same is not None:
        d[same[:, None] != same] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    return {(i, int(j)) for i, row in enumerate(order) for j in row if d[i, j] < np.inf}


def test_rows_of_a_group_are_sent_as_often_however_many_they_are(spark):
    rows = spark.range(60).select("id", F.array(F.rand(1)).alias("vector"), (F.col("id") % 3).cast("string").alias("group"))

    def sent(total):
        sizes = rows.select("group").distinct().select("group", F.lit(total // 3).alias("size"), F.lit(total).alias("total"))
        return graph.dealt_blocks(rows, sizes).count()

    assert sent(6_000) == sent(100_000) == sent(390_000) == 60 * 8
    assert sent(4_000) == 60 * 2


@pytest.mark.parametrize("kind", ["even", "shifted", "copies", "two scales"])
def test_single_precision_loses_no_neighbour(kind):
    x = np.random.default_rng(1).normal(size=(900, 5))
    x = {"even": x, "shifted": 1e8 + x, "copies": np.round(x[np.arange(900) // 60]), "two scales": np.where(np.arange(900)[:, None] < 450, x * 1e-7, 1e6 + x)}[kind]
    y = np.sort(np.random.default_rng(2).permutation(900)[:700])
    d = np.sqrt(((x[:, None] - x[y]) ** 2).sum(2))
    i, j, got = graph._nearest_in(x[y], x, 6)
    assert set(zip(*np.nonzero(d <= np.sort(d, 1)[:, 5:6]), strict=True)) <= set(zip(i, j, strict=True))
    assert np.allclose(got, d[i, j], rtol=1e-12, atol=0)


def test_neighbours_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 50)
    x = np.round(np.random.default_rng(3).normal(size=(300, 2)), 1)
    got = {(r["src"], r["dst"]) for r in graph.knn(table(spark, x), 4).collect()}
    assert got == every(x, 4)
    light = table(spark, x).withColumn("vector", F.col("vector").cast("array<float>"))
    groups = light.select("id", (F.col("id") % 2).alias("group"))
    got = {(r["src"], r["dst"]) for r in neighbours.knn_within(light, groups, 4).collect()}
    assert got == every(x.astype(np.float32).astype(float), 4, np.arange(300) % 2)
