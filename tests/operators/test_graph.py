import pytest

from panelloom.operators import graph


def groups(spark, text):
    """Ids in the order of the letters, each letter a digit that names a cluster."""
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(text)], "id long, cluster int")


def events(spark, before, after):
    return sorted((r.event, r.sources, r.targets, r.size_before, r.size_after) for r in graph.cluster_events(groups(spark, before), groups(spark, after)).collect())


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ("0000011111", "0000000111", [("grow", "0", "0", 5, 7), ("shrink", "1", "1", 5, 3)]),
        ("0000011111", "1111100000", [("continue", "0", "1", 5, 5), ("continue", "1", "0", 5, 5)]),
        ("00001111", "00000000", [("merge", "0,1", "0", 8, 8)]),
        ("00000000", "22223333", [("split", "0", "2,3", 8, 8)]),
        ("0000", "1234", [("birth", "", str(c), 0, 1) for c in range(1, 5)] + [("death", "0", "", 4, 0)]),
        ("", "", []),
    ],
)
def test_cluster_events(spark, before, after, want):
    assert events(spark, before, after) == want


def silhouette(spark, points, clusters):
    vectors = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(points)], "id long, vector array<double>")
    return tuple(graph.silhouette(vectors, groups(spark, clusters)).first())


def test_silhouette(spark, monkeypatch):
    want = (9.5 - 1) / 9.5 / 2 + (8.5 - 1) / 8.5 / 2
    for rows in (4096, 1):  # one block and several
        monkeypatch.setattr(graph, "BLOCK_ROWS", rows)
        assert silhouette(spark, [0, 1, 9, 10], "0011") == (pytest.approx(want), 0.0)
    assert silhouette(spark, [0, 5], "01") == (0.0, 0.0)
    assert silhouette(spark, [3, 3, 3, 3], "0011") == (0.0, 0.0)
    assert silhouette(spark, [0, 1], "00") == (None, None)
    assert silhouette(spark, [], "") == (None, None)
