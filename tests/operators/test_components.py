"""Connected components: plans that stay small, stars of many links."""

import random

from panelloom.operators import components


def test_no_plan_reads_its_links_many_times(spark, monkeypatch):
    reads = []

    def seen(df, name):
        reads.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, name)

    write = components.materialize
    monkeypatch.setattr(components, "materialize", seen)
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (8, 9)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert max(reads) <= 3


def test_centres_of_many_links_join_their_stars(spark):
    rng = random.Random(5)
    hubs = {-7: range(1000, 1400), 5000: range(1390, 1900), 1000: range(6000, 6200)}  # either end of the order, and shared leaves
    links = [(h, x) for h, xs in hubs.items() for x in xs] + [(20_000 + k, 20_001 + k) for k in range(0, 40, 2)] + [(1000, 1000), (None, 3)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    one = {-7, 5000, *range(1000, 1900), *range(6000, 6200)}
    assert got == dict.fromkeys(one, -7) | {20_000 + k: 20_000 + k - k % 2 for k in range(40)}
