"""Labels exchanged within regions, a share of the draws in a task."""

import hashlib

import numpy as np
import pytest

from panelloom.functions.digests import digests
from panelloom.operators import regression
from panelloom.plans import statistics


def test_digests_are_md5():
    for texts in ([b"", b"1", b"4711", b"x" * 40], ["ключ".encode(), b"z" * 70], [str(i).encode() for i in range(20_000)], []):
        prefixes = [b"9:0:", b"9:10:", b"9:11:", b""]
        for prefix, got in zip(prefixes, digests(prefixes, texts), strict=True):
            want = [hashlib.md5(prefix + t).digest() for t in texts]
            assert [b"".join(int(v).to_bytes(8, "big") for v in row) for row in got] == want


def plain(rows, draws, seed):
    """``eta2, p`` by loops."""
    groups = {}
    for k, y, g, r in sorted(rows):
        groups.setdefault(r, []).append((k, y, g))
    values = {r: [y - np.mean([m[1] for m in part]) for _, y, _ in part] for r, part in groups.items()}

    def eta(labels):
        by = {}
        for r in groups:
            for y, g in zip(values[r], labels[r], strict=True):
                by.setdefault(g, []).append(y)
        every = np.concatenate(list(by.values()))
        return sum(len(v) * (np.mean(v) - every.mean()) ** 2 for v in by.values()) / ((every - every.mean()) ** 2).sum()

    own, reached = eta({r: [m[2] for m in part] for r, part in groups.items()}), 0
    for d in range(draws):
        moved = {r: [m[2] for m in sorted(part, key=lambda m: (hashlib.md5(f"{seed}:{d}:{m[0]}".encode()).hexdigest(), m[0]))] for r, part in groups.items()}
        reached += eta(moved) >= own - 1e-12
    return own, (1 + reached) / (1 + draws)


@pytest.mark.parametrize("most", [500_000, 20, 1])
def test_permutations_by_loops(spark, monkeypatch, most):
    """Whole strata in a task, some or all of them too large for one."""
    monkeypatch.setattr(regression, "STRATUM_ROWS", most)
    draw = np.random.default_rng(5)
    rows = [(int(i) * 7 % 1000, float(draw.normal() + 0.3 * (i % 3)), f"s{i % 3}", int(draw.integers(1, 3) * draw.integers(1, 3))) for i in range(90)]
    table = spark.createDataFrame(rows, "id long, y double, seg string, region long")
    got = regression.permutation_test(table, "id", "y", "seg", "region", 60, 9).first()
    want = plain(rows, 60, 9)
    assert got.eta2 == pytest.approx(want[0], abs=1e-12) and got.p == pytest.approx(want[1], abs=1e-12)


def test_no_rows(spark):
    got = regression.permutation_test(spark.createDataFrame([], "id long, y double, seg string, region long"), "id", "y", "seg", "region", 5, 1).first()
    assert got is None or got.eta2 is None


def test_the_query_takes_all_draws(spark, sf_dir, monkeypatch):
    taken = []
    monkeypatch.setattr(statistics.regression, "permutation_test", lambda *a: taken.append(a[5]) or spark.createDataFrame([(0.0, 1.0)], "eta2 double, p double"))
    statistics.permutation_test(spark, sf_dir)
    assert taken == [999]
