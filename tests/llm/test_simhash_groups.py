import numpy as np
import pytest

from panelloom.llm import simhash
from panelloom.llm.components import connected_components
from tests.llm.data import docs


def roots_of(sets):
    """The least number that each set reaches by links of a similarity of 0.8 or more."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("block", [8, 1024])
def test_every_alike_pair_of_a_group_is_joined(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    sets = [set(range(100)) ^ set(rng.integers(0, 400, rng.integers(8, 26)).tolist()) for _ in range(90)]
    rows = [(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in enumerate(sets)]
    label = [0 if n in (0, 1) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) else n for n in range(90)]
    members = spark.createDataFrame([(n, 7, label[n]) for n in range(90)], "node long, group long, label long")
    links = simhash.alike_within(members, spark.createDataFrame(rows, "node long, hashes binary"))
    known = spark.createDataFrame([(n, x) for n, x in enumerate(label) if n != x], "a long, b long")
    got = {r.node: r.root for r in connected_components(links.unionByName(known)).collect()}
    want = roots_of(sets)
    assert [got.get(n, n) for n in range(90)] == want and 5 < len(set(want)) < 85


def test_parities_tell_no_more_than_is_different():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 3000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n + 5, dtype=np.uint64)) for _ in range(2))
        b[:n] = a[:n]
        apart = np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum()
        assert 0 < apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_members_of_a_crowd_are_joined_past_its_leaders(spark, monkeypatch):
    """A chain through a crowd: neighbours are alike, none is like the leader, and each has many nearer partners."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for star in range(40):
        words = list(base)
        for at in rng.choice(400, 14, replace=False):
            words[at] = f"s{star}x{at}"
        texts.append(" ".join(words))
    for n in range(6):  # pairs alike with each other at the edge of the crowd
        words = list(base)
        for at in rng.choice(400, 22, replace=False):
            words[at] = f"e{n}x{at}"
        texts.append(" ".join(words))
        words[3] = f"more{n}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for t in texts]
    want = roots_of(sets)
    got = {r.doc_id: r.root for r in simhash.near_components(docs(spark, list(enumerate(texts)))).collect()}
    assert len(set(want)) > 20
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
