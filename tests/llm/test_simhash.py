import random

import numpy as np
import xxhash

from panelloom.llm import simhash
from panelloom.llm.components import connected_components
from tests.llm.data import docs, read


def fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else (" " if c in "\t\n\x0b\x0c\r" else c) for c in text or "").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """Ids with fingerprints, by comparing all of them."""
    parent = {f: f for _, f in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                parent[root(x)] = root(y)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in pairs), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    d = read(spark, sf_dir)
    want = components([(r.doc_id, fingerprint(r.text)) for r in d.collect()])
    got = rows(simhash.near_duplicates(d))
    assert got == want
    assert len({r[2] for r in got}) < len(got)


def test_edges(spark):
    t = [(5, None), (3, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (4, "one  two"), (4, "one\ttwo"), (6, "wörter ÄÖ x" * 2000), (None, "one"), (7, "a b c d"), (8, "a b c d")]
    assert rows(simhash.near_duplicates(docs(spark, t).selectExpr("*", "1 as fp", "2 as component_id"))) == components([(i, fingerprint(x)) for i, x in t])
    assert rows(simhash.near_duplicates(docs(spark, []))) == []
    kept = simhash.keep_one_each(docs(spark, t).selectExpr("*", "1 as fp"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 6, 7]


def test_dense_tries_split_and_join(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(300)}
    fps = sorted(f & (2**64 - 1) for f in fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = {(x, r) for x, _, r in components([(f, f) for f in fps])}
    for limit in (10, 50_000):
        root = {r.node: r.root for r in connected_components(simhash.near_links(df, trie_rows=limit)).collect()}
        groups = {}
        for (s,), f in zip(signed, fps, strict=True):
            groups.setdefault(root.get(s, s), []).append(f)
        assert {(f, min(g)) for g in groups.values() for f in g} == want


def test_long_chain_of_links(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (None, 3)], "a long, b long")
    got = connected_components(e).collect()
    assert sorted(r.node for r in got) == list(range(n + 1)) and {r.root for r in got} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
