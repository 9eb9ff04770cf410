import random

import numpy as np

from panelloom.llm import simhash
from panelloom.llm.components import connected_components
from tests.llm.data import docs


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(4000)]
    rows, copies, far = [], [], []
    for base in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 600))]
        rows.append((10 * base, " ".join(words)))
        for k, edits in enumerate((1, 2, len(words) // 50, len(words) // 4)):
            new = list(words)
            for _ in range(edits):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((10 * base + k + 1, " ".join(new)))
            a, b = shingles(rows[-1][1]), shingles(" ".join(words))
            alike = len(a & b) / len(a | b)
            (copies if alike >= 0.8 else far if alike < 0.4 else []).append(rows[-1][0])
    kept = {r.doc_id for r in simhash.keep_one_each(docs(spark, rows)).collect()}
    assert {10 * b for b in range(120)} <= kept
    assert len(copies) > 200 and sum(i not in kept for i in copies) >= 0.9 * len(copies)
    assert len(far) > 50 and all(i in kept for i in far)


def test_recall_and_precision_on_the_given_documents(spark):
    """Of all row pairs of sf0.1 with 0.8 <= J < 1, and no row lost that is near none."""
    from tests.llm.data import read

    table = read(spark, "/root/testdata/sf0.1")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(frozenset(shingles(t or "")), []).append(i)
    keys = sorted(groups, key=lambda s: min(groups[s]))
    holders = {}
    for n, s in enumerate(keys):
        for h in s:
            holders.setdefault(h, []).append(n)
    common = {}
    for at in holders.values():
        if len(at) < 400:  # such a shingle alone makes no pair near
            for x, i in enumerate(at):
                for j in at[x + 1 :]:
                    common[i, j] = common.get((i, j), 0) + 1
    near = {(i, j) for (i, j) in common if len(keys[i] & keys[j]) >= 0.8 * len(keys[i] | keys[j])}
    assert len(near) > 40
    root = {r.doc_id: r.root for r in simhash.near_components(table).collect()}
    joined = [(i, j) for i, j in near if root[groups[keys[i]][0]] == root[groups[keys[j]][0]]]
    weight = lambda p: len(groups[keys[p[0]]]) * len(groups[keys[p[1]]])
    assert len(joined) >= 0.97 * len(near) and sum(map(weight, joined)) >= 0.97 * sum(map(weight, near))
    assert all(len({root[i] for i in g}) == 1 for g in groups.values())
    partners = {}
    for i, j in near:
        partners.setdefault(i, set()).add(j)
        partners.setdefault(j, set()).add(i)
    sizes = {}
    for n, s in enumerate(keys):
        sizes.setdefault(root[groups[s][0]], set()).add(n)
    for members in sizes.values():
        assert len(members) == 1 or all(partners.get(n, set()) & members for n in members)


def test_row_near_a_member_of_a_crowd_but_not_its_leader():
    rng = np.random.default_rng(1)
    for crowd in (5, 9, 70, 300):
        leader = rng.integers(0, 1 << 63, simhash.WIDE, dtype=np.uint64)
        rows = [leader.copy() for _ in range(crowd)]
        for k in range(1, crowd):
            rows[k][4] ^= np.uint64(k)
        member, outside = rows[-1], None
        for w in (1, 2, 3):
            member[w] ^= np.uint64(0x1FFFFF << 7)  # 63 bits from the leader
        outside = member.copy()
        outside[0] ^= np.uint64(1)
        for w in (1, 2, 3, 4):
            outside[w] ^= np.uint64(0xFF0000FF00000000 >> 3)
        rows.append(outside)
        wide = np.array(rows)
        fps = wide[:, 0] & np.uint64(0xFFFFFFFF)
        a, b = simhash._join_tries(np.zeros((len(rows), 2), np.int64), fps, simhash.HALF_BUDGET, wide)
        moved, root = simhash._spanning(len(rows), a, b)
        assert len(moved) == crowd and set(root.tolist()) == {0}
        assert (np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1) <= simhash.WIDE_BUDGET).all()
        assert len(a) <= 6 * crowd or crowd < 10


def test_exact_similarity_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPOKES", 3)
    sets = {0: range(100), **{i: range(i, 100 + i) for i in range(1, 30)}, 30: []}
    rows = [(n, np.array(sorted(s), np.uint64).tobytes()) for n, s in sets.items()]
    table = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "node long, hashes binary")
    pairs = [(0, i) for i in range(1, 31)] + [(3, 4), (1, 29)]
    got = {(r.a, r.b) for r in simhash.alike(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    want = {(a, b) for a, b in pairs if sets[b] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert got == want and (0, 11) in got and (0, 12) not in got


def test_crowds_and_split_tries_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, (6, simhash.WIDE), dtype=np.uint64)
    rows = []
    for n in range(900):
        bits = np.unpackbits(centres[n % 6].view(np.uint8))
        flips = rng.choice(64 * simhash.WIDE, rng.integers(0, 20), replace=False)
        if n < 300:
            flips = flips[flips >= 64]  # a crowd of equal first words
        bits[flips] ^= 1
        rows.append((n, *np.packbits(bits).view(np.uint64).astype(np.int64).tolist()))
    classes = spark.createDataFrame([(*r, 100) for r in rows], "node long, " + ", ".join(f"{w} long" for w in (*simhash.WORDS, "size")))
    for limit in (40, 50_000):
        roots = {r.node: r.root for r in connected_components(simhash.wide_links(classes, trie_rows=limit)).collect()}
        groups = {}
        for n, *_ in rows:
            groups.setdefault(roots.get(n, n), set()).add(n % 6)
        assert len(groups) == 6 and all(len(g) == 1 for g in groups.values())
