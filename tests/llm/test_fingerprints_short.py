from panelloom.llm import fingerprints as fp
from panelloom.llm.text import Rolling
from tests.llm.data import read
from tests.llm.test_fingerprints import shingles


def test_accuracy_at_every_length(spark, sf_dir):
    src = sorted(((r.doc_id, r.text or "") for r in read(spark, sf_dir).collect()), reverse=True)
    got = {r.doc_id: r for r in fp.report(read(spark, sf_dir)).collect()}
    off = {}
    for k, (i, t) in enumerate(src):
        nxt = src[(k + 1) % len(src)][1]
        own, other = shingles(t), shingles(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
        if own:
            off.setdefault(len(own).bit_length(), []).append(abs(got[i].near_edited - len(own & other) / len(own)))
    print({1 << (k - 1): (len(v), sum(v) / len(v), max(v)) for k, v in sorted(off.items())})
    assert len(off) > 8
    for k, v in off.items():
        assert max(v) < 0.2
        assert sum(v) / len(v) < (0.002 if k <= 7 else 0.04)  # below 128 shingles most texts are held whole


def test_merging_gives_the_sketch_of_both():
    r = Rolling()
    words = [str(i) for i in range(9000)]
    for n, m in ((3, 5), (100, 200), (200, 3000), (1000, 1500), (3, 9000), (2100, 9000)):
        x, y, both = (fp.sketch(" ".join(w).encode(), r, 1) for w in (words[:n], words[n // 2 : m], words[: max(n, m)]))
        joined = fp.parsed(fp.merged(fp.written(x), fp.written(y)))
        assert joined[1] == max(x[1], y[1]) and joined[0].tolist() == fp.sketch(" ".join(words[: max(n, m)]).encode(), r, 1, 2.0 ** -joined[1])[0].tolist() or joined[1] < both[1]
        for s in (x, y, both):
            again = fp.parsed(fp.written(s))
            assert again[0].tolist() == s[0].tolist() and again[1] == s[1]


def test_fractions_are_nested_and_fixed():
    assert [fp.fraction(n) for n in (0, 1, 512, 513, 1024, 1025, 2048, 2049, 10**6)] == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    r = Rolling()
    text = " ".join(map(str, range(20_000))).encode()
    for share in (1, 1 / 2, 1 / 4, 1 / 8):
        kept, halvings = fp.sketch(text, r, 1, share)
        assert 2.0**-halvings == share and abs(len(kept) / 20_000 - share) < 0.02
