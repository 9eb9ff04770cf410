import hashlib

import xxhash

from panelloom.llm import fingerprints as fp
from panelloom.llm.text import Rolling
from tests.llm.data import docs, read


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_whole_table(spark, sf_dir):
    src = sorted(((r.doc_id, r.text or "") for r in read(spark, sf_dir).collect()), reverse=True)
    got = {r.doc_id: r for r in fp.report(read(spark, sf_dir)).collect()}
    assert len(got) == len(src)
    off = []
    for k, (i, t) in enumerate(src):
        nxt = src[(k + 1) % len(src)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other = shingles(t), shingles(edited)
        if len(own) > 400:
            off.append(abs(r.near_edited - len(own & other) / len(own)))
        assert 0 <= r.near_next <= 1
    assert off and sum(off) / len(off) < 0.06
    same = {}
    for i, t in src:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_edges(spark):
    t = [(1, None), (2, ""), (3, "one"), (4, "one two three four five six"), (4, "other"), (None, "last"), (9, "w " * 30000), (8, "w " * 30000)]
    got = fp.report(docs(spark, t).selectExpr("*", "1 as bucket", "2 as guest")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((i, len(x or "")) for i, x in t if i is not None)
    by = {r.doc_id: r for r in got}
    assert by[9].near_next == 1.0 and by[9].fingerprint == by[8].fingerprint
    assert by[2].near_next == 1.0 and by[2].fingerprint == ""  # null is empty
    assert by[3].edited_sha256 == hashlib.sha256(b"on").hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"law ").hexdigest()
    assert fp.report(docs(spark, [])).collect() == []
    one = fp.report(docs(spark, [(7, "a b")])).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a a").hexdigest()


def test_merge_and_containment():
    r = Rolling()
    a, b = " ".join(map(str, range(4000))), " ".join(map(str, range(2000, 6000)))
    x, y = fp.sketch(a.encode(), r), fp.sketch(b.encode(), r)
    both = fp.parsed(fp.merged(fp.written(x), fp.written(y)))
    assert abs(fp.likeness(x, y)[0] - 0.5) < 0.1
    assert fp.likeness(x, both)[0] == 1.0 and abs(fp.likeness(both, x)[0] - 2 / 3) < 0.1
    assert fp.parsed(fp.written(x))[0].tolist() == x[0].tolist()
    assert xxhash.xxh64_intdigest(b"") is not None
