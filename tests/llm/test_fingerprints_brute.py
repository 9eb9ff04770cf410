"""Fingerprints against sketches made plainly: every shingle hash, then a cut."""

import base64

import xxhash

from panelloom.llm import fingerprints as fp
from tests.llm.data import read

M = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
    return x ^ (x >> 31)


def hashes(text):
    words = [xxhash.xxh64_intdigest(w) for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    n = min(5, len(words))
    return sorted({mix(sum(h * pow(M, k, 1 << 64) for k, h in enumerate(words[i : i + n])) & FULL) for i in range(len(words) - n + 1)}) if words else []


def plain(text):
    """Kept hashes and how often the range is halved."""
    found = hashes(text)
    halvings = 0 if len(found) <= 512 else 1 if len(found) <= 1024 else 2 if len(found) <= 2048 else 3
    return [h for h in found if h < 2 ** (64 - halvings)], halvings


def written(s):
    return f"{s[1]}:" + base64.b64encode(b"".join(h.to_bytes(8, "big") for h in s[0])).decode() if s[0] else ""


def near(a, b):
    if not a[0] or not b[0]:
        return float(len(a[0]) == len(b[0]))
    bound = 2 ** (64 - max(a[1], b[1]))
    x, y = ({h for h in s[0] if h < bound} for s in (a, b))
    return len(x & y) / len(x) if x and y else 0.0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    src = sorted(((r.doc_id, r.text or "") for r in read(spark, sf_dir).collect()), reverse=True)
    got = {r.doc_id: r for r in fp.report(read(spark, sf_dir)).collect()}
    sketches = [plain(t) for _, t in src]
    for k, (i, t) in enumerate(src):
        after = (k + 1) % len(src)
        edited = plain(t[: len(t) - len(t) // 2] + src[after][1][: len(t) // 2])
        r = got[i]
        assert r.fingerprint == written(sketches[k]) and r.edited_fingerprint == written(edited)
        assert r.near_edited == near(sketches[k], edited) and r.near_next == near(sketches[k], sketches[after])
    assert {s[1] for s in sketches} >= {0, 1}
