from hashlib import sha256

from panelloom.llm import substrings
from tests.llm.data import docs, read


def brute(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_whole_table(spark, sf_dir):
    table = read(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in substrings.report(table).collect())
    assert got == brute(rows, 50)
    assert any(r[2] for r in got)


def test_edges(spark):
    run = " ".join(f"w{k}" for k in range(60))
    rows = [(1, run), (2, "x " + run + " y"), (3, None), (4, ""), (5, " ".join(["a"] * 200)), (6, " ".join(["a"] * 70)), (7, run[:100]), (8, " ".join(f"w{k}" for k in range(10, 59)))]
    table = docs(spark, rows)
    assert sorted(tuple(r) for r in substrings.report(table).collect()) == brute(rows, 50)
    assert substrings.report(docs(spark, [])).collect() == []


def test_null_ids_and_repeated_rows(spark):
    run = " ".join(f"w{k}" for k in range(60))
    table = docs(spark, [(1, run), (1, run), (None, run)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.report(table).collect()) == [(0, 60), (1, 0), (1, 0)]
