import hashlib
import random
import re

from panelloom.llm import decontam
from tests.llm.data import docs, read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(doc_rows, item_rows, window=13):
    index = {}
    for item, text in item_rows:
        w = WORD.findall(lower(text or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            index.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in index}
    out = []
    for doc, text in doc_rows:
        w = WORD.findall(lower(text or ""))
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := index.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    d, b = read(spark, sf_dir), read(spark, sf_dir, "benchmark")
    got = rows(decontam.contamination_report(d, b))
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert got == want
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_edges_blocks_and_short_items(spark):
    items = [(1, "one two three"), (2, "Zwei, DREI! vier"), (3, None), (4, "..."), (5, "x"), (6, "a b c d e f g h i j k l m n"), (6, "one two three"), (None, "grün straße")]
    texts = [(1, "ONE two-three four"), (2, "zwei drei vier zwei drei vier"), (3, None), (4, ""), (5, "x " * 3000), (6, "z a b c d e f g h i j k l m n one two three"), (6, "z a b c d e f g h i j k l m n one two three"), (7, "one two"), (None, "grün straße x")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert rows(decontam.contamination_report(docs(spark, texts), b)) == want
    by_blocks = decontam.find_contamination(docs(spark, texts), b, block_bytes=20)
    assert sorted(r._n_words for r in by_blocks.collect()) == sorted(r[1] for r in want)
    assert sorted(len(r._hit_items) for r in by_blocks.collect()) == sorted(r[3] for r in want)
    assert sorted(sum(r._hit_runs[1::2]) - sum(r._hit_runs[::2]) for r in by_blocks.collect()) == sorted(r[2] for r in want)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    clash = docs(spark, [(1, "one two")]).selectExpr("*", "5 as n_words", "6 as _n_words", "7 as item_id")
    assert rows(decontam.contamination_report(clash, none)) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert rows(decontam.contamination_report(docs(spark, []), none)) == []
    assert decontam.drop_contaminated(clash.drop("_n_words"), none).columns == ["doc_id", "text", "n_words", "item_id"]


def test_repeated_long_and_many_items_in_blocks(spark):
    """Repeats count once, a long item goes in parts, and no block is larger than it may be."""
    rng = random.Random(4)
    item = [f"w{rng.randrange(400)}" for _ in range(900)]
    items = [(1, "the same words again and again " * 3)] * 3000 + [(2, " ".join(item))] + [(i, " ".join(f"x{i}y{k}" for k in range(15))) for i in range(3, 200)]
    texts = [(1, " ".join(item[100:160])), (2, " ".join(item)), (3, "x7y1 " + " ".join(f"x7y{k}" for k in range(14))), (4, "again the same words again and again the same words again and again the same"), (5, " ".join(item[880:]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    pieces = decontam._pieces(b, "item_id", "text", 13, 500)
    held = [(r.item, r.text) for r in pieces.collect()]
    assert sum(i == "1" for i, _ in held) == 1 and sum(i == "2" for i, _ in held) > 5 and all(len(t) < 600 for _, t in held)
    dealt, blocks = decontam._blocks(pieces, 2000)
    sizes = {}
    for r in dealt.collect():
        sizes.setdefault(r.block, []).append(len(r.text))
    assert blocks > 3 and max(map(sum, sizes.values())) <= 2000
    want = {r[0]: r for r in brute(texts, items)}
    found = decontam.find_contamination(docs(spark, texts), b, block_bytes=2000)
    for r in found.collect():
        assert (r._n_words, sum(r._hit_runs[1::2]) - sum(r._hit_runs[::2]), len(r._hit_items)) == want[r.doc_id][1:4]


def test_large_vocabulary(spark):
    words = [f"{i:x}" for i in range(600_000)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    text = " ".join(words[550_000:550_020])
    got = decontam.contamination_report(docs(spark, [(1, text), (2, text + " other" * 20)]), b).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 20, 2: 20}
