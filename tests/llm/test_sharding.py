import hashlib

from panelloom.llm import sharding
from tests.llm.data import docs, read


def bits(x):
    return f"{int(hashlib.md5(x.encode()).hexdigest()[:15], 16):060b}"


def brute(rows, limit):
    """Split recursively; only ids decide, so they must be distinct."""
    out = {}

    def place(some, prefix):
        if sum(n for _, _, n in some) <= limit or len(some) == 1:
            for i, _, n in some:
                out[i] = (n, prefix, len(prefix), sum(x[2] for x in some), len(some))
            return
        for b in "01":
            if part := [x for x in some if x[1][len(prefix)] == b]:
                place(part, prefix + b)

    place([(i, bits("" if i is None else str(i)), len((t or "").encode())) for i, t in rows], "")
    return out


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir).collect()]
    for limit in (5000, 200_000, 1 << 40):
        got = {r.doc_id: tuple(r)[1:] for r in sharding.assign(read(spark, sf_dir), limit=limit).collect()}
        assert got == brute(rows, limit)


def test_copies_nulls_and_long_rows(spark):
    t = [(1, "x" * 100)] * 40 + [(1, "y" * 100)] * 5 + [(None, None), (2, ""), (3, "z" * 5000)]
    got = sharding.assign(docs(spark, t).selectExpr("*", "1 as bits", "2 as shard"), limit=250).collect()
    assert len(got) == len(t)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == size[r.shard] and (r.shard_bytes <= 250 or r.shard_rows == 1) for r in got)
    assert sharding.assign(docs(spark, []), limit=10).collect() == []


def test_write(spark, sf_dir, tmp_path):
    d = read(spark, sf_dir)
    sharding.write_shards(d, str(tmp_path / "out"), limit=300_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in d.collect())
    sizes = back.selectExpr("shard", "octet_length(text) as n").groupBy("shard").sum("n").collect()
    assert len(sizes) > 4 and all(r[1] <= 300_000 for r in sizes)
