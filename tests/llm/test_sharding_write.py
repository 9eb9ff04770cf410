from collections import Counter

from panelloom.llm import sharding
from tests.llm.data import docs


def test_every_row_is_written_once_whatever_its_id(spark, tmp_path):
    t = [(1, "x" * 100)] * 6 + [(1, "y" * 100), (None, None), (None, "z" * 90), (2, "")]
    d = docs(spark, t).selectExpr("*", "'mine' as shard", "7 as _row")
    name = sharding.write_shards(d, str(tmp_path / "out"), limit=250)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and set(back.columns) == {"doc_id", "text", "shard", "_row", "shard_"}
    got = back.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(t)
    assert {(r.shard, r._row) for r in got} == {("mine", 7)}
    size = Counter()
    for r in got:
        size[r.shard_] += len(r.text or "")
    assert len(size) > 2 and all(s <= 250 for s in size.values())


def test_empty_table(spark, tmp_path):
    assert sharding.write_shards(docs(spark, []), str(tmp_path / "out")) == "shard"
