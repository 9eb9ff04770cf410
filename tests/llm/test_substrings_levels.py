"""However hashes are dealt, the words removed are the same."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import substrings
from tests.llm.data import docs, read
from tests.llm.test_substrings import brute


def digests(out):
    return sorted((r.doc_id, r.n_words, r.n_removed, sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())


@pytest.mark.parametrize("bucket_bytes, fan_out, held", [(20_000, 4096, 2_000_000), (20_000, 16, 20_000)])
def test_more_buckets_and_a_second_level(spark, sf_dir, monkeypatch, bucket_bytes, fan_out, held):
    monkeypatch.setattr(substrings, "HELD", held)
    table = read(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert sum(len((t or "").encode()) for _, t in rows) > 64 * bucket_bytes
    assert digests(substrings.remove_repeats(table, bucket_bytes=bucket_bytes, fan_out=fan_out)) == brute(rows, 50)


def test_passage_in_every_document(spark):
    random.seed(3)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, " ".join([*(f"x{random.random()}" for _ in range(i % 30)), passage, f"y{i}"])) for i in range(300)]
    got = digests(substrings.remove_repeats(docs(spark, rows), bucket_bytes=5000, fan_out=4))
    assert got == brute(rows, 50)
    assert sum(r[2] == 70 for r in got) == 299


def test_clashing_columns(spark):
    run = " ".join(f"w{k}" for k in range(60))
    table = docs(spark, [(1, run), (2, run)])
    for name in ("doc", "kind", "hashes", "bucket"):
        table = table.withColumn(name, F.lit("user"))
    assert [r.n_removed for r in substrings.report(table).orderBy("doc_id").collect()] == [0, 60]


def test_hashes_equal_in_one_number_only():
    hashes = np.array([[5, 5, 5, 7], [1, 2, 1, 1]], np.uint64)
    order, first = substrings._alike(hashes)
    assert [hashes[:, i].tolist() for i in order[first]] == [[5, 1], [5, 2], [7, 1]]
    assert substrings._among(hashes, np.array([[5], [2]], np.uint64)).tolist() == [1]


def test_parts_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 10**12, -(2**63), 2**63 - 1]
    want = [r.p for r in spark.createDataFrame([(i,) for i in ids], "doc long").select(F.pmod(F.xxhash64("doc"), F.lit(37)).alias("p")).collect()]
    assert substrings.part_of(np.array(ids, np.int64), 37).tolist() == want
