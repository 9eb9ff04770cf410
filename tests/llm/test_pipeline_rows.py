"""The pipeline on awkward rows, broken off and gone on with."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from panelloom.llm import bpe


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Tables with nulls, empties, repeated ids, long texts and clashing columns."""
    path = str(tmp_path_factory.mktemp("awkward"))
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "some words of a text that stands alone here", "x", 7), (1, "other words of quite another text under one id", "x", 7), (None, None, None, None), (None, "", "y", 1), (3, "password=hunter2hunter2 in a text of its own", "z", 2), (4, long, "z", 3), (5, long, "z", 3), (3, "password=hunter2hunter2 in a text of its own", "z", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, None), ("b", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_awkward_rows(spark, awkward):
    out = corpus_pipeline.run(spark, awkward)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "n_tokens_", "ids_sha256", "decoded_sha256", "ids_"]
    rows = out.collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in rows) == sorted([(1, 43), (1, 46), (0, 0), (3, len("[REDACTED] in a text of its own")), (4, 588_889)])
    assert all(len(r.ids_) == r.n_tokens_ for r in rows)


def test_empty_tables(spark, awkward, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_goes_on_after_a_break(spark, awkward, tmp_path, monkeypatch):
    work, calls = str(tmp_path / "work"), []

    def counted(name, stage):
        def wrapped(*args):
            calls.append(name)
            if name == "secret_scans" and calls.count(name) == 1:
                raise RuntimeError("lost")
            return stage(*args)

        return name, wrapped

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, awkward, work)
    assert corpus_pipeline.run(spark, awkward, work).count() == 5
    assert [calls.count(n) for n, _ in corpus_pipeline.STAGES] == [1, 1, 1, 2, 1]


def test_ids_are_those_of_the_tokenizer(spark, sf_dir):
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    peer = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for r in bpe.with_tokens(docs, path, public_tokenizers.PATTERN).collect():
        assert r.ids == peer.encode_ordinary(r.text or "")
