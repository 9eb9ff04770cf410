"""A training-data pipeline: documents in, cleaned texts with their token ids out.

Each stage is written as Parquet and read again by the next one, so that a
lost executor costs one stage at most.  Rows of any kind go through: each
stage says what it does with nulls, empty and repeated texts; columns may have
any names, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import bpe, decontam, quality, secrets, simhash
from panelloom.llm.store import digest_of, discard, materialize, resumed, scratch

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A session's setting that names the folder of a ledger of scanned texts, which later runs go on with.
LEDGER = "panelloom.secret.ledger"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier rejects; repeated and null ids are judged row by row."""
    return quality.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id, null ids last."""
    return simhash.keep_one_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated texts; null and empty texts stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced in their texts; null texts stay null.

    Texts that the ledger named by ``LEDGER`` has are not scanned again.
    """
    path = spark.conf.get(LEDGER, None)
    return secrets.redact(docs, ledger=secrets.Ledger(spark, path) if path else None)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with token ids, their number, and digests of ids and decoded bytes."""
    return bpe.with_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_level_bpe", byte_level_bpe),
]


#: What the rows of a stage depend on beside its input.
SETTINGS = repr([simhash.ALIKE, simhash.WIDE, simhash.WIDE_BUDGET, simhash.HALF_BUDGET, secrets.version_of(secrets.RULES), RANKS, public_tokenizers.PATTERN, quality.SETTINGS])


def run(spark: SparkSession, sf_dir: str, work_dir: str | None = None) -> DataFrame:
    """All stages, in turn.

    With a ``work_dir`` each stage's rows stay there under its name, stamped by
    a digest of the given files, of ``SETTINGS`` and of the stages before, and
    a run that was broken off goes on after the last stage that was written
    whole of the same.  Without one a stage's rows are deleted once the next
    one's are written.  Tables that stages write on their way are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stamp = digest_of(spark, *(f"{sf_dir}/{n}.parquet" for n in ("documents", "labels", "benchmark"))) if work_dir else ""
    for place, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch() as keep:
            if work_dir:
                stamp = hashlib.sha256(f"{stamp}|{name}|{SETTINGS}".encode()).hexdigest()
                docs = resumed(spark, f"{work_dir.rstrip('/')}/{place}-{name}", lambda: stage(spark, before, sf_dir), stamp)  # noqa: B023
            else:
                docs = materialize(stage(spark, before, sf_dir), name)
                keep.append(docs)
        if not work_dir:
            discard(before)
    return docs


#: Hashed n-gram models and fingerprints are beyond SQL; tests/llm/test_pipeline.py
#: checks the stages against plain ones.
ORACLE_SQL = None
