"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe, chat, ctw, decontam, fingerprints, pages, quality, secrets, sharding, simhash, sql, substrings, whitening
from panelloom.llm.store import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hit_runs")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return secrets.report_increments(_table(spark, sf_dir, "documents"), ledger)


#: The contract's own conversation: its text looks like markers of templates.
HOSTILE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    return chat.report(conversations.unionByName(extra))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(_table(spark, sf_dir, "documents"))


#: Small enough to split the least tables into many shards.
SHARD_BYTES = 256 << 10


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.report(_table(spark, sf_dir, "pages"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_chat_format": op5_chat_format,
    "op6_fingerprints": op6_fingerprints,
    "op7_extendible_shards": op7_extendible_shards,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_context_tree_weighting": op10_context_tree_weighting,
    "op11_html_extraction": op11_html_extraction,
    "op12_embedding_whitening": op12_embedding_whitening,
}

#: The others rest on hashes or models that DuckDB lacks; tests/llm checks them by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": sql.DECONTAMINATION,
    "op4_secret_ledger": sql.SECRETS,
    "op5_chat_format": sql.CHAT,
    "op7_extendible_shards": sql.shards(SHARD_BYTES),
    "op8_substring_dedup": sql.SUBSTRINGS,
}
