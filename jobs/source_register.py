"""Registers source texts: content hashes, copies, conflicting ids, number tokens, review marks.

Each document gets a row that says what a reviewer of sources asks first: the
SHA-256 of its text, the least id that has the same text and how many have it,
whether its id also stands for another text, how long it is, how many of its
tokens hold digits and how many of these are numbers, and what the labels say.

    python -m jobs.source_register --config jobs/source_register.json

Output: Parquet in ``output``, partitioned by ``source``, replaced as a whole,
so that a rerun gives the same rows and a broken run is mended by the next.

A null text counts as empty; documents without an id or a source are counted
and left out; repeated rows stay.  Several labels of an id count as the worse.
A token is what lies between blanks, tabs and line ends.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import settings, start
from panelloom.functions import text as T
from panelloom.sources.shared import discard, materialize

LOG = logging.getLogger("jobs.source_register")

PATHS = {"documents": "Parquet of doc_id, source, lang, text", "labels": "Parquet of doc_id, quality, toxic", "output": "folder of the register"}


def number_counts(text: Column) -> tuple[Column, Column]:
    """How many tokens hold a digit, and how many of these are numbers."""
    tokens = F.filter(F.split(text, "[ \t\r\n]+"), lambda t: t.rlike("[0-9]"))
    return F.size(tokens), F.size(F.filter(tokens, lambda t: T.number_status(t)["status"] == "observed"))


def repeated(rows: DataFrame) -> DataFrame:
    """``sha256, first_doc_id, copies`` of the texts that several rows have."""
    return rows.groupBy("sha256").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).where("copies > 1")


def conflicts(rows: DataFrame) -> DataFrame:
    """``doc_id, conflicting`` of the ids that stand for several texts."""
    return rows.groupBy("doc_id").agg(F.min("sha256").alias("a"), F.max("sha256").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("conflicting"))


def described(documents: DataFrame) -> DataFrame:
    """What each document's own text says; the only pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    tokens, numbers = number_counts(text)
    return documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select(
        "doc_id",
        "lang",
        T.content_hash(text).alias("sha256"),
        F.length(text).cast("long").alias("chars"),
        (F.size(F.split(text, "\n")) - F.when(text == "", 1).otherwise(0)).alias("lines"),
        tokens.alias("digit_tokens"),
        numbers.alias("numbers"),
        "source",
    )


def register(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The register's rows, of :func:`described` ones.

    Counts by text and by id are aggregated before any row travels, and only
    texts and ids that repeat are joined back; a text that a third of the
    documents share is one row on that side, and AQE splits the other.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = rows.join(repeated(rows), "sha256", "left").join(conflicts(rows), "doc_id", "left").join(marks, "doc_id", "left")
    return found.select(
        "doc_id",
        "lang",
        "sha256",
        F.coalesce("first_doc_id", "doc_id").alias("first_doc_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("conflicting", F.lit(False)).alias("conflicting"),
        "chars",
        "lines",
        "digit_tokens",
        "numbers",
        "quality",
        "toxic",
        "source",
    )


def run(spark: SparkSession, documents: str, labels: str, output: str) -> dict:
    """Write the register; returns how many documents were read and registered, and of how many sources.

    What the texts say is written to the shared folder first, so that they are
    read once however often their hashes are.
    """
    given = spark.read.parquet(documents)
    rows = materialize(described(given), "register-rows")
    found = register(rows, spark.read.parquet(labels))
    found.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(output)
    discard(rows)
    written = spark.read.schema(found.schema).parquet(output)
    sources, registered, repeats = written.agg(F.count_distinct("source"), F.count("*"), F.count(F.when(F.col("doc_id") != F.col("first_doc_id"), 1))).first()
    done = {"documents_read": given.count(), "documents_registered": registered, "sources": sources, "later_copies": repeats}
    LOG.info("read %(documents_read)d documents, registered %(documents_registered)d of %(sources)d sources, %(later_copies)d later copies", done)
    return done


def main(argv: list[str] | None = None) -> dict:
    return start("source-register", run, settings(__doc__.splitlines()[0], PATHS, argv))


if __name__ == "__main__":
    main(sys.argv[1:])
