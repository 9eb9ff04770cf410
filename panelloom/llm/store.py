"""Tables that cut lineage, and batches of bounded size.

The tables lie in the folder that the cluster shares: see
:mod:`panelloom.sources.shared`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.sources.shared import _file_system, digest_of, discard, exists, free_name, materialize, scratch, shared_dir

__all__ = ["bounded_batches", "digest_of", "discard", "exists", "free_name", "materialize", "resumed", "scratch", "shared_dir"]


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Keep Arrow batches small, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def _stamp(spark: SparkSession, path: str) -> str | None:
    files, where = _file_system(spark, f"{path}/_STAMP")
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def resumed(spark: SparkSession, path: str, made: Callable[[], DataFrame], stamp: str) -> DataFrame:
    """The rows at ``path``, which are made and written first unless they are there whole under the same ``stamp``.

    The stamp says what they are made of: inputs, parameters, rules.
    """
    if not exists(spark, f"{path}/_SUCCESS") or _stamp(spark, path) != stamp:
        made().write.mode("overwrite").option("compression", "zstd").parquet(path)
        files, where = _file_system(spark, f"{path}/_STAMP")
        out = files.create(where, True)
        try:
            out.write(bytearray(stamp.encode()))
        finally:
            out.close()
    return spark.read.parquet(path)
