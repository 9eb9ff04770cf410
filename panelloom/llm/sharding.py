"""Sharding by extendible hashing.

A shard is named by a prefix of a hash's bits.  Only a shard over the byte
limit splits on another bit; the directory of prefixes is a table, looked up
by an equal join, never held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.store import free_name, materialize

LIMIT_BYTES = 64 << 20
#: Bits by which an oversized shard is examined in one round.
STEP = 8
#: Bits of each of the three hashes: of the id, of the text, of the row.
BITS = 60


def _bits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as digits."""
    return F.lpad(F.conv(F.substring(F.md5(value.cast("binary")), 1, BITS // 4), 16, 2), BITS, "0")


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES, row_col: str | None = None) -> DataFrame:
    """Each row's shard: ``doc_id, n_bytes, shard, depth, shard_bytes, shard_rows``.

    ``shard`` is the shortest prefix of the row's bits whose rows fit
    ``limit`` bytes of UTF-8, empty if all rows fit.  Bits come from the id;
    rows that share an id go on with bits of their text, and equal rows with
    bits of their place in the table that is written below, so that no group
    of copies is too large to split.  A single row over the limit is a shard
    of its own.  Null texts have no bytes, null ids share one hash; every row
    has one result and an empty table has none.  ``row_col``, if named, is
    carried along as ``row``.
    """
    carried = ["row"] if row_col else []
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.concat(_bits(key), _bits(text)).alias("bits"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = materialize(rows, "rows")
    active = rows.withColumn("bits", F.concat("bits", _bits(F.monotonically_increasing_id().cast("string"))))
    active, done, depth = materialize(active, "keys"), None, 0
    while True:
        reach = min(depth + STEP, 3 * BITS)
        nodes = active.groupBy(F.substring("bits", 1, reach).alias("path")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        spread = nodes.select("path", "bytes", "rows", F.explode(F.sequence(F.lit(depth + (depth > 0)), F.lit(reach))).alias("depth"))
        spread = spread.withColumn("shard", F.substring("path", F.lit(1), F.col("depth")))
        sums = spread.groupBy("shard", "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == 3 * BITS))
        at = spread.select("path", "shard").join(fits, "shard", "left").where("depth is not null")
        first = at.groupBy("path").agg(F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_rows"), "depth").alias("found"))
        directory = materialize(nodes.select("path").join(first, "path", "left"), "directory")
        looked = active.withColumn("path", F.substring("bits", 1, reach)).join(directory, "path")
        here = looked.where("found is not null").select("doc_id", "n_bytes", "found.shard", "found.depth", "found.shard_bytes", "found.shard_rows", *carried)
        done = here if done is None else done.unionByName(here)
        if directory.where("found is null").isEmpty():
            return done
        active, depth = looked.where("found is null").select("doc_id", "n_bytes", "bits", *carried), reach


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> str:
    """Write ``docs`` as one folder per shard (``shard=0b...``); returns that column's name.

    Rows are numbered in a table written to the shared folder and joined to
    their shards by number, so every row is written once whatever the ids:
    null, repeated, or rows alike in all.  If ``docs`` has a column ``shard``
    it stays, and the folders' one is called ``shard_``.  An empty table
    writes no shard.
    """
    row, shard = free_name(docs, "_row"), free_name(docs, "shard")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = assign(numbered, id_col=id_col, text_col=text_col, limit=limit, row_col=row).select(F.col("row").alias(row), F.concat(F.lit("0b"), "shard").alias(shard))
    out = numbered.join(found, row).drop(row)
    out.repartition(shard).write.partitionBy(shard).parquet(path)
    return shard
