"""Tables that cut lineage, in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  It is read from the session; only
where it is unset (local tests) a temporary folder is made, which is safe there
because driver and executors are one process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Of each open :func:`scratch`, the tables written since.
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that are written and read again."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="panelloom-")
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    for tables in _OPEN:
        tables.append(out)
    return out


@contextmanager
def scratch(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete, at the end, the tables that were materialized meanwhile; put those to keep into the list that it gives."""
    tables: list[DataFrame] = []
    keep = list(kept)
    _OPEN.append(tables)
    try:
        yield keep
    finally:
        _OPEN.remove(tables)
        saved = {getattr(k, "_written_path", None) for k in keep}
        for t in tables:
            if t._written_path not in saved:
                discard(t)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, through Spark's own file systems."""
    files, where = _file_system(spark, path)
    return files.exists(where)


def digest_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of all files of some tables, which are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{row[0]}-{(row[1] or 0) & (1 << 64) - 1:016x}"


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; ``df`` must not be read afterwards."""
    path = getattr(df, "_written_path", None)
    if path:
        files, where = _file_system(df.sparkSession, path)
        files.delete(where, True)
