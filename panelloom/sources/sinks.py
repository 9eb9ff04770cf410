"""Sinks: tables published together or not at all, files that are never replaced, fixed formats."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.sources.shared import _file_system

LOCK, MANIFEST = ".publish.lock", "manifest.json"


class RollbackError(RuntimeError):
    """A publication failed, and so did bringing back what was there before."""


def _bytes(spark: SparkSession, path: str, raw: bytes, replace: bool) -> None:
    files, where = _file_system(spark, path)
    out = files.create(where, replace)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def as_json(value) -> bytes:
    """Indented UTF-8 with a line end; NaN and infinities are a ValueError."""
    return (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()


def write_json(spark: SparkSession, path: str, value) -> None:
    _bytes(spark, path, as_json(value), True)


def write_once(spark: SparkSession, path: str, value) -> str:
    """Write a JSON file that must not exist yet; returns its SHA-256."""
    raw = as_json(value)
    _bytes(spark, path, raw, False)
    return hashlib.sha256(raw).hexdigest()


def write_labels(spark: SparkSession, path: str, value) -> str:
    """Compact JSON in gzip without name and time, so that equal labels give equal bytes; returns their SHA-256."""
    held = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=held, mtime=0) as stream:
        stream.write(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())
    _bytes(spark, path, held.getvalue(), True)
    return hashlib.sha256(held.getvalue()).hexdigest()


def general(value: Column, digits: int = 6) -> Column:
    """A number in so many significant digits, trailing noughts left out, as C's ``%g`` writes it.

    Ties of the shortest decimal form round away from nought.
    """
    shown = F.format_string(f"%.{digits - 1}e", value.cast("double"))
    power = F.substring_index(shown, "e", -1).try_cast("int")
    strip = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    plain = F.lit(None).cast("string")
    for p in range(-4, digits):
        number = F.format_string(f"%.{digits - 1 - p}f", value.cast("double"))
        plain = F.when(power == p, strip(number) if digits - 1 - p else number).otherwise(plain)
    mantissa = F.substring_index(shown, "e", 1)
    wide = F.concat(strip(mantissa) if digits > 1 else mantissa, F.lit("e"), F.substring_index(shown, "e", -1))
    return F.when(power.isNull(), F.lower(shown)).otherwise(F.coalesce(plain, wide))


def write_csv(table: DataFrame, path: str, *, line_end: str = "\r\n", digits: int | None = None) -> None:
    """CSV with a header, fixed line ends and, if wanted, numbers in so many significant digits."""
    if digits:
        numbers = [f.name for f in table.schema if f.dataType.simpleString() in ("double", "float")]
        table = table.withColumns({c: F.when(F.col(c).isNotNull(), general(F.col(c), digits)) for c in numbers})
    table.write.csv(path, header=True, lineSep=line_end, encoding="UTF-8", quote='"', escape='"', emptyValue="")


@contextmanager
def stage(spark: SparkSession, root: str) -> Iterator[str]:
    """A private folder inside ``root``, which one publisher has at a time.

    It is deleted at the end, unless a rollback failed: then it holds what is
    needed to mend by hand, and the lock stays.
    """
    files, where = _file_system(spark, root)
    files.mkdirs(where)
    _, lock = _file_system(spark, f"{root}/{LOCK}")
    if not files.createNewFile(lock):
        raise FileExistsError(f"{root} is being published to")
    private = f"{root}/.stage-{uuid.uuid4().hex}"
    _, folder = _file_system(spark, private)
    keep = False
    try:
        files.mkdirs(folder)
        yield private
    except RollbackError:
        keep = True
        raise
    finally:
        if not keep:
            files.delete(folder, True)
            files.delete(lock, False)


def _move(spark: SparkSession, a: str, b: str) -> None:
    files, source = _file_system(spark, a)
    _, target = _file_system(spark, b)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{a} could not be moved to {b}")


def promote(spark: SparkSession, private: str, root: str, names: list[str]) -> None:
    """Move what was staged into place, the manifest last; on a failure all is as it was before."""
    if MANIFEST not in names:
        raise ValueError("no publication without a manifest")
    done: list[tuple[str, bool]] = []
    files, _ = _file_system(spark, root)
    try:
        for name in sorted(names, key=lambda n: (n == MANIFEST, n)):
            target = f"{root}/{name}"
            old = files.exists(_file_system(spark, target)[1])
            if old:
                _move(spark, target, f"{private}/.before/{name}")
            done.append((name, old))
            _move(spark, f"{private}/{name}", target)
    except BaseException as fault:
        for name, old in reversed(done):
            try:
                files.delete(_file_system(spark, f"{root}/{name}")[1], True)
                if old:
                    _move(spark, f"{private}/.before/{name}", f"{root}/{name}")
            except Exception as second:
                raise RollbackError(f"{name} was not brought back from {private}") from second
        raise fault


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict) -> None:
    """Write tables as Parquet under ``root`` together with a manifest of ``facts`` and rows.

    Readers that wait for the manifest see all tables or none of them.
    """
    with stage(spark, root) as private:
        rows = {}
        for name, table in tables.items():
            table.write.parquet(f"{private}/{name}")
            rows[name] = spark.read.parquet(f"{private}/{name}").count()
        write_json(spark, f"{private}/{MANIFEST}", {**facts, "rows": rows})
        promote(spark, private, root, [*tables, MANIFEST])
