"""Pinned files, delimited exports, strict tables, archives and workbooks.

Tables are read by Spark's own readers where these can tell a fault; what must
be seen as one sequence of bytes (digests, archives, workbooks) is a value of
``binaryFile``, read in a task, and so is bounded by what a row may hold.
"""

from __future__ import annotations

import csv
import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.text import month_start, territory_id
from panelloom.operators.contracts import conflict_flag
from panelloom.sources import archives

DIGEST = re.compile("[0-9a-f]{64}")
EXPORT_COLUMNS = ("mo", "period", "category_15", "value", "obs_status", "unit_measure", "unit_mult", "freq")


def must(condition: Column, value: Column, fault: str) -> Column:
    """``value`` where the condition holds; elsewhere, a null condition among them, an error."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(fault)))


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, length, sha256`` of files, read where they lie."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, path: str, expected: str) -> bytes:
    """The bytes of one file, if their SHA-256 is the expected one."""
    if not DIGEST.fullmatch(expected):
        raise ValueError("a SHA-256 of 64 lower-case digits is wanted")
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if hashlib.sha256(content).hexdigest() != expected:
        raise ValueError(f"other bytes than the pinned ones: {path}")
    return content


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a manifest names a file twice")
    return found


def listed(spark: SparkSession, folder: str, name: str, manifest: str = "SHA256.json") -> bytes:
    """The bytes of a file that a folder's manifest pins; names may not leave the folder."""
    place = PurePosixPath(name)
    if place.is_absolute() or ".." in place.parts:
        raise ValueError("a file inside the folder is wanted")
    raw = spark.read.format("binaryFile").load(f"{folder}/{manifest}").select("content").first()[0]
    pins = json.loads(bytes(raw), object_pairs_hook=_once)
    if not isinstance(pins, dict) or not isinstance(pins.get(str(place)), str):
        raise ValueError(f"not in the manifest: {name}")
    return pinned(spark, f"{folder}/{place}", pins[str(place)])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A ``;``-separated export with ``period`` as YYYY-MM-DD and ``value`` a number.

    An absent column is a ValueError; a null key, a period that is no month's
    start (see :func:`panelloom.functions.text.month_start`) or a value that is
    no number is an error when rows are read.
    """
    raw = spark.read.csv(path, sep=";", header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8")
    absent = set(EXPORT_COLUMNS) - set(raw.columns)
    if absent:
        raise ValueError(f"missing columns: {sorted(absent)}")
    number = F.when(F.col("value").isNotNull(), must(F.col("value").try_cast("double").isNotNull(), F.col("value").try_cast("double"), "a value is no number"))
    keys = {k: must(F.col(k).isNotNull(), F.col(k), "a key is missing") for k in ("mo", "period", "category_15")}
    checked = raw.withColumns(keys | {"value": number})
    return checked.withColumn("period", month_start(F.col("period")))


def read_strict_csv(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """A comma-separated table of strings; with ``expected`` its bytes are pinned.

    Rows must have as many fields as the header, names must be present and
    unique, and a quotation mark may only open a field, close it, or be
    doubled inside a quoted one; anything else is an error.
    """
    if expected is not None and file_digests(spark, path).first()["sha256"] != expected:
        raise ValueError(f"other bytes than the pinned ones: {path}")
    head = spark.read.text(path).first()
    names = next(csv.reader([head[0].lstrip("﻿")]), []) if head else []
    if not names or len(set(names)) != len(names) or not all(n.strip() for n in names):
        raise ValueError("column names must be present and unique")
    shape = T.StructType([T.StructField(n, T.StringType()) for n in names])
    loose = spark.read.text(path, wholetext=True).select(quotes_are_sound(F.col("value")).alias("sound"))
    if not loose.first()["sound"]:
        raise ValueError("broken quoting")
    return spark.read.csv(path, schema=shape, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"')


def quotes_are_sound(text: Column) -> Column:
    """Whether a text is fields, each free of quotation marks or quoted as a whole, parted by commas and line ends."""
    field = r'(?:"(?:[^"]|"")*+"|[^",\r\n]*+)'
    return text.rlike(rf"\A\x{{FEFF}}?{field}(?:[,\r\n]{field})*+\z")


def strict_panel(rows: DataFrame, categories: list[str], years: str = "202[34]") -> DataFrame:
    """The panel of a strict table, typed; any departure from its contract is an error.

    Ids are ``tid_`` and a canonical number, periods month starts of the given
    years, amounts positive and finite.
    """
    sound = F.col("territory_id").rlike(r"\A(0|[1-9][0-9]*)\z") & (F.col("entity_id") == F.concat(F.lit("tid_"), "territory_id"))
    dated = F.col("period").rlike(rf"\A{years}-(0[1-9]|1[0-2])-01\z")
    amounts = {c: F.col(c).try_cast("double") for c in categories}
    typed = {c: must((x > 0) & (x < float("inf")), x, "amounts must be positive and finite") for c, x in amounts.items()}
    return rows.withColumns({"entity_id": must(sound, F.col("entity_id"), "ids do not agree"), "period": must(dated, F.col("period"), "no canonical month"), **typed})


def read_roads(spark: SparkSession, path: str, cohort: DataFrame) -> DataFrame:
    """``a, b, distance``: highway records between members of the cohort, each unordered pair once.

    The kind of road and three columns reach the Parquet scan; membership is
    two semi joins with ``cohort.territory_id``.  A loop, a distance that is
    negative or not finite, and a pair that occurs twice are errors.
    """
    ids = cohort.select("territory_id").distinct()
    rows = spark.read.parquet(path).where("type = 'highway'").select("territory_id_x", "territory_id_y", "distance")
    for end in ("territory_id_x", "territory_id_y"):
        rows = rows.join(ids, rows[end] == ids["territory_id"], "left_semi")
    fine = (F.col("distance") >= 0) & (F.col("distance") < float("inf")) & (F.col("territory_id_x") != F.col("territory_id_y"))
    pairs = rows.select(F.least("territory_id_x", "territory_id_y").alias("a"), F.greatest("territory_id_x", "territory_id_y").alias("b"), must(fine, F.col("distance"), "no road distance").alias("distance"))
    once = pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.count("*").alias("n"))
    return once.select("a", "b", must(F.col("n") == 1, F.col("distance"), "a pair of roads occurs twice").alias("distance"))


def read_municipal(spark: SparkSession, path: str, key: str, level: str) -> DataFrame:
    """``oktmo, key, rows``: all (value, name, comment) of one level, as a multimap."""
    raw = spark.read.csv(path, sep=";", header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8")
    number = F.when(F.trim(F.coalesce("indicator_value", F.lit(""))) != "", F.col("indicator_value").cast("double"))
    rows = raw.where(F.col("mun_level") == level).select("oktmo", F.col(key).alias("key"), F.struct(number.alias("value"), F.col("municipality").alias("name"), "comment").alias("row"))
    return rows.groupBy("oktmo", "key").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def read_annual_member(zips: DataFrame, year: int, indicator: str, period: str, keys: list[str]) -> DataFrame:
    """Rows of the one CSV member of a year in each archive, as strings, with ``source_row`` and ``conflicting_key``.

    ``zips`` is path, content (see :func:`archives.binary`); archives are read
    in tasks of their own.  Rows of another indicator or year are an error,
    those of another period left out; ``source_row`` is the record's number in
    the member, its header being one.  A key conflicts across archives, too.
    """
    found = archives.member_records(zips, rf"year{year}_.*\.csv\Z", one=True)
    record = F.col("record")
    right = (record["indicator_code"] == indicator) & (record["year"] == str(year))
    columns = dict.fromkeys(["oktmo", "indicator_code", "year", "indicator_period", *keys])
    rows = found.select("path", "source_row", *[must(right, record[c], "another indicator or year").alias(c) for c in columns])
    return conflict_flag(rows.where(F.col("indicator_period") == period), *keys).drop("path")


def read_registry(books: DataFrame, required: list[str], sheet: str | None = None) -> DataFrame:
    """A registry of year intervals from workbooks of one header, as strings but for ``year_from`` and ``year_to``.

    ``books`` is path, content; only the header reaches the driver.  Absent columns or no rows are a
    ValueError; an interval that is not two whole years in order, or an id
    that is not canonical, is an error.
    """
    cells = archives.sheet_rows(books, sheet)
    heads = cells.where("source_row = 1").select(F.transform("cells", lambda c: c["text"]).alias("names")).distinct().limit(2).collect()
    if len(heads) != 1 or not set(required) <= set(heads[0]["names"]) or cells.where("source_row > 1").isEmpty():
        raise ValueError("the registry is not whole, or its workbooks differ")
    table = cells.where("source_row > 1").select(*[F.get("cells", F.lit(i))["text"].alias(n) for i, n in enumerate(heads[0]["names"])])
    years = {c: F.col(c).try_cast("int") for c in ("year_from", "year_to")}
    ordered = years["year_from"] < years["year_to"]
    typed = table.withColumns({c: must(ordered, y, "intervals must be whole years in order") for c, y in years.items()})
    return typed.withColumn("territory_id", territory_id(F.col("territory_id")))


def read_population(books: DataFrame, sheet: str | None = None, first_row: int = 8) -> DataFrame:
    """``code8, rows``: population rows of districts by eight digits of their code, as a multimap.

    Rows count whose first cell has ten digits of which the sixth to eighth
    are noughts, and whose third is a number.
    """
    cells = archives.sheet_rows(books, sheet).where(F.col("source_row") >= first_row)
    at = lambda i: F.get("cells", F.lit(i))
    code, total = F.trim(at(0)["text"]), at(2)["number"]
    rows = cells.where(code.rlike("^[0-9]{5}000[0-9]{2}$") & total.isNotNull())
    row = F.struct(total.alias("total"), F.coalesce(at(3)["number"], F.lit(0.0)).alias("urban"), F.trim(F.coalesce(at(1)["text"], F.lit(""))).alias("name"))
    return rows.select(F.substring(code, 1, 8).alias("code8"), row.alias("row")).groupBy("code8").agg(F.sort_array(F.collect_list("row")).alias("rows"))
