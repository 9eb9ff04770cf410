"""From an official snapshot to a whole panel, checked on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.text import territory_id
from panelloom.operators.contracts import require
from panelloom.operators.panel import interval_join, multiset_difference
from panelloom.sources.files import must

META = ("municipal_district_name", "region_name", "region_code", "oktmo")
PLACE = ("municipal_district_center_lat", "municipal_district_center_lon")
#: Fixed values of the published panel.
REASON = "not_complete_all_months_retrospective_panel"
CAVEATS = {20: "chechnya_registry_caveat", None: "annual_registry_2024_coverage_caveat"}


def canonical_rows(consumption: DataFrame, categories: list[str], total: str) -> DataFrame:
    """``territory_id, period, category, value`` of ``date`` (YYYY-MM) rows; a departure from the contract is an error.

    Values are positive and finite, categories the known ones and all of them,
    and a territory has one value of each in a month.
    """
    known = [*categories, total]
    period = F.date_format(F.to_date(F.concat("date", F.lit("-01")), "yyyy-MM-dd"), "yyyy-MM-dd")
    fine = (F.col("value") > 0) & (F.col("value") < float("inf"))
    rows = consumption.select(
        territory_id(F.col("territory_id")).cast("long").alias("territory_id"),
        must(period.isNotNull(), period, "a month is missing").alias("period"),
        must(F.col("category").isin(known), F.col("category"), "an unknown category").alias("category"),
        must(fine, F.col("value"), "values must be positive and finite").alias("value"),
    )
    keys = rows.groupBy("territory_id", "period", "category").agg(F.count("*").alias("n"))
    require(keys.agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.abs(F.count_distinct("category") - len(known)).alias("absent_categories")))
    return rows


def whole_months(rows: DataFrame) -> list[str]:
    """The periods in order; a month that is missing between them is an error."""
    found = [r["period"] for r in rows.select("period").distinct().orderBy("period").collect()]  # one row a month
    number = [int(p[:4]) * 12 + int(p[5:7]) for p in found]
    if not found or number != list(range(number[0], number[0] + len(number))):
        raise ValueError("whole calendar months are missing")
    return found


def prepare(consumption: DataFrame, registry: DataFrame, categories: list[str], total: str, export: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables ``panel``, ``canonical_long`` and ``excluded``, ready to be published together.

    Territories with all values in every month make the panel; its identity
    comes from the one registry interval that holds the year.  With an
    ``export`` the two sources must agree as multisets of period, category and
    value.
    """
    rows = canonical_rows(consumption, categories, total)
    months = whole_months(rows)
    if export is not None:
        require(multiset_difference(rows, export, "period", "category", "value").select("n_differing"))
    dated = rows.withColumn("year", F.substring("period", 1, 4).cast("int"))
    wide = rows.groupBy("territory_id", "period").pivot("category", [*categories, total]).agg(F.first("value"))
    full = F.lit(True)
    for c in [*categories, total]:
        full &= F.col(f"`{c}`").isNotNull()
    complete = wide.groupBy("territory_id").agg(F.count(F.when(full, 1)).alias("observed_complete_months"))
    kept = wide.join(complete.where(F.col("observed_complete_months") == len(months)), "territory_id", "left_semi")
    intervals = registry.select(F.col("territory_id").cast("long").alias("territory_id"), "year_from", "year_to", *META, *PLACE)
    active = interval_join(kept.withColumn("year", F.substring("period", 1, 4).cast("int")), intervals, "territory_id", "year")
    require(active.groupBy("territory_id", "period").agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("overlapping_intervals"), (F.lit(kept.count()) - F.count("*")).alias("without_interval")))
    require(active.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in META]))
    latest = F.last("municipal_district_name").over(Window.partitionBy("territory_id").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    flag = F.when(F.col("region_code").cast("int") == 20, CAVEATS[20]).otherwise(CAVEATS[None])
    panel = active.withColumns({"mo": latest, "entity_id": F.concat(F.lit("tid_"), F.col("territory_id").cast("string")), "boundary_review_flag": flag}).drop("year")
    excluded = complete.where(F.col("observed_complete_months") < len(months)).withColumn("reason", F.lit(REASON))
    return {"panel": panel, "canonical_long": dated.drop("year"), "excluded": excluded}
