"""Panels: entity x period x category values as long DataFrames.

A panel has columns ``entity, period, category, value``.  All functions are
plans of built-in expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.quantiles import exact_quantiles
from panelloom.sources.shared import materialize


def balanced(panel: DataFrame, n_periods: int, n_categories: int) -> DataFrame:
    """Rows of the entities with a positive value in every cell of the calendar."""
    cells = panel.where("value > 0").groupBy("entity").agg(F.count_distinct("period", "category").alias("cells"))
    return panel.join(cells.where(F.col("cells") == n_periods * n_categories).select("entity"), "entity", "left_semi")


def exclusions(panel: DataFrame, n_periods: int, n_categories: int) -> DataFrame:
    """``entity, periods, reason`` of each entity that :func:`balanced` drops."""
    seen = panel.groupBy("entity").agg(
        F.count_distinct("period").alias("periods"),
        F.count_distinct(F.when(F.col("value") > 0, F.struct("period", "category"))).alias("cells"),
    )
    reason = F.when(F.col("periods") < n_periods, "missing_period").otherwise("missing_category")
    return seen.where(F.col("cells") < n_periods * n_categories).select("entity", "periods", reason.alias("reason"))


def with_total(panel: DataFrame) -> DataFrame:
    """The panel with the sum over categories of each entity and period."""
    return panel.withColumn("total", F.sum("value").over(Window.partitionBy("entity", "period")))


def hellinger(panel: DataFrame, total: str | None = None) -> DataFrame:
    """The panel with ``coordinate``: the root of each share over root two.

    Shares are of column ``total``, equal throughout an entity's period, and a
    further row of category ``residual`` holds what the categories leave of
    it; without a name they are of the categories' sum, which leaves nought.
    A sum over the total, a negative value or a total of nought is an error.
    """
    own = F.sum("value").over(Window.partitionBy("entity", "period"))
    rows = panel.withColumn("_sum", own).withColumn("_total", F.col(total) if total else F.col("_sum"))
    left = F.col("_total") - F.col("_sum")
    slack = 1e-9 * F.abs("_total")  # sums in another order may differ in their last bits
    bad = F.col("value").isNull() | (F.col("value") < 0) | ~(F.col("_total") > 0) | (left < -slack)
    rows = rows.withColumn("_total", F.when(bad, F.raise_error(F.lit("categories must be nought or more and sum to no more than a positive total")).cast("double")).otherwise(F.col("_total")))
    rest = rows.groupBy("entity", "period").agg(F.first("_total").alias("_total"), F.greatest(F.lit(0.0), F.first("_total") - F.first("_sum")).alias("value")).withColumn("category", F.lit("residual"))
    both = rows.select("entity", "period", "category", "value", "_total").unionByName(rest.select("entity", "period", "category", "value", "_total"))
    return both.withColumn("coordinate", F.sqrt(F.col("value") / F.col("_total")) / F.sqrt(F.lit(2.0))).drop("_total")


def log_ratio(panel: DataFrame) -> DataFrame:
    """The panel with ``log_ratio``: ln(value / total)."""
    return with_total(panel).withColumn("log_ratio", F.ln(F.try_divide("value", "total")))


def calibration(ratios: DataFrame, cutoff: int) -> DataFrame:
    """``category, center, iqr`` over all entities and periods up to ``cutoff``.

    The ratios are written once and read twice: a category may hold a third of
    them, more than a buffer of values should.
    """
    rows = materialize(ratios.where(F.col("period") <= cutoff).select("category", "log_ratio"), "ratios")
    q = F.col("q")
    return exact_quantiles(rows, ["category"], "log_ratio", (0.25, 0.5, 0.75)).select("category", q[1].alias("center"), (q[2] - q[0]).alias("iqr"))


def frozen_profile(ratios: DataFrame, scaler: DataFrame, n_categories: int) -> DataFrame:
    """``coordinate`` by the frozen scaler, one row per category of which is broadcast."""
    scaled = (F.col("log_ratio") - F.col("center")) / F.col("iqr") / F.sqrt(F.lit(float(n_categories)))
    return ratios.join(F.broadcast(scaler), "category").withColumn("coordinate", scaled)


def annual_profile(profile: DataFrame) -> DataFrame:
    """The median over periods of each entity's coordinates."""
    return profile.groupBy("entity", "category").agg(F.median("coordinate").alias("coordinate"))


def nearest_prototype(profiles: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``entity, cluster, distance, margin``: the nearest prototype, ties to the least.

    ``prototypes`` has ``cluster, category, center_value`` and is a model of
    fixed size, thus broadcast.  ``margin`` is (second - first) / second, and
    nought if the second is at distance nought.
    """
    squares = profiles.join(F.broadcast(prototypes), "category").groupBy("entity", "cluster").agg(F.sum(F.pow(F.col("coordinate") - F.col("center_value"), 2)).alias("square"))
    ranked = squares.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(F.sqrt("square").alias("distance"), "cluster"))).alias("near"))
    near = F.col("near")
    margin = F.when(F.size(near) > 1, F.coalesce(F.try_divide(F.get(near, 1)["distance"] - near[0]["distance"], F.get(near, 1)["distance"]), F.lit(0.0)))
    return ranked.select("entity", near[0]["cluster"].alias("cluster"), near[0]["distance"].alias("distance"), margin.alias("margin"))


def interval_join(facts: DataFrame, registry: DataFrame, key: str, at: str) -> DataFrame:
    """Facts with the registry row whose half-open interval holds ``at``."""
    held = (F.col(at) >= F.col("year_from")) & (F.col(at) < F.col("year_to"))
    return facts.join(registry, key).where(held).drop("year_from", "year_to")


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """``n_keys, n_rows``: keys that occur more than once and their rows."""
    return table.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"))


def multiset_difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """``n_keys, n_differing``: keys of either table, and those not as often in both."""
    both = a.select(*keys, F.lit(1).alias("d")).unionByName(b.select(*keys, F.lit(-1).alias("d")))
    net = both.groupBy(*keys).agg(F.sum("d").alias("net"))
    return net.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("net") != 0, 1)).alias("n_differing"))


def unique_or_ambiguous(table: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status``: matched, ambiguous or missing by the distinct values."""
    n = F.count_distinct(value)
    return table.groupBy(key).agg(F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("missing").alias("status"), F.when(n == 1, F.max(value)).alias("value"))


def clean_name(name: Column) -> Column:
    """Lower case, white space evened out."""
    return F.trim(F.regexp_replace(F.lower(name), "[ \t\r\n]+", " "))
