"""Inputs of an experiment that are used only if they are what they were.

A loader's checks are part of its plan: what departs from them makes reading
fail, so no row of a changed input reaches a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import scoring
from panelloom.sources.files import read_strict_csv


def _unless(condition: Column, text: str) -> Column:
    """True, or an error when read if the condition does not hold (null included)."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(text)).cast("boolean"))


def aligned_cohort(panel: DataFrame, key: str, period: str, periods: list[str]) -> DataFrame:
    """The panel, of which every key has one row in each of ``periods`` and none elsewhere.

    Anything else, a null key or period included, makes reading fail; an empty
    panel is aligned.  The name ``_aligned`` is taken.
    """
    if len(set(periods)) != len(periods) or not periods:
        raise ValueError("periods must be present and unique")
    known = F.coalesce(F.col(period).cast("string").isin(periods), F.lit(False))
    per = panel.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(period).alias("_m"), F.count(F.when(known, 1)).alias("_k"))
    n = len(periods)
    sound = F.col(key).isNotNull() & (F.col("_n") == n) & (F.col("_m") == n) & (F.col("_k") == n)
    checked = per.select(F.col(key).alias("_key"), _unless(sound, "the months do not have one cohort").alias("_aligned"))
    return panel.join(checked, panel[key].eqNullSafe(checked["_key"])).where("_aligned").drop("_aligned", "_key")


def aligned_labels(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """``id, cluster`` of stored labels, which name each of ``ids`` once and no other; else reading fails."""
    once = stored.groupBy("id").agg(F.count("*").alias("_n"), F.first("cluster").alias("cluster"))
    mine = ids.groupBy("id").agg(F.count("*").alias("_m"))
    met = mine.join(once, mine["id"].eqNullSafe(once["id"]), "full").select(F.coalesce(mine["id"], once["id"]).alias("id"), "_m", "_n", "cluster")
    sound = F.col("id").isNotNull() & (F.col("_m") == 1) & (F.col("_n") == 1) & F.col("cluster").isNotNull()
    return met.where(_unless(F.coalesce(sound, F.lit(False)), "the stored labels are of other ids")).select("id", "cluster")


def reproduced_labels(vectors: DataFrame, centres, stored: DataFrame) -> DataFrame:
    """``id, cluster, distance``: stored labels, if the frozen centres still give every one of them.

    The nearest centre of each vector is taken, ties to the first; a label
    that differs, is missing or is of no vector makes reading fail.
    """
    found = vectors.select("id", scoring.nearest(F.col("vector"), centres).alias("n")).select("id", F.col("n.cluster").alias("found"), F.col("n.distance").alias("distance"))
    both = aligned_labels(vectors.select("id"), stored).join(found, "id")
    same = F.coalesce(F.col("found") == F.col("cluster"), F.lit(False))
    return both.where(_unless(same, "a frozen label is not reproduced")).select("id", F.col("cluster").cast("int").alias("cluster"), "distance")


def load_reference(spark: SparkSession, lock: dict, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """A locked experiment's panel, and its labels ``id, cluster, distance``.

    The sealed lock (:func:`panelloom.operators.scoring.sealed`) names the
    panel's and the labels' files with their digests, the year, scaler and
    centres.  The lock must be sealed, the bytes those pinned, the year's
    months one cohort, and the labels those of the yearly profiles.
    """
    held = scoring.verified(lock)
    rows = read_strict_csv(spark, held["panel"], held["panel_sha256"])
    panel = rows.select("entity", "period", *[F.col(c).cast("double").alias(c) for c in (*categories, "total")])
    months = [f"{held['year']}-{m:02d}-01" for m in range(1, 13)]
    panel = aligned_cohort(panel, "entity", "period", months)
    yearly = scoring.vectors_of(scoring.annual(scoring.frozen_features(panel, categories, held["scaler"])), "entity", "year")
    labels = read_strict_csv(spark, held["labels"], held["labels_sha256"]).select(F.col("entity").alias("id"), F.col("cluster").cast("int").alias("cluster"))
    return panel, reproduced_labels(yearly.select(F.col("entity").alias("id"), "vector"), held["centers"], labels)
