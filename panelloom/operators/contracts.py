"""Contracts of tables, graphs and labels, and joins that check what they join.

Most return one row of counts of violations, taken in one pass; ``require``
turns such a row into an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(counts: DataFrame) -> None:
    """Raise ValueError if any count in the one row is positive."""
    row = counts.first().asDict()
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise ValueError(f"contract broken: {wrong}")


def _count(condition: Column) -> Column:
    return F.count(F.when(F.coalesce(condition, F.lit(True)), 1))


def panel_contract(panel: DataFrame, n_entities: int, periods: list[str]) -> DataFrame:
    """Violations of a prepared panel (entity_id, territory_id, period).

    Keys must be nonempty and distinct, periods the first of a month and, as a
    set, those named; entities as many as named, and each ``tid_`` and its
    territory's number, one to one.
    """
    e, p, t = F.col("entity_id"), F.col("period"), F.col("territory_id").cast("string")
    number = F.regexp_replace(t, "^0+(?=.)", "")
    rows = panel.agg(
        _count((e == "") | e.isNull()).alias("bad_entity"),
        _count(~p.rlike("^[0-9]{4}-[0-9]{2}-01$") | F.try_to_date(p).isNull()).alias("bad_period"),
        _count(~t.rlike("^[0-9]+$")).alias("bad_territory"),
        _count(e != F.concat(F.lit("tid_"), number)).alias("wrong_entity"),
        (F.count("*") - F.count_distinct("entity_id", "period")).alias("duplicate_keys"),
        F.abs(F.count_distinct("entity_id") - n_entities).alias("entity_count_off"),
        (F.count_distinct(F.when(~p.isin(periods), p)) + (len(periods) - F.count_distinct(F.when(p.isin(periods), p)))).alias("months_off"),
    )
    pairs = panel.select(e, number.alias("n")).distinct()
    many = lambda by: pairs.groupBy(by).count().where("count > 1").agg(F.count("*").alias(f"many_{by}"))
    return rows.crossJoin(F.broadcast(many("entity_id"))).crossJoin(F.broadcast(many("n").withColumnRenamed("many_n", "many_territory")))


def graph_contract(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations of a symmetric graph (src, dst, weight) given in both directions."""
    w = F.col("weight")
    bad = pairs.agg(_count(F.col("src") == F.col("dst")).alias("loops"), _count((w < 0) | F.isnan(w) | (F.abs(w) == float("inf"))).alias("bad_weight"))
    summed = pairs.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w <> 0")
    back = summed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    skew = summed.join(back, ["src", "dst"], "full").where("w is null or v is null or w <> v").agg(F.count("*").alias("asymmetric"))
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id")))
    lost = ends.join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown_nodes"))
    return bad.crossJoin(F.broadcast(skew)).crossJoin(F.broadcast(lost))


def clean_graph(pairs: DataFrame) -> DataFrame:
    """Undirected edges of a symmetric graph: repeated entries summed, those of no weight dropped."""
    return pairs.where("src < dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def label_contract(partition: DataFrame) -> DataFrame:
    """Violations of a partition (id, cluster): one label each, none missing, 2 <= k < n."""
    k = F.count_distinct("cluster")
    return partition.agg(
        _count(F.col("id").isNull()).alias("missing_id"),
        _count(F.col("cluster").isNull()).alias("missing_label"),
        (F.count("id") - F.count_distinct("id")).alias("repeated_id"),
        F.when(k < 2, 1).otherwise(0).alias("too_few_clusters"),
        F.when(k >= F.count("*"), 1).otherwise(0).alias("too_many_clusters"),
    )


def month_window(periods: DataFrame, first: str, last: str) -> DataFrame:
    """``period, place`` of the months from ``first`` to ``last``; a gap in them is an error.

    ``periods`` has ``period`` as YYYY-MM-01; a place counts months from year nought.
    """
    place = F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")
    rows = periods.select("period").distinct().where(F.col("period").between(first, last)).withColumn("place", place)
    step = F.col("place") - F.lag("place").over(Window.orderBy("place"))
    return rows.withColumn("place", F.when(F.coalesce(step, F.lit(1)) == 1, F.col("place")).otherwise(F.raise_error(F.lit("the window has a gap")).cast("int")))


def whole_names(table: DataFrame, name: str, keys: list[str], bad: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the names without any fault, and ``name, reason`` of the others.

    A repeated key (name and ``keys``) or a bad value drops its name whole;
    of several reasons the first named wins: missing_name, duplicate_key, bad_value.
    """
    marked = table.withColumn("_n", F.count("*").over(Window.partitionBy(name, *keys))).withColumn("_bad", F.coalesce(bad, F.lit(True)))
    reason = F.when(F.col(name).isNull(), "missing_name").when(F.max("_n") > 1, "duplicate_key").when(F.max("_bad"), "bad_value")
    faults = marked.groupBy(name).agg(F.max("_n"), F.max("_bad"), reason.alias("reason")).where("reason is not null").select(name, "reason")
    return table.where(F.col(name).isNotNull()).join(faults.select(name), name, "left_anti"), faults


def peer_cohort(table: DataFrame, groups: list[str], least: int = 2, rounds: int = 1000) -> DataFrame:
    """The rows whose group has ``least`` rows in every one of ``groups``, again and again until none goes.

    Each round's rows are written to the shared folder; rows with a null group go.
    """
    from panelloom.sources.shared import materialize

    ok = F.lit(True)
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    now = materialize(table.where(ok), "cohort")
    size = now.count()
    for _ in range(rounds):
        counted = now.withColumns({f"_n{i}": F.count("*").over(Window.partitionBy(g)) for i, g in enumerate(groups)})
        keep = F.lit(True)
        for i in range(len(groups)):
            keep = keep & (F.col(f"_n{i}") >= least)
        now = materialize(counted.where(keep).select(*table.columns), "cohort")
        after = now.count()
        if after == size:
            return now
        size = after
    raise RuntimeError("the cohort did not settle")


# --- joins --------------------------------------------------------------------


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of two tables of which neither may repeat a key; if one does, reading fails."""
    checked = []
    for side in (a, b):
        n = F.count("*").over(Window.partitionBy(*on))
        checked.append(side.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a key is repeated")).cast("boolean"))).drop("_n"))
    return checked[0].join(checked[1], on)


def verified_join(source: DataFrame, registry: DataFrame, on: str, checks: dict[str, Column]) -> DataFrame:
    """Source rows joined to their one registry row, each check a column, and ``join_verified``.

    A registry key that is repeated makes reading fail.  Checks see the
    columns of both; a null check is false.
    """
    n = F.count("*").over(Window.partitionBy(on))
    single = registry.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a registry key is repeated")).cast("boolean"))).drop("_n")
    out = source.join(single, on).withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    every = F.lit(True)
    for k in checks:
        every = every & F.col(k)
    return out.withColumn("join_verified", every)


def match_names(areas: DataFrame, cohort: DataFrame, stem) -> DataFrame:
    """``area, entity_id``: each area's one entity of its exact name, else of its stem; null if not one.

    ``cohort`` is entity_id, name; ``stem`` maps a name's column to its stem.
    The stem is tried only if no name is equal.
    """
    one = lambda key, tag: cohort.groupBy(key.alias("_key")).agg(F.count("*").alias(f"n_{tag}"), F.min("entity_id").alias(f"e_{tag}"))
    found = areas.select("area").distinct().join(one(F.col("name"), "exact"), F.col("area") == F.col("_key"), "left").drop("_key")
    found = found.join(one(stem(F.col("name")), "stem"), stem(F.col("area")) == F.col("_key"), "left").drop("_key")
    pick = F.when(F.col("n_exact") == 1, F.col("e_exact")).when(F.col("n_exact").isNull() & (F.col("n_stem") == 1), F.col("e_stem"))
    return found.select("area", pick.alias("entity_id"))


def one_area_each(matched: DataFrame) -> DataFrame:
    """One row: how many entities more than one area claims."""
    return matched.where("entity_id is not null").groupBy("entity_id").count().where("count > 1").agg(F.count("*").alias("claimed_twice"))


def bridge_values(entities: DataFrame, source: DataFrame, anomaly: str | None = None) -> DataFrame:
    """``entity_id, code, value, status``: each entity's one value by its code.

    ``entities`` is entity_id, code; ``source`` is code, value, comment.
    Values marked ``anomaly`` or missing do not count; of the rest one distinct
    value is matched, several are ambiguous.
    """
    odd = F.col("comment").eqNullSafe(F.lit(anomaly)) if anomaly is not None else F.lit(False)
    fit = ~odd & F.col("value").isNotNull()
    per = source.groupBy("code").agg(F.count("*").alias("rows"), F.count(F.when(odd, 1)).alias("odd"), F.count_distinct(F.when(fit, F.col("value"))).alias("n"), F.max(F.when(fit, F.col("value"))).alias("v"))
    status = (
        F.when(F.col("rows").isNull(), "no_code_match")
        .when((F.col("n") == 0) & (F.col("odd") > 0), "flagged_anomalous")
        .when(F.col("n") == 0, "empty_in_source")
        .when(F.col("n") > 1, "ambiguous")
        .otherwise("matched")
    )
    out = entities.join(per, "code", "left").withColumn("status", status)
    return out.select("entity_id", "code", F.when(F.col("status") == "matched", F.col("v")).alias("value"), "status")


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row of counts: keys of one side only, and repeated keys of each."""
    count = lambda t, tag: t.groupBy(key).agg(F.count("*").alias(tag))
    both = count(a, "na").join(count(b, "nb"), key, "full")
    return both.agg(_count(F.col("nb").isNull()).alias("only_first"), _count(F.col("na").isNull()).alias("only_second"), F.count(F.when(F.col("na") > 1, 1)).alias("repeated_first"), F.count(F.when(F.col("nb") > 1, 1)).alias("repeated_second"))


def conflict_flag(table: DataFrame, *keys: str) -> DataFrame:
    """The table with ``conflicting_key``: whether its key occurs more than once."""
    return table.withColumn("conflicting_key", F.count("*").over(Window.partitionBy(*keys)) > 1)


def split_membership(table: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is among the members, and those whose key is not (a null is not)."""
    keys = members.select(key)
    return table.join(keys, key, "left_semi"), table.join(keys, key, "left_anti")


# --- configurations, checked on the driver ------------------------------------------


@dataclass(frozen=True)
class ContractGate:
    """What must be confirmed before features, fitting or coupling over time are allowed."""

    source_verified: bool = False
    units_verified: bool = False
    execution_allowed: bool = False
    identity_mode: str = ""

    def features(self) -> None:
        if not (self.source_verified and self.units_verified):
            raise ValueError("the source and its units are not confirmed")

    def fitting(self) -> None:
        self.features()
        if not self.execution_allowed:
            raise ValueError("fitting is not allowed by the configuration")

    def over_time(self) -> None:
        self.fitting()
        if self.identity_mode in ("", "unique_name_provisional"):
            raise ValueError("provisional names cannot carry changes over time")


@dataclass(frozen=True)
class LeidenSettings:
    """Settings of community detection; a negative number of iterations runs until nothing is gained."""

    resolution: float = 1.0
    seed: int = 0
    iterations: int = -1
    k: int = 15

    def __post_init__(self) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if not isinstance(self.resolution, (int, float)) or isinstance(self.resolution, bool) or not 0 < self.resolution < float("inf"):
            raise ValueError("the resolution must be positive and finite")
        if not whole(self.seed) or self.seed < 0:
            raise ValueError("the seed must be a whole number of nought or more")
        if not whole(self.iterations) or self.iterations == 0:
            raise ValueError("the iterations must be a whole number other than nought")
        if not whole(self.k) or self.k < 1:
            raise ValueError("k must be a positive whole number")
