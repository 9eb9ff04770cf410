"""Groupings against an outcome: effects, tests, bounds and profiles of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.quantiles import exact_quantiles
from panelloom.operators.tails import chi2_tail
from panelloom.sources.shared import materialize


def eta_squared(table: DataFrame, by: str, value: str) -> DataFrame:
    """One row: between over total sum of squares, NULL without variance."""
    groups = table.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    mean = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2))
    return groups.join(F.broadcast(mean)).agg(F.when(between + F.sum("w") > 1e-12, between / (between + F.sum("w"))).alias("eta2"))


def centred(table: DataFrame, by: str, value: str) -> DataFrame:
    """``value`` less its group's mean."""
    return table.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(by)))


def kruskal_h(table: DataFrame, by: str, value: str) -> DataFrame:
    """One row: H with the correction for ties, groups and rows.

    Average ranks come from counts of distinct values, summed in order; only
    the distinct values pass through one ordered window, not the rows.
    """
    rows = table.where(F.col(value).isNotNull())
    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn("rank", upto - (F.col("c") - 1) / 2)
    ties = counts.agg(F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"), F.sum("c").alias("n"))
    groups = rows.join(ranks, value).groupBy(by).agg(F.count("*").alias("m"), F.sum("rank").alias("r"))
    h = groups.agg(F.sum(F.pow("r", 2) / F.col("m")).alias("q"), F.count("*").alias("k")).join(F.broadcast(ties))
    return h.select(F.expr("try_divide(12 / (n * (n + 1)) * q - 3 * (n + 1), 1 - ties / (pow(n, 3) - n))").alias("h"), "k", "n")


def kruskal_test(table: DataFrame, by: str, value: str, least: int = 5) -> DataFrame:
    """One row ``h, p, epsilon2, k, n``: :func:`kruskal_h` of the groups of ``least`` rows or more.

    ``epsilon2`` is (H - k + 1) / (n - k); p and it are null for fewer than two groups.
    """
    rows = table.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    kept = rows.groupBy(by).count().where(F.col("count") >= least).select(by)
    h = kruskal_h(rows.join(kept, by, "left_semi"), by, value).first()
    some = h["h"] is not None and h["k"] > 1 and h["n"] > h["k"]
    out = (h["h"], chi2_tail(h["h"], h["k"] - 1) if some else None, (h["h"] - h["k"] + 1) / (h["n"] - h["k"]) if some else None, h["k"], h["n"])
    return table.sparkSession.createDataFrame([out], "h double, p double, epsilon2 double, k long, n long")


def epsilon_squared(table: DataFrame, by: str, value: str) -> DataFrame:
    """One row ``epsilon2``: the share of variance between groups, less what chance would give."""
    rows = table.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    groups = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    mean = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    one = groups.join(F.broadcast(mean)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return one.select(F.try_divide(F.col("b") - (F.col("k") - 1) * F.try_divide(F.col("w"), F.col("n") - F.col("k")), F.col("b") + F.col("w")).alias("epsilon2"))


def holm(values: DataFrame, family: str | None = None) -> DataFrame:
    """``id, p, adjusted`` by Holm's step-down rule, within each ``family`` if one is named."""
    by = [family] if family else []
    w = Window.partitionBy(*by).orderBy("p", "id")
    m = F.count("*").over(Window.partitionBy(*by))
    raw = values.withColumn("raw", (m - F.row_number().over(w) + 1) * F.col("p"))
    return raw.select(*by, "id", "p", F.least(F.lit(1.0), F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("adjusted"))


def ratio_audit(table: DataFrame, ratio: Column) -> DataFrame:
    """One row: quantiles of a ratio at 0, 0.01, 0.5, 0.99 and 1, and how many exceed one.

    The ratios are written once, as they are read for the counts and twice for
    the quantiles, which no buffer of values holds.
    """
    rows = materialize(table.select(ratio.alias("r")).where("r is not null"), "ratios")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("r") > 1, 1)).alias("n_above"))
    q = exact_quantiles(rows, [], "r", (0.0, 0.01, 0.5, 0.99, 1.0)).select("q")
    both = counts.join(F.broadcast(q), how="left")  # one row, or none
    return both.select("n", "n_above", *[F.col("q")[i].alias(name) for i, name in enumerate(("q0", "q01", "q50", "q99", "q100"))])


def group_profile(table: DataFrame, by: str, medians: list[str], listed: str, top: int = 3) -> DataFrame:
    """``by, n``, medians, and the ``top`` most frequent values of ``listed``, ties to the least."""
    sizes = table.groupBy(by).agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in medians])
    counts = table.groupBy(by, F.col(listed).cast("string").alias("v")).agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), "v"))
    most = counts.withColumn("p", place).where(F.col("p") <= top).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.concat_ws(":", "v", F.col("c").cast("string")).alias("t")))), lambda x: x["t"]), ",").alias("most"))
    return sizes.join(most, by, "left")


def modal(table: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, n``: the most frequent value of each key, the least of several; nulls do not count."""
    counts = table.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v"))).alias("best")).select(key, F.col("best.v").alias(value), (-F.col("best.col1")).alias("n"))


def mirkin(table: DataFrame, by: str, values: list[str], threshold: float) -> DataFrame:
    """``by, name, deviation, salient``: (group mean - overall mean) / overall mean of each column."""
    groups = table.groupBy(by).agg(*[F.avg(c).alias(c) for c in values])
    whole = table.agg(*[F.avg(c).alias(f"all_{c}") for c in values])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.try_divide(F.col(c) - F.col(f"all_{c}"), F.col(f"all_{c}")).alias("deviation")) for c in values])).alias("x")
    out = groups.crossJoin(F.broadcast(whole)).select(by, pairs).select(by, "x.name", "x.deviation")
    return out.withColumn("salient", F.abs("deviation") >= threshold)


def coverage(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``by, n`` and the number of values that are there, per group and (``by`` null) in all."""
    counts = [F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns]]
    return table.groupBy(by).agg(*counts).unionByName(table.agg(*counts).withColumn(by, F.lit(None).cast(table.schema[by].dataType)))


def loss_bounds(table: DataFrame, region: str, y: str, candidate: str, reference: str) -> DataFrame:
    """One row: sharp bounds on the mean loss of the reference less the candidate's.

    Where ``y`` is missing it may be anything from nought to one; rows are
    averaged by region, and regions equally.  Predictions out of that range,
    or observed values, are an error.
    """
    a, b, v = F.col(candidate), F.col(reference), F.col(y)
    bad = lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    checked = table.withColumn("_ok", F.when(bad(a) | bad(b) | (v.isNotNull() & bad(v)), F.raise_error(F.lit("shares must lie between nought and one"))).otherwise(F.lit(True)))
    zero, one = b * b - a * a, F.pow(1 - b, 2) - F.pow(1 - a, 2)
    real = F.pow(v - b, 2) - F.pow(v - a, 2)
    rows = checked.where("_ok").select(region, v.isNotNull().alias("seen"), F.coalesce(real, F.least(zero, one)).alias("low"), F.coalesce(real, F.greatest(zero, one)).alias("high"))
    per = rows.groupBy(region).agg(F.count("*").alias("n"), F.sum(F.col("seen").cast("long")).alias("seen"), F.sum("low").alias("ls"), F.sum("high").alias("hs"))
    out = per.agg(F.sum("n").alias("n"), F.sum("seen").alias("observed"), F.count(F.when(F.col("seen") == 0, 1)).alias("unseen_regions"), F.avg(F.col("ls") / F.col("n")).alias("equal_low"), F.avg(F.col("hs") / F.col("n")).alias("equal_high"), (F.sum("ls") / F.sum("n")).alias("row_low"), (F.sum("hs") / F.sum("n")).alias("row_high"))
    verdict = F.when(F.col("equal_low") > 0, "candidate_better").when(F.col("equal_high") < 0, "candidate_worse").otherwise("not_identified")
    return out.withColumn("conclusion", verdict)


def median_bounds(table: DataFrame, by: str, value: str, reference: DataFrame) -> DataFrame:
    """``by, observed, low, high``: the least and greatest median if missing rows may be anything.

    ``reference`` has ``by, n``, the rows that there should be; more observed
    than that is an error.
    """
    rows = table.where(F.col(value).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"))
    full = reference.select(by, F.col("n").alias("n_all")).join(rows, by, "left").withColumn("x", F.coalesce("x", F.array().cast("array<double>")))
    missing = F.when(F.size("x") > F.col("n_all"), F.raise_error(F.lit("more rows than the reference has"))).otherwise(F.col("n_all") - F.size("x")).cast("int")
    infinite = float("inf")

    def middle(x: Column) -> Column:
        at = F.floor((F.col("n_all") - 1) / 2).cast("int")
        left, right = F.get(x, at), F.get(x, F.floor(F.col("n_all") / 2).cast("int"))
        return F.when(left == right, left).otherwise((left + right) / 2)

    low = F.concat(F.array_repeat(F.lit(-infinite), missing), F.col("x"))
    high = F.concat(F.col("x"), F.array_repeat(F.lit(infinite), missing))
    return full.withColumns({"lo": low, "hi": high}).select(by, F.size("x").cast("long").alias("observed"), middle(F.col("lo")).alias("low"), middle(F.col("hi")).alias("high"))


def seasonal_contrast(table: DataFrame, by: str, month: str, value: str, season: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """``by, contrast``: the mean value in the season's months less that in the others; ``by`` null is all."""
    inside = F.col(month).isin(*season)
    contrast = (F.avg(F.when(inside, F.col(value))) - F.avg(F.when(~inside, F.col(value)))).alias("contrast")
    return table.groupBy(by).agg(contrast).unionByName(table.agg(contrast).withColumn(by, F.lit(None).cast(table.schema[by].dataType)))


def paired_change(table: DataFrame, entity: str, by: str, year: str, value: str, first: int, second: int) -> DataFrame:
    """``by, n, change``: the median over entities of the second year's median less the first's."""
    medians = table.where(F.col(year).isin(first, second)).groupBy(entity, by).agg(F.median(F.when(F.col(year) == first, F.col(value))).alias("a"), F.median(F.when(F.col(year) == second, F.col(value))).alias("b"))
    return medians.where("a is not null and b is not null").groupBy(by).agg(F.count("*").alias("n"), F.median(F.col("b") - F.col("a")).alias("change"))


def wide_outcomes(table: DataFrame, entity: str, part: str, value: str, parts: list[str]) -> DataFrame:
    """``entity, total`` and the share of each part, null unless all parts are there and it lies in [0, 1]."""
    wide = table.groupBy(entity).pivot(part, parts).agg(F.sum(value))
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(f"`{p}`")
    shares = {f"share_{i}": F.try_divide(F.col(f"`{p}`"), F.col("total")) for i, p in enumerate(parts)}
    return wide.withColumn("total", total).select(entity, "total", *[F.when((s >= 0) & (s <= 1), s).alias(n) for n, s in shares.items()])


def transformed(value: Column, transform: str) -> Column:
    """The value, or its logarithm where it is positive and null elsewhere."""
    if transform not in ("none", "log"):
        raise ValueError("the transform is none or log")
    return F.when(value > 0, F.ln(value)) if transform == "log" else value


def stratum(kind: str, region: Column, type_: Column) -> Column:
    """The stratum of a row: all, its region, or its region and type."""
    return {"all": F.lit("all"), "region": region.cast("string"), "region_type": F.concat_ws("|", region.cast("string"), type_.cast("string"))}[kind]


def effects_by_group(table: DataFrame, by: str, values: list[str]) -> DataFrame:
    """``indicator, group, n``, quartiles of each group's values."""
    out = None
    for c in values:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        part = table.where(F.col(c).isNotNull()).groupBy(F.col(by).alias("group")).agg(F.count("*").alias("n"), q.alias("q")).select(F.lit(c).alias("indicator"), "group", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
        out = part if out is None else out.unionByName(part)
    return out


def gates(table: DataFrame, baseline: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """The table with ``pass_x`` for each rule and ``passes`` if all hold; null fails.

    A rule of column x is ("least", share of the baseline's x), ("most", share)
    or ("near", tolerance).  ``baseline`` is one row.
    """
    base = baseline.select(*[F.col(c).alias(f"_b_{c}") for c in rules])
    tests = {}
    for c, (kind, number) in rules.items():
        x, b = F.col(c), F.col(f"_b_{c}")
        tests[f"pass_{c}"] = F.coalesce({"least": x >= number * b, "most": x <= number * b, "near": F.abs(x - b) <= number}[kind], F.lit(False))
    every = F.lit(True)
    for c in rules:
        every = every & F.col(f"pass_{c}")
    return table.crossJoin(F.broadcast(base)).withColumns(tests).withColumn("passes", every).drop(*base.columns)


def region_error_sums(table: DataFrame, region: str, error: str) -> DataFrame:
    return table.groupBy(region).agg(F.count("*").alias("n"), F.sum(F.pow(error, 2)).alias("sse"), F.var_samp(error).alias("variance"))
