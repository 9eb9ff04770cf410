"""Series of one value per key and month number: ``key, t, v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seasonal_profile(series: DataFrame) -> DataFrame:
    """``key, month, seasonal``: mean deviation from the centred 2 x 12 average, centred.

    A month whose average would lack a month is left out, be it at the ends or
    beside a gap.
    """
    w = Window.partitionBy("key").orderBy("t")
    trend = (F.avg("v").over(w.rangeBetween(-6, 5)) + F.avg("v").over(w.rangeBetween(-5, 6))) / 2
    around = F.count("v").over(w.rangeBetween(-6, 6))
    inner = series.withColumns({"gap": F.col("v") - trend, "around": around}).where("around = 13")
    means = inner.groupBy("key", F.pmod("t", F.lit(12)).alias("month")).agg(F.avg("gap").alias("m"))
    return means.select("key", "month", (F.col("m") - F.avg("m").over(Window.partitionBy("key"))).alias("seasonal"))


def linear_trend(series: DataFrame) -> DataFrame:
    return series.groupBy("key").agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("intercept"))


def trend_step(series: DataFrame, at: int) -> DataFrame:
    """``key, trend, step, residual_sd``: v on t and on whether t has reached ``at``.

    The deviation has n - 3 degrees of freedom; a key that does not see both
    sides has nulls.
    """
    jump = (F.col("t") >= at).cast("double")
    c = {"tt": F.var_pop("t"), "ss": F.var_pop(jump), "ts": F.covar_pop("t", jump), "ty": F.covar_pop("t", "v"), "sy": F.covar_pop(jump, "v"), "yy": F.var_pop("v")}
    m = series.groupBy("key").agg(F.count("*").alias("n"), *[f.alias(k) for k, f in c.items()])
    det = "(tt * ss - ts * ts)"
    m = m.withColumns({"trend": F.expr(f"try_divide(ty * ss - sy * ts, {det})"), "step": F.expr(f"try_divide(sy * tt - ty * ts, {det})")})
    rest = F.expr("n * (yy - trend * ty - step * sy)")
    return m.select("key", "trend", "step", F.sqrt(F.try_divide(F.greatest(F.lit(0.0), rest), F.when(F.col("n") > 3, F.col("n") - 3))).alias("residual_sd"))


def seams(series: DataFrame, first: int) -> DataFrame:
    """The step between two years that begin at ``first``, beside the steps within them, one row a key.

    ``seam`` is January's signed step; ``n_larger`` counts the other monthly
    steps as large, of ``n_steps``, whose deviation is ``step_sd``.  Then steps
    between named months of each year and the change of the same month; all
    are null for a key that lacks one of the 24 months.
    """
    rows = series.where(F.col("t").between(first, first + 23)).select("key", (F.col("t") - first).alias("m"), "v")
    w = Window.partitionBy("key").orderBy("m")
    steps = rows.withColumn("d", F.col("v") - F.lag("v").over(w))
    wide = steps.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("m", "v"))).alias("x"), F.max(F.when(F.col("m") == 12, F.col("d"))).alias("seam"), F.collect_list(F.when(F.col("m") != 12, F.col("d"))).alias("inner_steps"), F.stddev_samp(F.when(F.col("m") != 12, F.col("d"))).alias("step_sd"))
    whole = wide.where("n = 24")
    at = lambda i: F.col("x")[i]["v"]
    same = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get("x", i + 12)["v"] - F.get("x", i)["v"])
    out = whole.select(
        "key",
        "seam",
        F.size(F.filter("inner_steps", lambda d: F.abs(d) >= F.abs(F.col("seam")))).cast("long").alias("n_larger"),
        F.size("inner_steps").cast("long").alias("n_steps"),
        "step_sd",
        (at(11) - at(10)).alias("nov_dec_first"),
        (at(23) - at(22)).alias("nov_dec_second"),
        (at(12) - at(0)).alias("january_change"),
        (at(0) - at(1)).alias("jan_feb_first"),
        (at(12) - at(13)).alias("jan_feb_second"),
        (at(11) - at(0)).alias("jan_dec_first"),
        (at(23) - at(12)).alias("jan_dec_second"),
        (at(10) - at(1)).alias("feb_nov_first"),
        (at(22) - at(13)).alias("feb_nov_second"),
        F.aggregate(same, F.lit(0.0), lambda s, x: s + x, lambda s: s / 12).alias("same_month_mean"),
        F.array_min(same).alias("same_month_min"),
    )
    return series.select("key").distinct().join(out, "key", "left")


def residual_series(series: DataFrame) -> DataFrame:
    """``key, t, r``: ln v less the month's median, then each key's mean and deviation."""
    median = series.groupBy("t").agg(F.median(F.ln("v")).alias("med"))
    gaps = series.join(median, "t").select("key", "t", (F.ln("v") - F.col("med")).alias("g"))
    own = Window.partitionBy("key")
    sd = F.stddev_pop("g").over(own)
    return gaps.select("key", "t", F.when(sd > 1e-12, (F.col("g") - F.avg("g").over(own)) / sd).otherwise(0.0).alias("r"))


def switches(labels: DataFrame, within: int = 3) -> DataFrame:
    """``key, n_switches, n_flip_backs`` of label series ``key, t, label``.

    A flip-back is a switch away from a label that returns within ``within`` steps.
    """
    w = Window.partitionBy("key").orderBy("t")
    before = F.lag("label").over(w)
    later = [F.lead("label", k).over(w) for k in range(1, within + 1)]
    back = F.lit(False)
    for x in later:
        back = back | F.coalesce(x == F.col("before"), F.lit(False))
    marked = labels.withColumn("before", before).withColumn("back", back).withColumn("moved", F.col("label") != F.col("before"))
    return marked.groupBy("key").agg(F.count(F.when(F.col("moved"), 1)).alias("n_switches"), F.count(F.when(F.col("moved") & F.col("back"), 1)).alias("n_flip_backs"))


def follow(table: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row beside its key's row one step later: ``key, at, value, value_next``; gaps have no row."""
    after = table.select(F.col(key), (F.col(at) - 1).alias(at), F.col(value).alias(f"{value}_next"))
    return table.select(key, at, value).join(after, [key, at])


def same_month_shift(long: DataFrame, first_year: int, second_year: int) -> DataFrame:
    """``entity, dim, raw, relative``: the second year's medians as they are, and less each month's common change.

    ``long`` has entity, period (YYYY-MM-01), dim, x; the common change of a
    calendar month is that of its median over entities.
    """
    rows = long.withColumns({"year": F.substring("period", 1, 4).cast("int"), "month": F.substring("period", 6, 2).cast("int")}).where(F.col("year").isin(first_year, second_year))
    medians = rows.groupBy("month", "dim").agg(F.median(F.when(F.col("year") == first_year, F.col("x"))).alias("a"), F.median(F.when(F.col("year") == second_year, F.col("x"))).alias("b"))
    moved = rows.where(F.col("year") == second_year).join(F.broadcast(medians), ["month", "dim"])
    return moved.groupBy("entity", "dim").agg(F.median("x").alias("raw"), F.median(F.col("x") - (F.col("b") - F.col("a"))).alias("relative"))


def drift_scenarios(long: DataFrame, reference: DataFrame, dims: int) -> DataFrame:
    """``scenario, entity, period, dim, x``: features as they are, and less the common shift.

    The shift of a period is its median over entities less the median of the
    ``reference`` (entity, dim, x); it is taken from all coordinates, and from
    each alone.
    """
    home = reference.groupBy("dim").agg(F.median("x").alias("home"))
    shift = long.groupBy("period", "dim").agg(F.median("x").alias("m")).join(F.broadcast(home), "dim").select("period", "dim", (F.col("m") - F.col("home")).alias("shift"))
    rows = long.join(F.broadcast(shift), ["period", "dim"])
    names = ["as_is", "all", *[f"dim_{d}" for d in range(dims)]]
    every = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, names))))
    taken = (F.col("scenario") == "all") | (F.col("scenario") == F.concat(F.lit("dim_"), F.col("dim").cast("string")))
    return every.select("scenario", "entity", "period", "dim", (F.col("x") - F.when(taken, F.col("shift")).otherwise(0.0)).alias("x"))


def displacement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: the squared displacement of vectors (id, dim, x), of which the common part and the rest.

    The common part is n times the squared mean displacement; ids that lack a
    side are left out.
    """
    gaps = first.select("id", "dim", F.col("x").alias("a")).join(second.select("id", "dim", F.col("x").alias("b")), ["id", "dim"]).withColumn("d", F.col("b") - F.col("a"))
    per = gaps.groupBy("dim").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("s"), (F.var_pop("d") * F.count("*")).alias("r"))
    one = per.agg(F.sum("s").alias("total"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("common"), F.sum("r").alias("individual"))
    return one.select("total", "common", "individual", F.coalesce(F.try_divide("common", "total"), F.lit(0.0)).alias("common_fraction"))


def month_blocks(spark, draws: int, months: int, block: int, seed: int) -> DataFrame:
    """``draw, place, month``: circular blocks of months, as many as fill the calendar, drawn again.

    A block's start comes from an MD5 of seed, draw and block.
    """
    if months % block:
        raise ValueError("the blocks must fill the months")
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    starts = spark.range(draws).withColumnRenamed("id", "draw").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(months // block - 1)))).withColumn("start", F.pmod(number, F.lit(months)))
    every = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return every.select("draw", (F.col("b") * block + F.col("i")).cast("int").alias("place"), F.pmod(F.col("start") + F.col("i"), F.lit(months)).cast("int").alias("month"))
