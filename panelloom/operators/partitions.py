"""Indices and rules for partitions: quality, agreement, renaming, selection.

A partition is ``id, cluster``.  Tables of candidates have one row per
candidate and one column per index; an index that is null is undefined.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import graph

#: Clusters whose centres are broadcast.
MOST_CLUSTERS = 5000


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centres(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """``cluster, n, centre, variance``: coordinate-wise means and population variances."""
    long = graph.whole_vectors(vectors).join(partition, "id").select("cluster", F.posexplode("vector").alias("dim", "x"))
    per = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    own = per.groupBy("cluster").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "m", "v"))).alias("c"))
    return own.select("cluster", "n", F.transform("c", lambda x: x["m"]).alias("centre"), F.transform("c", lambda x: x["v"]).alias("variance"))


def s_dbw(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: S_Dbw by balls within a radius, and as printed, by what is outside it.

    The radius is the root of the summed norms of the clusters' variances over
    their number.  A pair of clusters of which neither centre has density
    makes an index null (``undefined_pairs`` and ``undefined_pairs_outside``
    count them), as do constant data and fewer than two clusters.
    """
    found = centres(vectors, partition).cache()
    k = found.count()
    if k > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    norm = F.sqrt(F.aggregate("variance", F.lit(0.0), lambda s, x: s + x * x))
    spread = found.agg(F.sqrt(F.sum(norm)).alias("root"), F.avg(norm).alias("mean_norm")).withColumn("radius", F.col("root") / F.lit(float(max(k, 1))))
    rows = graph.whole_vectors(vectors).join(partition, "id").select("cluster", "vector")
    whole = rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("total"))
    model = F.broadcast(found.select("cluster", "centre"))
    placed = rows.join(model, "cluster").crossJoin(F.broadcast(spread.select("radius")))
    inside = lambda point: F.sum((_distance(F.col("vector"), point) <= F.col("radius")).cast("long"))
    density = placed.groupBy("cluster").agg(inside(F.col("centre")).alias("d"), F.count("*").alias("n"))
    other = F.broadcast(found.select(F.col("cluster").alias("other"), F.col("centre").alias("far")))
    middle = F.zip_with("centre", "far", lambda x, y: (x + y) / 2)
    mids = placed.crossJoin(other).where("cluster <> other").groupBy(F.least("cluster", "other").alias("i"), F.greatest("cluster", "other").alias("j")).agg(inside(middle).alias("num"), F.count("*").alias("m"))
    pairs = mids.join(density.select(F.col("cluster").alias("i"), F.col("d").alias("di"), F.col("n").alias("ni")), "i").join(density.select(F.col("cluster").alias("j"), F.col("d").alias("dj"), F.col("n").alias("nj")), "j")
    den, den_out = F.greatest("di", "dj"), F.greatest(F.col("ni") - F.col("di"), F.col("nj") - F.col("dj"))
    between = pairs.agg(
        F.sum(F.try_divide(2 * F.col("num"), den)).alias("b"),
        F.count(F.when(den == 0, 1)).alias("undefined_pairs"),
        F.sum(F.try_divide(2 * (F.col("m") - F.col("num")), den_out)).alias("b_out"),
        F.count(F.when(den_out == 0, 1)).alias("undefined_pairs_outside"),
    )
    one = between.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(whole))
    scatter = F.try_divide("mean_norm", "total")
    pairs_of = F.lit(float(k * (k - 1)))
    value = lambda b, undefined: F.when((F.col(undefined) == 0) & (pairs_of > 0), scatter + F.try_divide(F.col(b), pairs_of))
    return one.select(value("b", "undefined_pairs").alias("s_dbw"), value("b_out", "undefined_pairs_outside").alias("s_dbw_outside"), "radius", "undefined_pairs", "undefined_pairs_outside")


# --- agreement ------------------------------------------------------------------


def _expected_information(rows: np.ndarray, cols: np.ndarray) -> float:
    """The mean mutual information of tables with these margins.

    Each cell is hypergeometric; what is further than 40 deviations from its
    mean is nought in doubles and left out, so the work does not grow with
    the counts.
    """
    n = int(rows.sum())
    lg = np.vectorize(lgamma)
    total = 0.0
    for a in rows.tolist():
        for b in cols.tolist():
            mean = a * b / n
            sd = np.sqrt(max(mean * (1 - a / n) * (n - b) / max(n - 1, 1), 0.0))
            low = max(1, a + b - n, int(mean - 40 * sd - 40))
            high = min(a, b, int(mean + 40 * sd + 40))
            if high < low:
                continue
            x = np.arange(low, high + 1, dtype=float)
            log_p = lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lg(x + 1) - lg(a - x + 1) - lg(b - x + 1) - lg(n - a - b + x + 1)
            total += float((x / n * np.log(n * x / (a * b)) * np.exp(log_p)).sum())
    return total


def adjusted_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ami, n``: mutual information adjusted for chance, by the mean entropy.

    Two partitions of one cluster each agree fully (1.0).  The driver sees the
    sizes of the clusters, at most ``MOST_CLUSTERS`` a side.
    """
    spark = pairs.sparkSession
    table = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).cache()
    margins = [np.array([r[0] for r in table.groupBy(c).agg(F.sum("n")).select("sum(n)").limit(MOST_CLUSTERS + 1).collect()]) for c in (a, b)]
    if max(len(m) for m in margins) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    if not len(margins[0]):
        return spark.createDataFrame([(None, 0)], "ami double, n long")
    n = int(margins[0].sum())
    entropy = [float(-(m / n * np.log(m / n)).sum()) for m in margins]
    own = table.agg(F.sum(F.col("n") * F.ln("n"))).first()[0]
    information = own / n + float(np.log(n)) - sum(float((m * np.log(m)).sum()) for m in margins) / n
    information = information - 0.0
    mean = _expected_information(*margins)
    spread = sum(entropy) / 2 - mean
    ami = 1.0 if len(margins[0]) == len(margins[1]) == 1 else (information - mean) / spread if abs(spread) > 1e-15 else 0.0
    return spark.createDataFrame([(float(ami), n)], "ami double, n long")


def canonical(partition: DataFrame, by: str = "size") -> DataFrame:
    """``id, cluster`` renumbered from nought: by size, then first id; or by first id alone."""
    groups = partition.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = [F.desc("n"), "first"] if by == "size" else ["first"]
    new = groups.select("cluster", (F.row_number().over(Window.orderBy(*order)) - 1).alias("new"))
    return partition.join(F.broadcast(new) if groups.count() <= MOST_CLUSTERS else new, "cluster").select("id", F.col("new").alias("cluster"))


def equivalent(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``equivalent``: whether labels ``a`` and ``b`` differ only by a renaming."""
    seen = pairs.select(a, b).distinct()
    many = lambda x, y: seen.groupBy(x).agg(F.count_distinct(F.struct(y)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias(f"n_{x}"))
    return many(a, b).crossJoin(F.broadcast(many(b, a))).select(((F.col(f"n_{a}") == 1) & (F.col(f"n_{b}") == 1)).alias("equivalent"))


def neighbourhoods(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``id, jaccard, retention``: the peers of each id under both labellings, itself left out.

    Without peers on either side Jaccard's index is 1; without earlier ones
    retention is null.
    """
    cell = Window.partitionBy(a, b)
    sized = pairs.withColumns({"both": F.count("*").over(cell) - 1, "old": F.count("*").over(Window.partitionBy(a)) - 1, "new": F.count("*").over(Window.partitionBy(b)) - 1})
    return sized.select("id", F.coalesce(F.try_divide("both", F.col("old") + F.col("new") - F.col("both")), F.lit(1.0)).alias("jaccard"), F.try_divide("both", "old").alias("retention"))


def pair_histogram(labels: DataFrame, reference: str, repeats: list[str]) -> DataFrame:
    """``left, right, together, pairs``: how often pairs of two reference groups share a cluster.

    ``labels`` has a column per repeat.  Rows with the same labels throughout
    are one signature; signatures meet, not rows, so the work does not grow
    with the rows of each.
    """
    kinds = labels.groupBy(reference, *repeats).agg(F.count("*").alias("n"))
    numbered = kinds.withColumn("k", F.xxhash64(reference, *repeats)).select(F.col(reference).alias("g"), F.array(*[F.col(r).cast("string") for r in repeats]).alias("z"), "n", "k")
    x, y = (numbered.select(*[F.col(c).alias(f"{c}_{s}") for c in numbered.columns]) for s in "xy")
    met = x.join(y, (F.col("g_x") < F.col("g_y")) | ((F.col("g_x") == F.col("g_y")) & (F.col("k_x") <= F.col("k_y"))))
    same = F.aggregate(F.zip_with("z_x", "z_y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    number = F.when((F.col("g_x") == F.col("g_y")) & (F.col("k_x") == F.col("k_y")), F.expr("n_x * (n_x - 1) div 2")).otherwise(F.col("n_x") * F.col("n_y"))
    return met.groupBy(F.col("g_x").alias("left"), F.col("g_y").alias("right"), same.alias("together")).agg(F.sum(number).alias("pairs")).where("pairs > 0")


# --- tables of candidates -----------------------------------------------------------




def spearman(table: DataFrame, key: str, directions: dict[str, int]) -> DataFrame:
    """``a, b, n, rho``: rank correlation of each two indices, oriented so that more is better.

    Only candidates with both indices count; fewer than three, or constant
    ones, give null.
    """
    long = None
    for name, sign in directions.items():
        part = table.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.lit(name).alias("index"), (F.col(name) * sign).cast("double").alias("v"))
        long = part if long is None else long.unionByName(part)
    pairs = long.select("key", F.col("index").alias("a"), F.col("v").alias("x")).join(long.select("key", F.col("index").alias("b"), F.col("v").alias("y")), "key").where("a <= b")
    ranked = pairs
    for value, rank in (("x", "rx"), ("y", "ry")):
        ordered, tied = Window.partitionBy("a", "b").orderBy(value), Window.partitionBy("a", "b", value)
        ranked = ranked.withColumn(rank, F.rank().over(ordered) + (F.count("*").over(tied) - 1) / 2)
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") > 2, rho).alias("rho"))


def pareto(table: DataFrame, key: str, directions: dict[str, int]) -> DataFrame:
    """The candidates that no other beats: at least as good in all and better in one; null is worst."""
    worst = F.lit(float("-inf"))
    scored = table.select(F.col(key).alias("_key"), *[F.coalesce(F.col(c).cast("double") * s, worst).alias(f"_{c}") for c, s in directions.items()])
    other = scored.select(F.col("_key").alias("_other"), *[F.col(f"_{c}").alias(f"_o{c}") for c in directions])
    as_good, better = F.lit(True), F.lit(False)
    for c in directions:
        as_good, better = as_good & (F.col(f"_o{c}") >= F.col(f"_{c}")), better | (F.col(f"_o{c}") > F.col(f"_{c}"))
    front = scored.join(F.broadcast(other), as_good & better, "left_anti").select(F.col("_key").alias(key))
    return table.join(front, key, "left_semi")


def select_variant(table: DataFrame, key: str, admissible: Column, front: dict[str, int], ranks: list[tuple[str, int, float]], ties: list[tuple[str, int]]) -> DataFrame:
    """``key, on_front, rank_sum, place`` of the admissible candidates.

    Those on the Pareto front are ordered by the weighted sum of their average
    ranks (more is better), then by the ``ties`` and by name; ``place`` 1 is
    the choice.  Null is minus infinity throughout.
    """
    rows = table.where(admissible)
    worst = F.lit(float("-inf"))
    best = pareto(rows, key, front)
    total = F.lit(0.0)
    for name, sign, weight in ranks:
        value = F.coalesce(F.col(name).cast("double") * sign, worst)
        best = best.withColumn("_v", value)
        best = best.withColumn(f"_r{name}", F.rank().over(Window.orderBy("_v")) + (F.count("*").over(Window.partitionBy("_v")) - 1) / 2).drop("_v")
        total = total + F.lit(float(weight)) * F.col(f"_r{name}")
    order = [F.desc("rank_sum"), *[F.desc(F.coalesce(F.col(c).cast("double") * s, worst)) for c, s in ties], F.col(key)]
    best = best.withColumn("rank_sum", total).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return rows.select(key).join(best.select(key, "rank_sum", "place"), key, "left").select(key, F.col("place").isNotNull().alias("on_front"), "rank_sum", "place")


def interior_optima(table: DataFrame, k: str, directions: dict[str, int]) -> DataFrame:
    """``k, index`` where an index beats both neighbouring candidates; ends and nulls never do."""
    w = Window.orderBy(k)
    out = None
    for name, sign in directions.items():
        v = F.col(name) * sign
        part = table.withColumn("_up", (v > F.lag(v).over(w)) & (v > F.lead(v).over(w))).where(F.coalesce("_up", F.lit(False))).select(F.col(k), F.lit(name).alias("index"))
        out = part if out is None else out.unionByName(part)
    return out


def select_k(table: DataFrame, k: str, directions: dict[str, int], admissible: Column, fallback: str, same: dict[str, str] | None = None, min_votes: int = 2) -> DataFrame:
    """``k, admissible, votes, chosen``: the largest admissible k with votes enough.

    A vote is an interior optimum; indices that ``same`` names alike vote
    once.  If no admissible k has ``min_votes``, the one of the greatest
    ``fallback`` is chosen (the least k if several).
    """
    alias = F.col("index")
    for name, family in (same or {}).items():
        alias = F.when(F.col("index") == name, F.lit(family)).otherwise(alias)
    votes = interior_optima(table, k, directions).groupBy(k).agg(F.count_distinct(alias).alias("votes"))
    rows = table.withColumn("admissible", F.coalesce(admissible, F.lit(False))).join(votes, k, "left").fillna(0, ["votes"])
    enough = F.col("admissible") & (F.col("votes") >= min_votes)
    one = rows.agg(F.max(F.when(enough, F.col(k))).alias("voted"), F.max_by(k, F.when(F.col("admissible"), F.struct(F.col(fallback), -F.col(k)))).alias("best"))
    return rows.crossJoin(F.broadcast(one)).select(k, "admissible", "votes", F.coalesce(F.col(k) == F.coalesce("voted", "best"), F.lit(False)).alias("chosen"))


def select_omega(table: DataFrame, omega: str, quality: str, max_drop: float) -> DataFrame:
    """``omega, quality, drop, eligible, selected``: the largest omega whose quality is kept.

    Kept means at least ``1 - max_drop`` times that of omega nought; quality
    need not fall steadily.
    """
    base = table.where(F.col(omega) == 0).agg(F.first(quality).alias("base"))
    rows = table.crossJoin(F.broadcast(base)).withColumn("eligible", F.coalesce(F.col(quality) >= (1 - max_drop) * F.col("base"), F.lit(False)))
    top = rows.agg(F.max(F.when(F.col("eligible"), F.col(omega))).alias("top"))
    return rows.crossJoin(F.broadcast(top)).select(omega, quality, (1 - F.try_divide(quality, "base")).alias("drop"), "eligible", F.coalesce(F.col(omega) == F.col("top"), F.lit(False)).alias("selected"))


def _unseen(table: DataFrame, axes: list[tuple[str, str, int]], k: int, min_size: int) -> DataFrame:
    """``axis, direction, partition, value`` of candidates that may be compared on each axis.

    ``axes`` gives the column of the value, that of its role, and the direction.
    """
    pool = None
    for column, role, sign in axes:
        part = table.where((F.col("k") == k) & (F.col("min_size") >= min_size) & F.col(role).isin("year_2024", "external") & F.col(column).isNotNull())
        part = part.select(F.lit(column).alias("axis"), "partition", F.col(column).cast("double").alias("value"), (F.col(column) * sign).cast("double").alias("score"))
        pool = part if pool is None else pool.unionByName(part)
    return pool.withColumn("candidates", F.count("*").over(Window.partitionBy("axis"))).where("candidates >= 2")


def axis_role(axis: Column, fitted: Column, selected: Column, second_year: Column) -> Column:
    """How a candidate has seen an axis: fit, selection, or only now (by year or from outside)."""
    return F.when(F.array_contains(fitted, axis), "fit").when(F.array_contains(selected, axis), "selection").when(second_year, "year_2024").otherwise("external")


def winners(table: DataFrame, axes: list[tuple[str, str, int]], k: int, min_size: int, tolerance: float = 1e-9) -> DataFrame:
    """``axis, partition, value, candidates``: the best on each axis among those that did not see it.

    An axis on which all partitions with this k agree tells nothing and is
    left out; the greatest name wins ties.
    """
    flat = None
    for column, _, _ in axes:
        part = table.where((F.col("k") == k) & F.col(column).isNotNull()).agg(F.count("*").alias("n"), (F.max(column) - F.min(column)).cast("double").alias("range")).select(F.lit(column).alias("axis"), ((F.col("n") > 1) & (F.col("range") < tolerance)).alias("flat"))
        flat = part if flat is None else flat.unionByName(part)
    pool = _unseen(table, axes, k, min_size).join(F.broadcast(flat.where(~F.col("flat"))), "axis")
    best = F.struct("score", "partition")
    return pool.groupBy("axis").agg(F.max_by("partition", best).alias("partition"), F.max_by("value", best).alias("value"), F.first("candidates").alias("candidates"))


def neutral_rank(table: DataFrame, axes: list[tuple[str, str, int]], k: int, min_size: int) -> DataFrame:
    """``partition, mean_rank, n_axes, place``: mean places on the axes that a candidate did not see.

    Places run from the best, the least name first among equals; the order is
    by mean rank, then by more axes, then by name.
    """
    placed = _unseen(table, axes, k, min_size).withColumn("p", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("score"), "partition")))
    mean = placed.groupBy("partition").agg(F.round(F.avg("p"), 3).alias("mean_rank"), F.count("*").alias("n_axes"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy("mean_rank", F.desc("n_axes"), "partition")))


def best_track_match(cells: DataFrame, base: str) -> DataFrame:
    """``track, n_cells, run, jaccard``: how well each track of the base run recurs in another.

    ``cells`` is run, track, id, t; Jaccard's index is that of the sets of
    cells, nought where no track of the other run meets it.
    """
    own = cells.where(F.col("run") == base).select("track", "id", "t")
    rest = cells.where(F.col("run") != base)
    sizes = own.groupBy("track").agg(F.count("*").alias("n_cells"))
    theirs = rest.groupBy("run", "track").agg(F.count("*").alias("m")).withColumnRenamed("track", "other")
    common = own.join(rest.select("run", F.col("track").alias("other"), "id", "t"), ["id", "t"]).groupBy("track", "run", "other").agg(F.count("*").alias("c"))
    scored = common.join(sizes, "track").join(theirs, ["run", "other"]).groupBy("track", "run").agg(F.max(F.col("c") / (F.col("n_cells") + F.col("m") - F.col("c"))).alias("jaccard"))
    every = sizes.crossJoin(F.broadcast(rest.select("run").distinct()))
    return every.join(scored, ["track", "run"], "left").fillna(0.0, ["jaccard"])


def transition_votes(changes: DataFrame) -> DataFrame:
    """``t, id, votes, ambiguous, unanimous`` over runs (run, t, id, changed, ambiguous).

    Only changes that are not ambiguous count as votes.
    """
    n = changes.select("run").distinct().agg(F.count("*").alias("runs"))
    votes = changes.groupBy("t", "id").agg(F.count(F.when(F.col("changed") & ~F.col("ambiguous"), 1)).alias("votes"), F.count(F.when(F.col("ambiguous"), 1)).alias("n_ambiguous"))
    return votes.crossJoin(F.broadcast(n)).select("t", "id", "votes", "n_ambiguous", (F.col("votes") == F.col("runs")).alias("unanimous"))


def mean_valid(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column its mean over the rows where it is finite, and how many these are."""
    kept = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    return rows.agg(F.count("*").alias("n_rows"), *[f for c in columns for f in (F.avg(kept(c)).alias(c), F.count(kept(c)).alias(f"{c}_valid"))])


def axis_decomposition(vectors: DataFrame, partition: DataFrame, direction: list[float]) -> DataFrame:
    """One row: total and between sums of squares, whole and along a direction, and their shares."""
    d = np.asarray(direction, float)
    unit = (d / np.linalg.norm(d)).tolist()
    rows = graph.whole_vectors(vectors).join(partition, "id")
    axis = F.aggregate(F.zip_with("vector", F.array(*[F.lit(x) for x in unit]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    long = rows.select("cluster", F.posexplode("vector").alias("dim", "x")).unionByName(rows.select("cluster", F.lit(-1).alias("dim"), axis.alias("x")))
    per = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    grand = per.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    sums = per.join(F.broadcast(grand), "dim").groupBy("dim").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum("w").alias("w"))
    whole, along = F.col("dim") >= 0, F.col("dim") == -1
    one = sums.agg(F.sum(F.when(whole, F.col("b") + F.col("w"))).alias("total_ss"), F.sum(F.when(along, F.col("b") + F.col("w"))).alias("axis_total_ss"), F.sum(F.when(whole, F.col("b"))).alias("between_ss"), F.sum(F.when(along, F.col("b"))).alias("axis_between_ss"))
    return one.select("*", F.try_divide("axis_total_ss", "total_ss").alias("axis_total_fraction"), F.try_divide("axis_between_ss", "between_ss").alias("axis_between_fraction"), F.try_divide("axis_between_ss", "axis_total_ss").alias("axis_eta_squared"))


def contrast_basis(direction: list[float]) -> np.ndarray:
    """A basis whose last coordinate would be the direction; that one is set to nought."""
    d = np.asarray(direction, float)
    unit = d / np.linalg.norm(d)
    away = unit - np.eye(len(d))[-1]
    size = float(away @ away)
    basis = np.eye(len(d)) if size < 1e-30 else np.eye(len(d)) - 2 * np.outer(away, away) / size
    basis[:, -1] = 0.0
    return basis


def mmd2(first: DataFrame, second: DataFrame, bandwidth: float) -> DataFrame:
    """One row ``mmd2``: the biased squared discrepancy of two samples (id, vector) by Gaussian kernels.

    Blocks of rows meet pairwise in NumPy and pass on one sum each.
    """
    import pandas as pd

    if not bandwidth > 0:
        raise ValueError("the bandwidth must be positive")
    tagged = graph.whole_vectors(first).withColumn("s", F.lit(0)).unionByName(graph.whole_vectors(second).withColumn("s", F.lit(1)))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["asks"]], part[~part["asks"]]
        if asks.empty or has.empty:
            return pd.DataFrame({"x": [], "y": [], "total": [], "n": []})
        a, b = np.stack(asks["vector"]), np.stack(has["vector"])
        square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
        k = np.exp(-square / (2 * bandwidth**2))
        out = []
        for x in (0, 1):
            for y in (0, 1):
                cut = k[np.ix_((asks["s"] == x).to_numpy(), (has["s"] == y).to_numpy())]
                out.append((x, y, float(cut.sum()), cut.size))
        return pd.DataFrame(out, columns=["x", "y", "total", "n"])

    met = graph._paired(tagged, tagged.count()).applyInPandas(kernel, "x int, y int, total double, n long")
    mean = lambda x, y: F.try_divide(F.sum(F.when((F.col("x") == x) & (F.col("y") == y), F.col("total"))), F.sum(F.when((F.col("x") == x) & (F.col("y") == y), F.col("n"))))
    return met.agg((mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)).alias("mmd2"))
