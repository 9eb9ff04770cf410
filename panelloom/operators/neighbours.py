"""Neighbour graphs from distances, similarities, places and series.

Directed pairs are ``src, dst`` and a number; undirected edges ``src, dst,
weight`` with ``src < dst``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import graph

EARTH_KM = 6371.0088
#: Parts that a region's rows are dealt into to meet the whole region.
REGION_PARTS = 16


def _undirected(pairs: DataFrame, weight: Column) -> DataFrame:
    """The larger weight of each pair's two directions, without edges of no weight."""
    ends = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight"))
    return ends.groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0")


def _first(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` partners of each ``src``, with their ``rank``."""
    if k < 1:
        raise ValueError("k must be positive")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order, F.col("dst")))
    return pairs.where("src <> dst").withColumn("rank", rank).where(F.col("rank") <= k)


def distance_knn(distances: DataFrame, k: int) -> DataFrame:
    """Edges of weight exp(-(d / s)^2 / 2) to the k nearest, s the median positive distance, or one.

    ``distances`` (src, dst, distance) has each direction on its own.  An
    infinite or null distance is no link; a negative one or NaN is an error.
    """
    d = F.col("distance")
    checked = distances.withColumn("distance", F.when(F.isnan(d) | (d < 0), F.raise_error(F.lit("distances must not be negative"))).otherwise(d))
    near = _first(checked.where(d.isNotNull() & (d < float("inf"))), k, d)
    scale = near.agg(F.coalesce(F.median(F.when(d > 0, d)), F.lit(1.0)).alias("s"))
    return _undirected(near.crossJoin(F.broadcast(scale)), F.exp(-F.pow(d / F.col("s"), 2) / 2))


def road_knn(distances: DataFrame, k: int) -> DataFrame:
    """:func:`distance_knn` of unordered pairs; no positive distance is an error."""
    some = distances.where(F.col("distance") > 0).where(F.col("distance") < float("inf"))
    if some.isEmpty():
        raise ValueError("no positive distance to set the scale")
    both = distances.select("src", "dst", "distance")
    return distance_knn(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")), k)


def similarity_knn(similarities: DataFrame, k: int) -> DataFrame:
    """Edges to the k most similar, as far as similarities (src, dst, similarity) are positive."""
    s = F.col("similarity")
    return _undirected(_first(similarities.where(s.isNotNull()), k, -s).where(s > 0), s)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors: DataFrame, zero: Column) -> DataFrame:
    """Vectors over their norms; those of no length become ``zero``."""
    base = graph.whole_vectors(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return base.withColumn("norm", norm).select("id", F.when(F.col("norm") > 1e-12, F.transform("vector", lambda x: x / F.col("norm"))).otherwise(zero).alias("vector"))


def most_similar(units: DataFrame, k: int) -> DataFrame:
    """``src, dst, similarity, rank``: the k greatest dot products, ties to the least id.

    Blocks of rows meet pairwise in NumPy; each pair keeps k partners a row.
    """
    base = graph.whole_vectors(units)

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["asks"]], part[~part["asks"]].sort_values("id")
        if asks.empty or has.empty:
            return pd.DataFrame({"src": [], "dst": [], "similarity": []})
        ids, mine = has["id"].to_numpy(), asks["id"].to_numpy()
        x, y, out = np.stack(asks["vector"]), np.stack(has["vector"]), []
        for at in graph.strips(x, y):
            s = x[at] @ y.T
            s[mine[at, None] == ids[None, :]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, [-k]] if k < len(ids) else np.full((len(s), 1), -np.inf)
            i, j = np.nonzero((s >= least) & np.isfinite(s))
            out.append(pd.DataFrame({"src": mine[at][i], "dst": ids[j], "similarity": s[i, j]}))
        found = pd.concat(out).sort_values(["src", "similarity", "dst"], ascending=[True, False, True])
        return found.groupby("src", sort=False).head(k)

    count = base.count()
    blocks = graph.wide_blocks(count)
    pairs = graph._paired(base, count, blocks, blocks).applyInPandas(nearest, "src long, dst long, similarity double")
    return _first(pairs, k, -F.col("similarity"))


def cosine_knn(vectors: DataFrame, k: int) -> DataFrame:
    """Edges to the k vectors of the greatest cosine; one of no length is an error."""
    refuse = F.raise_error(F.lit("a vector of no length has no direction")).cast("array<double>")
    return similarity_knn(most_similar(_unit(vectors, refuse), k), k)


def same_region(nodes: DataFrame) -> DataFrame:
    """All pairs within a region of ``nodes`` (id, region), of weight 1 / (n - 1).

    The graph is complete by its definition: a region of n makes n^2 / 2
    edges.  A null region has no edges.
    """
    sized = nodes.where("region is not null").withColumn("n", F.count("*").over(Window.partitionBy("region")))
    # few regions must not be few tasks: each one's rows are dealt into parts that meet all of it
    a = sized.select(F.col("id").alias("src"), "region", "n", F.pmod(F.xxhash64("id"), F.lit(REGION_PARTS)).alias("part"))
    b = sized.select(F.col("id").alias("dst"), "region", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(REGION_PARTS - 1).cast("long"))).alias("part"))
    return a.join(b.hint("merge"), ["region", "part"]).where("src < dst").select("src", "dst", (1 / (F.col("n") - 1)).alias("weight"))


def geometric(points: DataFrame, radius: float) -> DataFrame:
    """Edges of weight exp(-(d / r)^2) between ``points`` (id, x, y) within ``radius``.

    Points meet those of their own cell of a grid and, of each two cells that
    touch, those of one meet those of the other once.
    """
    cell = points.where("x is not null and y is not null").withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    a = cell.select(F.col("id").alias("p"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    b = cell.withColumn("step", steps).select(F.col("id").alias("q"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"), ((F.col("step.i") != 0) | (F.col("step.j") != 0)).alias("other"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    pairs = a.join(b.hint("merge"), ["cx", "cy"]).where("other or p < q").withColumn("d", d).where(F.col("d") <= radius)
    return pairs.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), F.exp(-F.pow(F.col("d") / radius, 2)).alias("weight"))


def geometric_radius(degree: float, n: int) -> float:
    """The radius at which n points of a unit square have ``degree`` neighbours in the mean."""
    return float(np.sqrt(degree / (np.pi * n)))


def great_circle(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Kilometres between two places in degrees, by haversines."""
    half = lambda x, y: F.pow(F.sin((F.radians(y) - F.radians(x)) / 2), 2)
    h = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def knn_within(vectors: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``src, dst, distance, rank``: the k nearest of one's own group (id, group).

    A row alone in its group has no neighbour and no row here.  Groups of many
    rows are dealt into blocks that meet pairwise.
    """
    base = graph._light(graph.whole_vectors(vectors), vectors).join(groups.select("id", F.col("group").cast("string").alias("group")), "id")
    sizes = base.groupBy("group").agg(F.count("*").alias("size"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total"))))
    pairs = graph.nearest_within(base, k, sizes)
    return _first(pairs, k, F.col("distance"))


def consensus_peers(annual: DataFrame, monthly: DataFrame, k: int, candidates: int) -> DataFrame:
    """``src, dst, frequency, rank``: of the nearest by year, those most often nearest by month.

    ``annual`` is id, vector; ``monthly`` has a ``period`` too.  A year's
    ``candidates`` are ranked by the number of months in which they are among
    the k nearest, then by distance; ``frequency`` is the share of months.
    """
    if not 1 <= k <= candidates:
        raise ValueError("k must not exceed the candidates")
    pool = graph.knn(annual, candidates).select("src", "dst", "distance", F.col("rank").alias("place"))
    periods = monthly.select("period").distinct().count()
    # ids of one month meet only each other: the month is the group, an id there is (month, id)
    keyed = monthly.select(F.col("id").alias("entity"), "period", "vector")
    numbered = keyed.withColumn("id", F.xxhash64("period", "entity"))
    near = knn_within(numbered.select("id", "vector"), numbered.select("id", F.col("period").cast("string").alias("group")), k)
    names = numbered.select("id", "entity")
    votes = near.join(names.select(F.col("id").alias("src"), F.col("entity").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("entity").alias("d")), "dst")
    votes = votes.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.count("*").alias("votes"))
    ranked = pool.join(votes, ["src", "dst"], "left").fillna(0, ["votes"])
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("votes"), "distance", "place"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", (F.col("votes") / F.lit(float(periods))).alias("frequency"), "rank")


def peer_concordance(neighbours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``id, peer_reference, discrepancy``: the median outcome (id, y) of one's neighbours.

    Only what the neighbours were chosen by may be past; outcomes are looked at
    afterwards.
    """
    told = neighbours.join(outcomes.select(F.col("id").alias("dst"), F.col("y").alias("peer")), "dst").groupBy(F.col("src").alias("id")).agg(F.median("peer").alias("peer_reference"))
    return told.join(outcomes.select("id", "y"), "id").select("id", "peer_reference", F.abs(F.col("peer_reference") - F.col("y")).alias("discrepancy"))


def central_members(vectors: DataFrame, partition: DataFrame, count: int) -> DataFrame:
    """``cluster, rank, id, distance``: the members of least mean distance to their cluster, themselves included."""
    own = graph.distance_sums(vectors, partition).where("own = other").select(F.col("own").alias("cluster"), "id", (F.col("total") / F.col("n")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("distance", 12), "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= count)


def analogues(neighbours: DataFrame, traits: DataFrame, factors: tuple[float, ...] = (1.1, 1.25, 1.5, 2.0)) -> DataFrame:
    """``src, factor, n_eligible, first``: neighbours of the same type whose level is within a factor.

    ``traits`` is id, type, level; bounds are inclusive; ``first`` is the
    nearest eligible one, null if none is.
    """
    a = traits.select(F.col("id").alias("src"), F.col("type").alias("ta"), F.col("level").alias("la"))
    b = traits.select(F.col("id").alias("dst"), F.col("type").alias("tb"), F.col("level").alias("lb"))
    pairs = neighbours.join(a, "src").join(b, "dst").withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    fits = eligible(F.col("ta"), F.col("tb"), F.col("la"), F.col("lb"), F.col("factor"))
    return pairs.groupBy("src", "factor").agg(F.count(F.when(fits, 1)).alias("n_eligible"), F.min_by("dst", F.when(fits, F.col("rank"))).alias("first"))


def eligible(type_a: Column, type_b: Column, level_a: Column, level_b: Column, factor: Column) -> Column:
    """Whether two are of one type and their levels within a factor of each other, bounds included."""
    ratio = F.try_divide(level_a, level_b)
    return (type_a == type_b) & (ratio >= 1 / factor) & (ratio <= factor)


# --- layers -------------------------------------------------------------------


def _positive_total(edges: DataFrame) -> DataFrame:
    total = edges.agg(F.sum("weight").alias("w"))
    return total.select(F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.lit("an empty layer cannot be scaled")).cast("double")).alias("w"))


def unit_mean_strength(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Weights scaled so that the mean strength of the nodes is one."""
    return edges.where("weight > 0").crossJoin(F.broadcast(_positive_total(edges))).select("src", "dst", (F.col("weight") * F.lit(float(n_nodes)) / (2 * F.col("w"))).alias("weight"))


def unit_total(edges: DataFrame) -> DataFrame:
    """Weights scaled so that both directions together sum to one."""
    return edges.where("weight > 0").crossJoin(F.broadcast(_positive_total(edges))).select("src", "dst", (F.col("weight") / (2 * F.col("w"))).alias("weight"))


def mix_layers(a: DataFrame, b: DataFrame, alpha: float, n_nodes: int | None = None) -> DataFrame:
    """``alpha`` times one scaled layer and the rest of the other, without edges of no weight.

    Scaled to unit mean strength over ``n_nodes``, or to unit total if it is None.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between nought and one")
    scale = unit_total if n_nodes is None else lambda e: unit_mean_strength(e, n_nodes)
    part = lambda e, x: scale(e).select("src", "dst", (F.lit(float(x)) * F.col("weight")).alias("weight"))
    return part(a, alpha).unionByName(part(b, 1 - alpha)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")


def permute_within(edges: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """The graph with its nodes (id, group) exchanged within their groups, by a hash of id and seed."""
    natural = F.row_number().over(Window.partitionBy("group").orderBy("id"))
    dealt = F.row_number().over(Window.partitionBy("group").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), "id"))
    ranked = nodes.select("id", "group", natural.alias("a"), dealt.alias("b"))
    moved = ranked.select("id", "group", F.col("a").alias("place")).join(ranked.select(F.col("id").alias("to"), "group", F.col("b").alias("place")), ["group", "place"]).select("id", "to")
    for end in ("src", "dst"):
        edges = edges.join(moved.select(F.col("id").alias(end), F.col("to").alias(f"new_{end}")), end)
    return edges.select(F.least("new_src", "new_dst").alias("src"), F.greatest("new_src", "new_dst").alias("dst"), "weight")


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """Weights over the root of both ends' strengths; nodes without edges have no rows."""
    strength = graph.mirrored(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("s"))
    for end in ("src", "dst"):
        edges = edges.join(strength.select(F.col("node").alias(end), F.col("s").alias(f"s_{end}")), end)
    return edges.select("src", "dst", F.try_divide("weight", F.sqrt(F.col("s_src") * F.col("s_dst"))).alias("weight"))


# --- series --------------------------------------------------------------------


def series_vectors(table: DataFrame) -> DataFrame:
    """``id, vector`` of whole series (key, t, c, v): values by t, then c.

    Keys that lack a cell of the calendar are left out.
    """
    full = table.agg(F.count_distinct("t", "c").alias("n"))
    whole = table.where("v is not null").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "c", "v"))).alias("cells"))
    return whole.crossJoin(F.broadcast(full)).where(F.size("cells") == F.col("n")).select(F.col("key").alias("id"), F.transform("cells", lambda x: x["v"].cast("double")).alias("vector"))


def trajectory_knn(table: DataFrame, k: int) -> DataFrame:
    """Edges by the cosine of residual trajectories (key, t, c, v).

    A residual is the value less the median over keys, less its own mean over
    time; a trajectory of no length has no edges.
    """
    median = table.groupBy("t", "c").agg(F.median("v").alias("med"))
    gaps = table.join(median, ["t", "c"]).withColumn("g", F.col("v") - F.col("med"))
    centred = gaps.withColumn("v", F.col("g") - F.avg("g").over(Window.partitionBy("key", "c"))).select("key", "t", "c", "v")
    units = _unit(series_vectors(centred), F.lit(None).cast("array<double>"))
    near = most_similar(units.where("vector is not null"), k)
    return similarity_knn(near.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity")))), k)


def _pairs_of_series(vectors: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the matrices of each pair of blocks of series."""

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["asks"]], part[~part["asks"]]
        if asks.empty or has.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return run(asks["id"].to_numpy(), np.stack(asks["vector"]), has["id"].to_numpy(), np.stack(has["vector"]))

    return graph._paired(vectors, vectors.count()).applyInPandas(meet, schema)


def lagged_correlation(table: DataFrame, n_series: int, max_lag: int = 3) -> DataFrame:
    """``a, b, lag, corr`` (a < b): over series (key, t, c, v), the best mean correlation of two keys.

    A positive lag means that ``a`` leads.  Each lag's overlap has means and
    deviations of its own; a constant series counts as nought.  The smaller lag
    wins ties, then the positive one.
    """

    def run(ids, x, others, y):
        x, y = x.reshape(len(x), -1, n_series), y.reshape(len(y), -1, n_series)
        steps = x.shape[1]
        if not 0 <= max_lag < steps - 2:
            raise ValueError("the lag is too long for the series")

        def scaled(s):
            s = s - s.mean(axis=1, keepdims=True)
            sd = s.std(axis=1, keepdims=True)
            return np.where(sd > 1e-12, s / np.where(sd > 1e-12, sd, 1.0), 0.0)

        best, lag = np.full((len(x), len(y)), -np.inf), np.zeros((len(x), len(y)), int)
        for shift in range(max_lag + 1):
            n = steps - shift
            for sign in (1, -1):
                a, b = (x[:, :n], y[:, shift:]) if sign == 1 else (x[:, shift:], y[:, :n])
                value = np.round(np.einsum("itc,jtc->ij", scaled(a), scaled(b)) / n / n_series, 12)
                better = value > best
                best[better], lag[better] = value[better], sign * shift
        i, j = np.nonzero(ids[:, None] < others[None, :])
        return pd.DataFrame({"a": ids[i], "b": others[j], "lag": lag[i, j], "corr": best[i, j]})

    return _pairs_of_series(series_vectors(table), run, "a long, b long, lag int, corr double")


def dtw(table: DataFrame, n_series: int, window: int = 2) -> DataFrame:
    """``a, b, distance`` (a < b): time warping of series (key, t, c, v) within a band.

    The local cost is the squared Euclidean distance, the result the root of
    the least sum of costs.
    """
    if window < 0:
        raise ValueError("the window must not be negative")

    def run(ids, x, others, y):
        x, y = x.reshape(len(x), -1, n_series), y.reshape(len(y), -1, n_series)
        steps = x.shape[1]
        cost = np.full((2, steps + 1, len(x), len(y)), np.inf)
        cost[0, 0] = 0.0
        for p in range(1, steps + 1):
            now, before = cost[p % 2], cost[(p - 1) % 2]
            now[:] = np.inf
            for q in range(max(1, p - window), min(steps, p + window) + 1):
                local = ((x[:, None, p - 1] - y[None, :, q - 1]) ** 2).sum(2)
                now[q] = local + np.minimum(np.minimum(before[q], now[q - 1]), before[q - 1])
        i, j = np.nonzero(ids[:, None] < others[None, :])
        return pd.DataFrame({"a": ids[i], "b": others[j], "distance": np.sqrt(cost[steps % 2, steps][i, j])})

    return _pairs_of_series(series_vectors(table), run, "a long, b long, distance double")


def both_ways(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """Pairs ``a, b`` (a < b) as directed ``src, dst`` with ``value`` under ``name``."""
    one = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(value).alias(name))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), name))


def compare_rules(rules: dict[str, DataFrame]) -> DataFrame:
    """``a, b, n_a, n_b, jaccard`` of the edges of each pair of named graphs."""
    tagged = None
    for name, edges in rules.items():
        part = edges.select("src", "dst", F.lit(name).alias("rule"))
        tagged = part if tagged is None else tagged.unionByName(part)
    sizes = tagged.groupBy("rule").agg(F.count("*").alias("n"))
    common = tagged.alias("x").join(tagged.alias("y"), ["src", "dst"]).where("x.rule < y.rule").groupBy(F.col("x.rule").alias("a"), F.col("y.rule").alias("b")).agg(F.count("*").alias("both"))
    every = sizes.select(F.col("rule").alias("a"), F.col("n").alias("n_a")).join(sizes.select(F.col("rule").alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))
    out = every.join(common, ["a", "b"], "left").fillna(0, ["both"])
    return out.select("a", "b", "n_a", "n_b", F.try_divide(F.col("both"), F.col("n_a") + F.col("n_b") - F.col("both")).alias("jaccard"))
