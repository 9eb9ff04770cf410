"""Nearest-neighbour graphs and indices of partitions of their nodes.

Undirected edges are ``src, dst, weight`` with ``src < dst``; vectors are
``id, vector``; a partition is ``id, cluster``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.components import connected_components

BLOCK_ROWS = 4096
#: Rows of a block whose pairs are looked at a strip at a time, and numbers of such a strip.
WIDE_ROWS, STRIP = 65_536, 2_000_000
#: Blocks that tables are cut into as long as blocks are not too wide for it: a row is sent so often.
BLOCKS = 12
#: Blocks that ask for neighbours and that are asked, of a table of more than ``BLOCK_ROWS`` rows, and their rows at most.
ASKING, ASKED, MOST_ROWS = 8, 4, 131_072
#: Partitions that pairs of such blocks are dealt into.
PARTS = 128
#: Rows that ask at once, rows that they meet at once, and how many of these have their least number kept.
ASKS, TILE, LANES = 256, 8192, 16


def wide_blocks(count: int) -> int:
    """How many blocks of rows meet: the same number for all but small and very large tables."""
    return max(1, min(BLOCKS, -(-count // BLOCK_ROWS)), -(-count // WIDE_ROWS))


def _paired(rows: DataFrame, count: int, asking: int | None = None, asked: int | None = None):
    """``rows`` grouped by pairs of blocks, of which there may be given numbers: those that ask and those that are asked."""
    blocks = max(1, -(-count // BLOCK_ROWS))
    asking, asked = asking or blocks, asked or blocks
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("asks", F.lit(True)).withColumn("a", block(asking)).withColumn("b", every(asked))
    right = rows.withColumn("asks", F.lit(False)).withColumn("b", block(asked)).withColumn("a", every(asking))
    return left.unionByName(right).groupBy("a", "b")


def strips(x: np.ndarray, y: np.ndarray) -> list[slice]:
    """Stretches of the rows of ``x`` whose pairs with all of ``y`` are not too many at once."""
    step = max(1, STRIP // max(1, len(y)))
    return [slice(i, i + step) for i in range(0, len(x), step)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all pairs by one product; those so small that it would cancel from differences."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)
    squares = size - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= 1e-3 * size)
    step = max(1, STRIP // x.shape[1])
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        squares[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(squares, out=squares)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``id, vector`` in doubles of the rows that have an id and no missing coordinate."""
    x = F.col("vector").cast("array<double>")
    return vectors.where(F.col("id").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))).select("id", x.alias("vector"))


def _plain_nearest(y: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_nearest_in`, by one product in double precision: for tables that single precision cannot tell apart."""
    rough = (y * y).sum(1) - 2 * (x @ y.T)
    size = (x * x).sum(1)
    slack = 1e-9 * (size + np.abs(rough).max(initial=0.0)) + 1e-12
    near = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None] if k < len(y) else np.ones(rough.shape, bool)
    i, j = np.nonzero(near)
    return i, j, _between(y, x, j, i)


def _between(y: np.ndarray, x: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, from differences, so that they do not suffer from cancellation."""
    out = np.empty(len(i))
    step = max(1, STRIP // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((y[j[at : at + step]] - x[i[at : at + step]]) ** 2).sum(1))
    return out


class Asked:
    """Rows whose nearest are asked for: shifted to their middle, at most one long, in single precision.

    A product in single precision errs by no more than a known bound.  Of
    every ``LANES`` of its numbers only the least is kept; the k-th of these
    and twice the bound tell which lanes can hold one of the k nearest, and
    only these rows are taken again, from differences in double precision.
    """

    def __init__(self, y: np.ndarray) -> None:
        self.y = y
        with np.errstate(invalid="ignore", over="ignore"):
            self.middle = y.mean(0)
            low = y - self.middle
            self.scale = float(np.sqrt((low * low).sum(1).max())) or 1.0
            low /= self.scale
        self.tile = min(TILE, LANES * -(-len(y) // LANES))
        self.low = np.zeros((self.tile * -(-len(y) // self.tile), y.shape[1] + 1), np.float32)
        self.low[: len(y), :-1] = low
        self.low[: len(y), -1] = (low * low).sum(1) / 2
        self.low[len(y) :, -1] = 1e30

    def nearest(self, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``x`` and of those asked, and distances, a stretch of ``x`` at a time: at least the k nearest of each."""
        if k * LANES >= len(self.y) or not np.isfinite(self.scale):
            for at in strips(x, self.y):
                i, j, d = _plain_nearest(self.y, x[at], k)
                yield i + at.start, j, d
            return
        for at in range(0, len(x), ASKS):
            found = self._near(x[at : at + ASKS], k)
            if found is not None:
                yield found[0] + at, *found[1:]
                continue
            for part in strips(x[at : at + ASKS], self.y):
                i, j, d = _plain_nearest(self.y, x[at : at + ASKS][part], k)
                yield i + at + part.start, j, d

    def _near(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The same of one stretch; none if too many rows are within the bound."""
        own = (x - self.middle) / self.scale
        size = (own * own).sum(1)
        if not size.max() < 1e12:
            return None
        error = 1.2e-7 * (x.shape[1] + 8) * (np.sqrt(size) + 1)
        asks = np.concatenate([-own, np.ones((len(own), 1))], axis=1).astype(np.float32)
        wide = self.tile // LANES
        least = np.empty((len(x), len(self.low) // LANES), np.float32)
        for n, t in enumerate(range(0, len(self.low), self.tile)):
            rough = asks @ self.low[t : t + self.tile].T
            rough.reshape(len(x), LANES, wide).min(axis=1, out=least[:, n * wide : (n + 1) * wide])
        reach = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float) + 2 * error
        i, lane = np.nonzero(least <= reach[:, None])
        if len(i) > len(x) * (4 * k + 64):
            return None
        first = lane // wide * self.tile + lane % wide
        i, j = np.repeat(i, LANES), (first[:, None] + wide * np.arange(LANES)).ravel()
        i, j = i[j < len(self.y)], j[j < len(self.y)]
        d = _between(self.y, x, j, i)
        near = (d / self.scale) ** 2 <= (2 * (reach + error) + size * (1 + 1e-9) + 1e-9)[i]
        return i[near], j[near], d[near]


def _nearest_in(y: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` and distances: at least the k nearest ``y`` of each ``x``."""
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(v) for v in zip((none, none, np.empty(0)), *Asked(y).nearest(x, k), strict=True))


def _best(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """``src, dst, distance``: the k nearest others, of those that are asked, of each row that asks."""
    asks, has = part[part["asks"]], part[~part["asks"]].sort_values("id")
    if asks.empty or has.empty:
        return pd.DataFrame({"src": [], "dst": [], "distance": []})
    x, y = np.stack(asks["vector"]).astype(float), np.stack(has["vector"]).astype(float)
    names, theirs = asks["id"].to_numpy(), has["id"].to_numpy()
    found = []
    for i, j, d in Asked(y).nearest(x, k + 1):  # one may be the row itself
        others = names[i] != theirs[j]
        i, j, d = i[others], j[others], d[others]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((names[i[rank < k]], theirs[j[rank < k]], d[rank < k]))
    src, dst, d = (np.concatenate(v) for v in zip(*found, strict=True))
    return pd.DataFrame({"src": src, "dst": dst, "distance": d})


def _light(base: DataFrame, vectors: DataFrame) -> DataFrame:
    """``base`` with its vectors in the precision that ``vectors`` have, which loses nothing and is half as long."""
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    return base.withColumn("vector", F.col("vector").cast("array<float>")) if kind == "float" else base


def dealt_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows ``id, vector, group``, once for each pair ``a, b`` of blocks of their group that they take part in, ``asks`` telling on which side.

    ``sizes`` has the ``size`` of every group, or of the only one, and the
    ``total`` of all.  How often a row is sent depends on its group's share of
    the table and not on the number of rows, up to ``MOST_ROWS`` a block.
    """
    share = F.sqrt(F.col("size") / F.col("total"))
    cut = lambda most: F.greatest(F.when(F.col("total") > BLOCK_ROWS, F.ceil(most * share - 1e-9)).otherwise(1), F.ceil(F.col("size") / MOST_ROWS)).cast("int")
    placed = rows.join(sizes, "group") if "group" in sizes.columns else rows.crossJoin(F.broadcast(sizes))
    placed = placed.withColumn("asking", cut(ASKING)).withColumn("asked", cut(ASKED))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.select("id", "vector", "group", F.lit(True).alias("asks"), block("asking").alias("a"), every("asked").alias("b"))
    right = placed.select("id", "vector", "group", F.lit(False).alias("asks"), every("asking").alias("a"), block("asked").alias("b"))
    return left.unionByName(right)


def nearest_within(rows: DataFrame, k: int, sizes: DataFrame) -> DataFrame:
    """``src, dst, distance``, with some beyond the k nearest of one's ``group``; see :func:`dealt_blocks`."""
    # a task takes long over few bytes: tasks are not put together by size
    dealt = dealt_blocks(rows, sizes).repartition(PARTS, "group", "a", "b")
    return dealt.groupBy("group", "a", "b").applyInPandas(lambda part: _best(part, k), "src long, dst long, distance double")


def knn(vectors: DataFrame, k: int, n_rows: int | None = None) -> DataFrame:
    """``src, dst, distance, rank``: the exact k nearest by Euclid, ties to the least id.

    Rows without an id or with a missing coordinate are left out; ids are
    distinct, and ``k`` must be less than their number.  Blocks of rows meet
    pairwise in NumPy, each pair keeps k partners of a row, and a window takes
    the k best of all blocks.
    """
    base = whole_vectors(vectors)
    count = base.count() if n_rows is None else n_rows
    if not 0 < k < count:
        raise ValueError("k must be positive and less than the number of rows")
    rows = _light(base, vectors).withColumn("group", F.lit(""))
    pairs = nearest_within(rows, k, vectors.sparkSession.range(1).select(F.lit(count).alias("size"), F.lit(count).alias("total")))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def gaussian(neighbours: DataFrame, symmetry: str = "union") -> DataFrame:
    """Edges of weight exp(-(d / s)^2 / 2), s the median positive distance.

    ``union`` keeps an edge that either end chose, ``mutual`` one that both did.
    """
    scale = neighbours.agg(F.coalesce(F.median(F.when(F.col("distance") > 0, F.col("distance"))), F.lit(1.0)).alias("s"))
    weighed = neighbours.join(F.broadcast(scale)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.exp(-F.pow(F.col("distance") / F.col("s"), 2) / 2).alias("weight"))
    edges = weighed.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    return (edges.where("n = 2") if symmetry == "mutual" else edges).select("src", "dst", "weight")


def local_scale(neighbours: DataFrame, scale_rank: int = 7) -> DataFrame:
    """Union edges of weight exp(-d^2 / (s_i s_j)), s the distance to one neighbour."""
    scale = neighbours.where(F.col("rank") == scale_rank)
    a, b = scale.select("src", F.col("distance").alias("sa")), scale.select(F.col("src").alias("dst"), F.col("distance").alias("sb"))
    weighed = neighbours.join(a, "src").join(b, "dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.exp(-F.col("distance") * F.col("distance") / (F.col("sa") * F.col("sb"))).alias("weight"))
    return weighed.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row over ``nodes`` (id): edges, components, isolates, mean degree, median strength.

    Edges of no weight do not count.  Ends that are not among the nodes are
    not looked for; the median is over all nodes, isolates having none.
    """
    live = edges.where("weight > 0")
    per = nodes.select("id").distinct().join(mirrored(live).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"), F.sum("weight").alias("s")), "id", "left").fillna(0, ["d", "s"])
    inner = connected_components(live.select(F.col("src").alias("a"), F.col("dst").alias("b"))).agg(F.count_distinct("root").alias("inner"))
    totals = per.agg((F.sum("d") / 2).cast("long").alias("n_edges"), F.count(F.when(F.col("d") == 0, 1)).alias("n_isolates"), F.avg("d").alias("mean_degree"), F.median("s").alias("median_strength"))
    return totals.crossJoin(F.broadcast(inner)).select("n_edges", (F.col("inner") + F.col("n_isolates")).alias("n_components"), "n_isolates", "mean_degree", "median_strength")


def triangles(edges: DataFrame) -> DataFrame:
    """One row: how many triangles.  Wedges start at the end of lesser degree,
    so that a hub does not square."""
    degree = mirrored(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    rank = lambda end: degree.select(F.col("node").alias(end), F.struct("d", "node").alias(f"r_{end}"))
    ranked = edges.select("src", "dst").join(rank("src"), "src").join(rank("dst"), "dst")
    up = ranked.select(F.least("r_src", "r_dst").alias("low"), F.greatest("r_src", "r_dst").alias("high"))
    wedge = up.alias("x").join(up.alias("y"), (F.col("x.low") == F.col("y.low")) & (F.col("x.high") < F.col("y.high"))).select(F.col("x.high").alias("low"), F.col("y.high").alias("high"))
    return wedge.join(up, ["low", "high"]).agg(F.count("*").alias("n_triangles"))


def structure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row over ``nodes`` (id and any groupings): degree, triangles and shares within groups.

    ``within_x`` is the share of edges that join members of one group of
    column ``x``, null without edges; transitivity is null without triples.
    """
    degree = mirrored(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    groupings = [c for c in nodes.columns if c != "id"]
    totals = nodes.select("id").join(degree, "id", "left").fillna(0, ["d"]).agg(F.count("*").alias("n_nodes"), F.avg("d").alias("mean_degree"), F.sum(F.expr("d * (d - 1) / 2")).alias("triples"), (F.sum("d") / 2).cast("long").alias("n_edges"), F.count(F.when(F.col("d") == 0, 1)).alias("n_isolates"))
    ends = edges.select("src", "dst")
    for end in ("src", "dst"):
        ends = ends.join(nodes.select(F.col("id").alias(end), *[F.col(g).alias(f"{end}_{g}") for g in groupings]), end)
    same = ends.agg(F.count("*").alias("joined"), *[F.avg((F.col(f"src_{g}") == F.col(f"dst_{g}")).cast("double")).alias(f"within_{g}") for g in groupings]).drop("joined")
    inner = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).agg(F.count_distinct("root").alias("inner"))
    one = totals.crossJoin(F.broadcast(triangles(edges))).crossJoin(F.broadcast(same)).crossJoin(F.broadcast(inner)) if groupings else totals.crossJoin(F.broadcast(triangles(edges))).crossJoin(F.broadcast(inner))
    return one.select("n_nodes", "n_edges", (F.col("inner") + F.col("n_isolates")).alias("n_components"), "n_isolates", "mean_degree", "n_triangles", F.try_divide(3 * F.col("n_triangles"), "triples").alias("transitivity"), *[f"within_{g}" for g in groupings])


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("src", "dst", F.lit(1).alias("a")).join(b.select("src", "dst", F.lit(1).alias("b")), ["src", "dst"], "full")
    return both.agg(F.try_divide(F.count(F.col("a") + F.col("b")), F.count("*")).alias("jaccard"))


def block_sums(edges: DataFrame, partition: DataFrame, binary: bool = True) -> DataFrame:
    """``ci, cj, b``: weight between clusters, inside counted twice; edges of no weight do not count."""
    live = mirrored(edges.where("weight > 0")) if "weight" in edges.columns else mirrored(edges.withColumn("weight", F.lit(1.0)))
    ends = live.join(partition.select(F.col("id").alias("src"), F.col("cluster").alias("ci")), "src").join(partition.select(F.col("id").alias("dst"), F.col("cluster").alias("cj")), "dst")
    return ends.groupBy("ci", "cj").agg((F.count("*").cast("double") if binary else F.sum("weight")).alias("b"))


def _per_cluster(blocks: DataFrame, partition: DataFrame) -> DataFrame:
    """``ci, inside, s`` of every cluster of the partition, those without edges too."""
    inside = F.sum(F.when(F.col("ci") == F.col("cj"), F.col("b")).otherwise(0.0))
    sums = blocks.groupBy("ci").agg(inside.alias("inside"), F.sum("b").alias("s"))
    return partition.select(F.col("cluster").alias("ci")).distinct().join(sums, "ci", "left").fillna(0.0, ["inside", "s"])


def network_indices(blocks: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: k, AVI, Newman's Q and TurboMQ of :func:`block_sums` of a partition.

    With fewer than two clusters all are null.  A cluster without edges makes
    AVI null (``avi_undefined`` counts such) and adds nothing to TurboMQ; Q is
    null without any edge.
    """
    per = _per_cluster(blocks, partition)
    total = per.agg(F.sum("s").alias("m2"))
    some = F.count("*") > 1
    undefined = F.count(F.when(F.col("s") == 0, 1))
    return per.join(F.broadcast(total)).agg(
        F.count("*").alias("k"),
        F.when(some & (undefined == 0), F.avg(F.try_divide("inside", "s"))).alias("avi"),
        undefined.alias("avi_undefined"),
        F.when(some, F.sum(F.try_divide("inside", "m2") - F.pow(F.try_divide("s", "m2"), 2))).alias("newman_q"),
        F.when(some, F.sum(F.coalesce(F.try_divide("inside", "s"), F.lit(0.0)))).alias("turbo_mq"),
    )


def avu(blocks: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: the sum over ordered pairs of B_ij / (out_i + out_j - B_ij), over k.

    Null if any term has no positive denominator, which ``undefined_pairs``
    counts, and for fewer than two clusters.  Pairs of clusters without edges
    between them add nothing and are not made: among the k clusters only those
    that no edge leaves can have an undefined pair.
    """
    outs = _per_cluster(blocks, partition).select("ci", (F.col("s") - F.col("inside")).alias("o"))
    cross = blocks.where("ci <> cj").join(outs, "ci").join(outs.select(F.col("ci").alias("cj"), F.col("o").alias("oj")), "cj")
    terms = cross.agg(F.coalesce(F.sum(F.try_divide(F.col("b"), F.col("o") + F.col("oj") - F.col("b"))), F.lit(0.0)).alias("terms"), F.count(F.when(F.col("o") + F.col("oj") - F.col("b") <= 0, 1)).alias("zero_linked"))
    closed = outs.agg(F.count("*").alias("k"), F.count(F.when(F.col("o") == 0, 1)).alias("shut"))
    one = closed.crossJoin(F.broadcast(terms)).withColumn("undefined_pairs", F.col("shut") * (F.col("shut") - 1) + F.col("zero_linked"))
    return one.select(F.when((F.col("k") > 1) & (F.col("undefined_pairs") == 0), F.col("terms") / F.col("k")).alias("avu"), "undefined_pairs")


def calinski_harabasz(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: CH and CH/N, NULL where the inside sum of squares is nought."""
    long = vectors.join(partition, "id").select("id", "cluster", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x"))
    per = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("within"))
    grand = long.groupBy("dim").agg(F.avg("x").alias("grand"))
    sums = per.join(grand, "dim").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum("within").alias("ssw"),
        F.count_distinct("cluster").alias("k"),
        F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"),
    )
    ch = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return sums.select(ch.alias("ch"), (ch / F.col("n")).alias("ch_over_n"))


def distance_sums(vectors: DataFrame, partition: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``id, own, other, total, n``: the sum of each row's distances to each cluster's ``n`` members.

    Blocks meet pairwise in NumPy and pass on sums by cluster, not distances.
    """
    base = whole_vectors(vectors).join(partition.select("id", F.col("cluster").cast("long").alias("cluster")), "id")

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["asks"]], part[~part["asks"]]
        if asks.empty or has.empty:
            return pd.DataFrame({"id": [], "own": [], "other": [], "total": [], "n": []})
        x, y = np.stack(asks["vector"]), np.stack(has["vector"])
        names, place = np.unique(has["cluster"].to_numpy(), return_inverse=True)
        n = np.bincount(place)
        k = len(names)
        member = np.zeros((len(y), k))
        member[np.arange(len(y)), place] = 1.0
        totals = [distances(x[at], y) @ member for at in strips(x, y)]
        return pd.DataFrame({"id": np.repeat(asks["id"].to_numpy(), k), "own": np.repeat(asks["cluster"].to_numpy(), k), "other": np.tile(names, len(x)), "total": np.concatenate(totals).ravel(), "n": np.tile(n, len(x))})

    count = base.count() if n_rows is None else n_rows
    met = _paired(base, count, wide_blocks(count), wide_blocks(count)).applyInPandas(sums, "id long, own long, other long, total double, n long")
    return met.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette(vectors: DataFrame, partition: DataFrame, n_rows: int | None = None) -> DataFrame:
    """One row: the mean exact Euclidean silhouette and the share below nought.

    A singleton cluster and a zero denominator give 0; one cluster gives NULL.
    """
    whole = distance_sums(vectors, partition, n_rows)
    inside = F.col("own") == F.col("other")
    near = whole.groupBy("id").agg(F.max(F.when(inside & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"))
    larger = F.greatest("a", "b")
    sample = F.when(F.col("b").isNotNull(), F.when(F.col("a").isNull() | (larger == 0), 0.0).otherwise((F.col("b") - F.col("a")) / larger))
    return near.select(sample.alias("s")).agg(F.avg("s").alias("silhouette"), F.avg((F.col("s") < 0).cast("double")).alias("negative_share"))


def cluster_events(before: DataFrame, after: DataFrame, threshold: float = 0.3, size_change: float = 0.1) -> DataFrame:
    """``event, sources, targets, size_before, size_after, jaccard`` of two partitions.

    ``before`` and ``after`` have ``id, cluster``, each id once.  Groups are
    linked if Jaccard's index reaches ``threshold``.  A lone link grows or
    shrinks by more than ``size_change``, or continues; several links of one
    group are a split or a merge, none a death or a birth.  Cluster numbers
    are sorted and comma-joined.
    """
    old, new = before.select("id", F.col("cluster").alias("i")), after.select("id", F.col("cluster").alias("j"))
    olds, news = old.groupBy("i").agg(F.count("*").alias("nb")), new.groupBy("j").agg(F.count("*").alias("na"))
    common = old.join(new, "id").groupBy("i", "j").agg(F.count("*").alias("c"))
    linked = common.join(olds, "i").join(news, "j").withColumn("jaccard", F.col("c") / (F.col("nb") + F.col("na") - F.col("c"))).where(F.col("jaccard") >= threshold)
    degrees = {"outward": F.count("*").over(Window.partitionBy("i")), "inward": F.count("*").over(Window.partitionBy("j"))}
    linked = linked.withColumns(degrees)
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)).cast("array<string>"), ",")
    columns = ["event", "sources", "targets", "size_before", "size_after", "jaccard"]
    none = F.lit(None).cast("double").alias("jaccard")

    out = olds.join(linked.select("i", "j", "na"), "i", "left").groupBy("i", "nb").agg(F.count("j").alias("links"), listed("j").alias("targets"), F.coalesce(F.sum("na"), F.lit(0)).alias("size_after"))
    out = out.where("links <> 1").select(F.when(F.col("links") == 0, "death").otherwise("split").alias("event"), F.col("i").cast("string").alias("sources"), "targets", F.col("nb").alias("size_before"), "size_after", none)
    into = news.join(linked.select("i", "j", "nb"), "j", "left").groupBy("j", "na").agg(F.count("i").alias("links"), listed("i").alias("sources"), F.coalesce(F.sum("nb"), F.lit(0)).alias("size_before"))
    into = into.where("links <> 1").select(F.when(F.col("links") == 0, "birth").otherwise("merge").alias("event"), "sources", F.col("j").cast("string").alias("targets"), "size_before", F.col("na").alias("size_after"), none)
    ratio = F.col("na") / F.col("nb")
    kind = F.when(ratio > 1 + size_change, "grow").when(ratio < 1 - size_change, "shrink").otherwise("continue")
    lone = linked.where("outward = 1 and inward = 1").select(kind.alias("event"), F.col("i").cast("string").alias("sources"), F.col("j").cast("string").alias("targets"), F.col("nb").alias("size_before"), F.col("na").alias("size_after"), "jaccard")
    return out.unionByName(into).unionByName(lone).select(*columns)


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n`` with the shares of the origin and of the destination."""
    n = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumns({"share_from": F.col("n") / F.sum("n").over(Window.partitionBy(a)), "share_to": F.col("n") / F.sum("n").over(Window.partitionBy(b))})


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and NMI (arithmetic mean) of two labellings."""
    table = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    xlogx = lambda c: F.sum(F.col(c) * F.ln(c))
    cells = table.agg(two("n").alias("s"), xlogx("n").alias("hn"), F.sum("n").alias("t"))
    rows = table.groupBy(a).agg(F.sum("n").alias("m")).agg(two("m").alias("sa"), xlogx("m").alias("ha"))
    cols = table.groupBy(b).agg(F.sum("n").alias("m")).agg(two("m").alias("sb"), xlogx("m").alias("hb"))
    one = cells.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.expr("sa * sb / (t * (t - 1) / 2)")
    ari = F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0))
    information = F.expr("(hn - ha - hb) / t + ln(t)")
    entropies = F.expr("(2 * ln(t) - ha / t - hb / t) / 2")
    return one.select(ari.alias("ari"), F.coalesce(F.try_divide(information, entropies), F.lit(1.0)).alias("nmi"))
