"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from panelloom.sources.shared import discard, materialize


#: Nodes of more than one in so many links are joined by broadcast.
HEAVY = 256
#: Shares into which the links of such a node are dealt.
SHARES = 1 << 20


def _with_least(edges: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``a`` in ``least`` (a, m, n), which has every ``a``.

    ``n`` counts the rows of ``edges`` that ``a`` has at most.  Those of many
    rows, at most ``2 * HEAVY`` nodes, are broadcast, and the links of such a
    star's centre are dealt by a share, which finds no row in the other join.
    Either table is named as few times as can be: what names ``edges`` holds
    its whole plan again, in the driver's memory.
    """
    many = max(HEAVY // 4, n_links // HEAVY)
    heavy = F.broadcast(least.where(F.col("n") > many).select("a", F.col("m").alias("heavy")))
    light = least.where(F.col("n") <= many).select("a", F.lit(0).alias("share"), F.col("m").alias("light"))
    share = F.when(F.col("heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    dealt = edges.join(heavy, "a", "left").withColumn("share", share)
    return dealt.join(light, ["a", "share"], "left").select("a", "b", F.coalesce("heavy", "light").alias("m"))


def _large_star(edges: DataFrame, n_links: int) -> DataFrame:
    """Link each node's larger neighbours to the least of it and its neighbours."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.explode(ends).alias("end")).select("end.a", "end.b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _with_least(up, least, n_links).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n_links: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = _with_least(down, least, n_links)  # the least neighbour's own row links the node itself
    return linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _state(links: DataFrame) -> Row:
    """Number and checksum of links."""
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (long ``a``, ``b``), root the least.

    Each star is written to the shared folder, so that no plan holds two of
    them; the driver sees only a count and a checksum.  Self-links and repeated
    links are harmless, links with a null end are ignored, no links give no
    rows.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(clean, "links")
    seen = _state(now)
    for _ in range(rounds):
        large = materialize(_large_star(now, seen[0]), "links")
        after = materialize(_small_star(large, seen[0]).distinct(), "links")
        state = _state(after)
        discard(now)
        discard(large)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("end")).select("end.node", "end.root").distinct()
