"""Groups through time: their events, identities and flows.

Labels are ``t, id, cluster`` with whole numbers for clusters, each id once a
step.  Events are found in Spark for all steps at once; the fold over time
runs on the driver, on groups, not on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups, over all steps, that the driver folds.
MOST_GROUPS = 200_000


def overlaps(labels: DataFrame) -> DataFrame:
    """``t, i, j, c, nb, na``: members that group i of step t - 1 and group j of step t share, and sizes."""
    sizes = labels.groupBy("t", "cluster").agg(F.count("*").alias("n"))
    now = labels.select("t", "id", F.col("cluster").alias("j"))
    before = labels.select((F.col("t") + 1).alias("t"), "id", F.col("cluster").alias("i"))
    common = before.join(now, ["t", "id"]).groupBy("t", "i", "j").agg(F.count("*").alias("c"))
    left = sizes.select((F.col("t") + 1).alias("t"), F.col("cluster").alias("i"), F.col("n").alias("nb"))
    return common.join(left, ["t", "i"]).join(sizes.select("t", F.col("cluster").alias("j"), F.col("n").alias("na")), ["t", "j"])


def step_events(labels: DataFrame, threshold: float = 0.3, size_change: float = 0.1) -> DataFrame:
    """``t, event, sources, targets, size_before, size_after`` between each step and the one before.

    Groups are linked if Jaccard's index of their members reaches the
    threshold; a lone link continues, grows or shrinks, several of one group
    are a split or a merge, none a death or a birth.
    """
    steps = labels.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    sizes = labels.groupBy("t", "cluster").agg(F.count("*").alias("n")).crossJoin(F.broadcast(steps))
    olds = sizes.where("t < last").select((F.col("t") + 1).alias("t"), F.col("cluster").alias("i"), F.col("n").alias("nb"))
    news = sizes.where("t > first").select("t", F.col("cluster").alias("j"), F.col("n").alias("na"))
    linked = overlaps(labels).where(F.col("c") / (F.col("nb") + F.col("na") - F.col("c")) >= threshold)
    linked = linked.withColumns({"o": F.count("*").over(Window.partitionBy("t", "i")), "n": F.count("*").over(Window.partitionBy("t", "j"))})
    listed = lambda c: F.sort_array(F.collect_list(c)).cast("array<int>")
    none = F.array().cast("array<int>")
    one = lambda c: F.array(c).cast("array<int>")
    out = olds.join(linked.select("t", "i", "j", "na"), ["t", "i"], "left").groupBy("t", "i", "nb").agg(F.count("j").alias("k"), listed("j").alias("targets"), F.coalesce(F.sum("na"), F.lit(0)).alias("size_after"))
    out = out.where("k <> 1").select("t", F.when(F.col("k") == 0, "death").otherwise("split").alias("event"), one("i").alias("sources"), "targets", F.col("nb").alias("size_before"), "size_after")
    into = news.join(linked.select("t", "i", "j", "nb"), ["t", "j"], "left").groupBy("t", "j", "na").agg(F.count("i").alias("k"), listed("i").alias("sources"), F.coalesce(F.sum("nb"), F.lit(0)).alias("size_before"))
    into = into.where("k <> 1").select("t", F.when(F.col("k") == 0, "birth").otherwise("merge").alias("event"), F.coalesce("sources", none).alias("sources"), one("j").alias("targets"), "size_before", F.col("na").alias("size_after"))
    ratio = F.col("na") / F.col("nb")
    kind = F.when(ratio > 1 + size_change, "grow").when(ratio < 1 - size_change, "shrink").otherwise("continue")
    lone = linked.where("o = 1 and n = 1").select("t", kind.alias("event"), one("i").alias("sources"), one("j").alias("targets"), F.col("nb").alias("size_before"), F.col("na").alias("size_after"))
    return out.unionByName(into).unionByName(lone)


def event_series(labels: DataFrame, threshold: float = 0.3, size_change: float = 0.1) -> DataFrame:
    """``t, event, n, size_before, size_after``: the events of each step, counted."""
    return step_events(labels, threshold, size_change).groupBy("t", "event").agg(F.count("*").alias("n"), F.sum("size_before").alias("size_before"), F.sum("size_after").alias("size_after"))


def owners(sizes: dict[int, dict[int, int]], events: dict[int, list[tuple[str, list[int], list[int]]]]) -> dict[tuple[int, int], int]:
    """The track of each group (step, cluster), by a fold over the steps.

    A lone link keeps the track; of merged groups the largest gives it, of
    split ones the largest takes it, the least label in a tie; births and the
    other parts of a split begin tracks.  A group that is both a part of a
    split and a merge takes the track that comes first in the order of events:
    deaths and splits by source, then births and merges by target, then lone
    links.
    """
    steps = sorted(sizes)
    track: dict[tuple[int, int], int] = {}
    count = 0
    for c in sorted(sizes[steps[0]] if steps else []):
        track[steps[0], c] = count
        count += 1
    rank = {"death": 0, "split": 0, "birth": 1, "merge": 1}
    for before, t in zip(steps, steps[1:], strict=False):
        for kind, sources, targets in sorted(events.get(t, []), key=lambda e: (rank.get(e[0], 2), (e[1] or e[2]) if rank.get(e[0], 2) != 1 else e[2])):
            if kind in ("continue", "grow", "shrink"):
                given = {targets[0]: track[before, sources[0]]}
            elif kind == "merge":
                heir = max(sources, key=lambda c: (sizes[before][c], -c))
                given = {targets[0]: track[before, heir]}
            elif kind == "split":
                heir = max(targets, key=lambda c: (sizes[t][c], -c))
                given = {heir: track[before, sources[0]], **{c: None for c in targets if c != heir}}
            else:
                given = dict.fromkeys(targets)
            for c, number in given.items():
                if (t, c) not in track:
                    if number is None:
                        number, count = count, count + 1
                    track[t, c] = number
        if any((t, c) not in track for c in sizes[t]):
            raise ValueError(f"the events of step {t} do not cover every group")
    return track


def tracks(labels: DataFrame, threshold: float = 0.3, size_change: float = 0.1) -> DataFrame:
    """The labels with ``track``, the identity of their group through time, and ``started``, its name.

    A name is the step and the cluster in which the track began.
    """
    counts = labels.groupBy("t", "cluster").agg(F.count("*").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups to follow")
    sizes: dict[int, dict[int, int]] = {}
    for t, c, n in counts:
        sizes.setdefault(t, {})[c] = n
    events: dict[int, list] = {}
    for r in step_events(labels, threshold, size_change).collect():  # no more than the groups and their links
        events.setdefault(r["t"], []).append((r["event"], list(r["sources"]), list(r["targets"])))
    found = owners(sizes, events)
    start: dict[int, tuple[int, int]] = {}
    for (t, c), k in sorted(found.items()):
        start.setdefault(k, (t, c))
    rows = [(t, c, k, f"{start[k][0]}:{start[k][1]}") for (t, c), k in found.items()]
    kinds = {f.name: f.dataType.simpleString() for f in labels.schema}
    table = labels.sparkSession.createDataFrame(rows, f"t {kinds['t']}, cluster {kinds['cluster']}, track int, started string")
    return labels.join(F.broadcast(table), ["t", "cluster"])


def rejoined(tracked: DataFrame, threshold: float) -> DataFrame:
    """The rows (t, id, track) with ``root``: a track that begins may go on a dead one.

    It does if Jaccard's index of its first members and the last members of a
    track that ended before reaches the threshold; the best, then the least,
    is taken, in the order in which tracks begin.
    """
    spans = tracked.groupBy("track").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = spans.collect()
    if len(ends) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} tracks")
    own = tracked.join(F.broadcast(spans), "track")
    begin, end = own.where("t = first").select("track", "id"), own.where("t = last").select(F.col("track").alias("old"), "id", F.col("last").alias("ended"))
    sizes_b = begin.groupBy("track").agg(F.count("*").alias("nb"))
    sizes_e = end.groupBy("old").agg(F.count("*").alias("ne"))
    first = spans.select("track", "first")
    # only a pair of tracks that share members, the older ended before, can be joined
    shared = begin.join(end, "id").join(first, "track").where("ended < first").groupBy("track", "old").agg(F.count("*").alias("c"))
    scored = shared.join(sizes_b, "track").join(sizes_e, "old").select("track", "old", (F.col("c") / (F.col("nb") + F.col("ne") - F.col("c"))).alias("j"))
    likeness: dict[int, list[tuple[float, int]]] = {}
    for r in scored.where(F.col("j") >= threshold).collect():
        likeness.setdefault(r["track"], []).append((r["j"], r["old"]))
    first_of = {r["track"]: r["first"] for r in ends}
    last_of = {r["track"]: r["last"] for r in ends}
    root: dict[int, int] = {}
    tail: dict[int, int] = {}  # the track that now ends each root
    for k in sorted(first_of, key=lambda x: (first_of[x], x)):
        score = dict((old, j) for j, old in likeness.get(k, []))
        best = max(((score[t], -r) for r, t in tail.items() if t in score and last_of[t] < first_of[k]), default=None)
        root[k] = -best[1] if best else k
        tail[root[k]] = k
    table = tracked.sparkSession.createDataFrame(list(root.items()), "track int, root int")
    return tracked.join(F.broadcast(table), "track")


def flows(tracked: DataFrame, column: str = "track") -> DataFrame:
    """``t, from, to, n``: how many go from each track to each between a step and the next."""
    now = tracked.select("t", "id", F.col(column).alias("from"))
    after = tracked.select((F.col("t") - 1).alias("t"), "id", F.col(column).alias("to"))
    return now.join(after, ["t", "id"]).groupBy("t", "from", "to").agg(F.count("*").alias("n"))


def planted_recall(labels: DataFrame, planted: DataFrame, window: int = 1) -> DataFrame:
    """One row: planted switches (id, t) of which the labels change within ``window`` steps, and the rest.

    ``precision`` is the share of label changes near a planted one.
    """
    before = F.lag("cluster").over(Window.partitionBy("id").orderBy("t"))
    moved = labels.withColumn("moved", F.col("cluster") != before).where("moved").select("id", F.col("t").alias("at"))
    near = F.abs(F.col("at") - F.col("t")) <= window
    found = planted.join(moved, ["id"], "left").groupBy("id", "t").agg(F.max(F.coalesce(near.cast("int"), F.lit(0))).alias("hit"))
    right = moved.join(planted, ["id"], "left").groupBy("id", "at").agg(F.max(F.coalesce(near.cast("int"), F.lit(0))).alias("hit"))
    return found.agg(F.count("*").alias("planted"), F.sum("hit").alias("found"), F.avg("hit").alias("recall")).crossJoin(right.agg(F.count("*").alias("changes"), F.avg("hit").alias("precision")))
