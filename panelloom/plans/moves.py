"""Queries of change over time: scenarios, displacement, lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import lifecycle, scoring, series
from panelloom.plans.queries import _L, daily_labels
from panelloom.plans.registry import query, rounded, table
from panelloom.plans.scoring import _F, CENTRES, _centres, _near, features
from panelloom.sources.shared import materialize


@query(f"""WITH {_F}, md AS (SELECT substr(period, 6, 2)::INT AS month, dim, median(x) FILTER (WHERE period LIKE '1996%') AS a, median(x) FILTER (WHERE period LIKE '1998%') AS b FROM fx GROUP BY ALL)
SELECT entity, dim, round(median(x), 6) AS raw, round(median(x - (b - a)), 6) AS relative FROM fx JOIN md ON md.month = substr(period, 6, 2)::INT AND md.dim = fx.dim WHERE period LIKE '1998%' GROUP BY entity, fx.dim""".replace("SELECT entity, dim, round(median(x)", "SELECT entity, fx.dim, round(median(x)"))
def same_month_shift(spark, sf_dir):
    return rounded(series.same_month_shift(features(spark, sf_dir), 1996, 1998), "raw", "relative")


@query(f"""WITH {_F}, {_centres()}, hm AS (SELECT dim, median(x) AS home FROM an WHERE year = 1996 GROUP BY dim), sh AS (SELECT period, dim, median(x) - any_value(home) AS shift FROM fx JOIN hm USING (dim) GROUP BY period, dim), nm AS (SELECT unnest(['as_is', 'all', 'dim_0', 'dim_1', 'dim_2', 'dim_3', 'dim_4']) AS scenario),
sc AS (SELECT scenario, entity, period, dim, x - CASE WHEN scenario = 'all' OR scenario = 'dim_' || dim THEN shift ELSE 0 END AS x FROM fx JOIN sh USING (period, dim) CROSS JOIN nm), {_near('sc', 'scenario, entity, period', 'ns')} SELECT scenario, period, cluster, count(*) AS n FROM ns GROUP BY ALL""")
def drift_scenarios(spark, sf_dir):
    long = materialize(features(spark, sf_dir), "features")
    home = scoring.annual(long).where("year = 1996")
    rows = scoring.vectors_of(series.drift_scenarios(long, home, 5), "scenario", "entity", "period")
    return rows.select("scenario", "period", scoring.nearest(F.col("vector"), CENTRES)["cluster"].alias("cluster")).groupBy("scenario", "period", "cluster").agg(F.count("*").alias("n"))


@query(f"""WITH {_F}, g AS (SELECT a.dim, b.x - a.x AS d FROM an a JOIN an b USING (entity, dim) WHERE a.year = 1996 AND b.year = 1998), p AS (SELECT dim, count(*) AS n, avg(d) AS m, sum(d * d) AS s, var_pop(d) * count(*) AS r FROM g GROUP BY dim)
SELECT round(sum(s), 6) AS total, round(sum(n * m * m), 6) AS common, round(sum(r), 6) AS individual, round(sum(n * m * m) / sum(s), 6) AS common_fraction FROM p""")
def displacement(spark, sf_dir):
    years = scoring.annual(features(spark, sf_dir)).select(F.col("entity").alias("id"), "year", "dim", "x")
    found = series.displacement(years.where("year = 1996"), years.where("year = 1998"))
    return rounded(found, *found.columns)


@query("""WITH c AS (SELECT o_custkey AS entity, month(o_orderdate) - 1 AS month, sum(round(o_totalprice * 100)::BIGINT) AS cents, count(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT CAST(draw AS BIGINT) AS draw, (('0x' || substr(md5('8:' || draw || ':' || b), 1, 12))::BIGINT % 12 + i) % 12 AS month FROM range(15) d(draw), range(4) e(b), range(3) f(i)),
w AS (SELECT draw, month, count(*) AS times FROM b GROUP BY ALL)
SELECT draw, entity, CAST(sum(times) AS BIGINT) AS months, CAST(sum(times * n) AS BIGINT) AS n, CAST(sum(times * cents) AS BIGINT) AS cents FROM w JOIN c USING (month) GROUP BY ALL""")
def month_blocks(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), (F.month("o_orderdate") - 1).alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    times = series.month_blocks(spark, 15, 12, 3, 8).groupBy("draw", "month").agg(F.count("*").alias("times"))
    return months.join(F.broadcast(times), "month").groupBy("draw", "entity").agg(F.sum("times").alias("months"), *[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n", "cents")])


@query(f"WITH {_L} SELECT a.key, a.t, a.label, b.label AS label_next FROM lab a JOIN lab b ON a.key = b.key AND b.t = a.t + 1")
def next_step(spark, sf_dir):
    return series.follow(daily_labels(spark, sf_dir), "key", "t", "label").withColumn("t", F.col("t").cast("long"))


#: Three-day habits: each user's most frequent type, numbered, ties to the least.
_TY = "['click', 'error', 'purchase', 'signup', 'view']"
_H3 = f"""c3 AS (SELECT user_id AS id, ((CAST(ts AS DATE) - DATE '2024-01-01') // 3)::INT AS t, event_type, count(*) AS n FROM events GROUP BY ALL), ty AS (SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS k FROM (SELECT DISTINCT event_type FROM events)),
lb AS (SELECT t, id, k + 5 * (id % 2)::INT AS cluster FROM c3 JOIN ty USING (event_type) QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY n DESC, event_type) = 1),
sz AS (SELECT t, cluster, count(*) AS n FROM lb GROUP BY ALL), bd AS (SELECT min(t) AS a, max(t) AS z FROM sz), ol AS (SELECT t + 1 AS t, cluster AS i, n AS nb FROM sz, bd WHERE t < z), nw AS (SELECT t, cluster AS j, n AS na FROM sz, bd WHERE t > a),
cm AS (SELECT b.t, a.cluster AS i, b.cluster AS j, count(*) AS c FROM lb a JOIN lb b ON a.id = b.id AND b.t = a.t + 1 GROUP BY ALL), lk AS (SELECT cm.*, nb, na, count(*) OVER (PARTITION BY cm.t, cm.i) AS o, count(*) OVER (PARTITION BY cm.t, cm.j) AS q FROM cm JOIN ol USING (t, i) JOIN nw USING (t, j) WHERE c / (nb + na - c) >= 0.15),
ev AS (SELECT ol.t, CASE WHEN count(lk.j) = 0 THEN 'death' ELSE 'split' END AS event, any_value(ol.nb) AS sb, coalesce(sum(lk.na), 0) AS sa FROM ol LEFT JOIN lk USING (t, i) GROUP BY ol.t, ol.i HAVING count(lk.j) <> 1
 UNION ALL SELECT nw.t, CASE WHEN count(lk.i) = 0 THEN 'birth' ELSE 'merge' END, coalesce(sum(lk.nb), 0), any_value(nw.na) FROM nw LEFT JOIN lk USING (t, j) GROUP BY nw.t, nw.j HAVING count(lk.i) <> 1
 UNION ALL SELECT t, CASE WHEN na / nb > 1.1 THEN 'grow' WHEN na / nb < 0.9 THEN 'shrink' ELSE 'continue' END, nb, na FROM lk WHERE o = 1 AND q = 1)"""


def habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    kinds = rows.select("event_type").distinct().agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    step = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 3).cast("int").alias("t")
    counts = rows.groupBy(F.col("user_id").alias("id"), step, "event_type").count()
    first = counts.groupBy("id", "t").agg(F.min(F.struct(-F.col("count"), "event_type"))["event_type"].alias("kind"))
    number = (F.array_position("kinds", F.col("kind")) - 1 + 5 * (F.col("id") % 2)).cast("int")
    return first.crossJoin(F.broadcast(kinds)).select("t", "id", number.alias("cluster"))


@query(f"WITH {_H3} SELECT t, event, count(*) AS n, CAST(sum(sb) AS BIGINT) AS size_before, CAST(sum(sa) AS BIGINT) AS size_after FROM ev GROUP BY ALL")
def event_series(spark, sf_dir):
    return lifecycle.event_series(habits(spark, sf_dir), 0.15)


@query(f"WITH {_H3} SELECT a.t, a.cluster AS \"from\", b.cluster AS \"to\", count(*) AS n FROM lb a JOIN lb b ON a.id = b.id AND b.t = a.t + 1 GROUP BY ALL")
def group_flows(spark, sf_dir):
    return lifecycle.flows(habits(spark, sf_dir), "cluster")


#: The fold over time is beyond SQL; tests/operators/test_lifecycle.py has known answers.
@query(None)
def lifecycle_tracks(spark, sf_dir):
    found = lifecycle.rejoined(lifecycle.tracks(habits(spark, sf_dir), 0.15), 0.15)
    return found.groupBy("t", "cluster", "track", "root", "started").agg(F.count("*").alias("n"))


@query(f"""WITH {_H3}, mv AS (SELECT id, t AS at_ FROM (SELECT id, t, cluster <> lag(cluster) OVER (PARTITION BY id ORDER BY t) AS m FROM lb) WHERE m), pl AS (SELECT DISTINCT id, (id % 8 + 1)::INT AS t FROM lb), fo AS (SELECT pl.id, pl.t, max(coalesce((abs(at_ - pl.t) <= 1)::INT, 0)) AS hit FROM pl LEFT JOIN mv USING (id) GROUP BY ALL),
ri AS (SELECT mv.id, at_, max(coalesce((abs(at_ - pl.t) <= 1)::INT, 0)) AS hit FROM mv LEFT JOIN pl USING (id) GROUP BY ALL) SELECT (SELECT count(*) FROM fo) AS planted, (SELECT CAST(sum(hit) AS BIGINT) FROM fo) AS found, round((SELECT avg(hit) FROM fo), 6) AS recall, (SELECT count(*) FROM ri) AS changes, round((SELECT avg(hit) FROM ri), 6) AS "precision" """)
def planted_recall(spark, sf_dir):
    labels = habits(spark, sf_dir)
    planted = labels.select("id", (F.col("id") % 8 + 1).cast("int").alias("t")).distinct()
    return rounded(lifecycle.planted_recall(labels, planted), "recall", "precision")
