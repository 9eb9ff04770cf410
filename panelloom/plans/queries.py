"""Queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import graph, neighbours, panel, series, stats
from panelloom.plans.registry import ORACLE_SQL, QUERIES, query, rounded, table
from panelloom.sources.shared import materialize

__all__ = ["ORACLE_SQL", "QUERIES"]

SEGMENTS = 5


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The first ship year of the table, and how many years and months lie between its first and last date."""
    first, last = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return first.year, last.year - first.year + 1, (last.year - first.year) * 12 + last.month - first.month + 1


def brand_year(spark: SparkSession, sf_dir: str, months: bool = False) -> DataFrame:
    """Sales by brand, ship year (or month) and market segment."""
    year = F.year("l_shipdate")
    period = year * 12 + F.month("l_shipdate") if months else year
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", period.alias("period"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    joined = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(parts, "l_partkey")
    return joined.groupBy("entity", "period", "category").agg(F.sum("value").alias("value"))


def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.balanced(brand_year(spark, sf_dir), span(spark, sf_dir)[1], SEGMENTS)


#: Years up to the cutoff, the fourth of the table, calibrate.
_SPAN = "sp AS (SELECT year(min(l_shipdate)) AS y0, year(max(l_shipdate)) - year(min(l_shipdate)) + 1 AS years, (year(max(l_shipdate)) - year(min(l_shipdate))) * 12 + month(max(l_shipdate)) - month(min(l_shipdate)) + 1 AS months FROM lineitem)"
_P = f"""{_SPAN}, all_p AS (SELECT p_brand AS entity, CAST(year(l_shipdate) AS INT) AS period, c_mktsegment AS category, sum(l_extendedprice * (1 - l_discount)) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
 GROUP BY ALL),
p AS (SELECT * FROM all_p WHERE entity IN (SELECT entity FROM all_p WHERE value > 0 GROUP BY entity HAVING count(*) = (SELECT years * {SEGMENTS} FROM sp))),
t AS (SELECT *, sum(value) OVER (PARTITION BY entity, period) AS total FROM p),
r AS (SELECT *, ln(value / total) AS log_ratio FROM t),
scaler AS (SELECT category, median(log_ratio) AS center, quantile_cont(log_ratio, 0.75) - quantile_cont(log_ratio, 0.25) AS iqr FROM r WHERE period <= (SELECT y0 + 3 FROM sp) GROUP BY category),
prof AS (SELECT entity, category, median((log_ratio - center) / iqr / sqrt({SEGMENTS}.0)) AS coordinate FROM r JOIN scaler USING (category) GROUP BY entity, category),
protos AS (SELECT dense_rank() OVER (ORDER BY entity) - 1 AS cluster, category, coordinate AS center_value FROM prof QUALIFY dense_rank() OVER (ORDER BY entity) <= 4),
near AS (SELECT entity, cluster, sqrt(sum((coordinate - center_value) ** 2)) AS distance FROM prof JOIN protos USING (category) GROUP BY entity, cluster),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY distance, cluster) AS rn, lead(distance) OVER (PARTITION BY entity ORDER BY distance, cluster) AS second FROM near)
"""


def _with(tail: str) -> str:
    return f"WITH {_P} {tail}"


@query(_with("SELECT entity, period, category, round(value / total, 6) AS share FROM t"))
def panel_shares(spark, sf_dir):
    t = panel.with_total(balanced_panel(spark, sf_dir))
    return rounded(t.select("entity", "period", "category", (F.col("value") / F.col("total")).alias("share")), "share")


@query(
    _with("""PIVOT (SELECT entity, period, category, value FROM t) ON category IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') USING round(sum(value), 5)""").replace("PIVOT", "SELECT * FROM (PIVOT").rstrip()
    + ")"
)
def panel_pivot(spark, sf_dir):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return balanced_panel(spark, sf_dir).groupBy("entity", "period").pivot("category", names).agg(F.round(F.sum("value"), 5))


@query(
    f"""WITH {_SPAN}, c AS (SELECT p_brand AS entity, year(l_shipdate) * 12 + month(l_shipdate) AS period, c_mktsegment AS category, sum(l_extendedprice * (1 - l_discount)) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
 GROUP BY ALL),
s AS (SELECT entity, count(DISTINCT period) AS periods, count(*) FILTER (WHERE value > 0) AS cells FROM c GROUP BY entity)
SELECT entity, periods, CASE WHEN periods < months THEN 'missing_period' ELSE 'missing_category' END AS reason FROM s, sp WHERE cells < months * {SEGMENTS}"""
)
def panel_exclusions(spark, sf_dir):
    return panel.exclusions(brand_year(spark, sf_dir, months=True), span(spark, sf_dir)[2], SEGMENTS)


@query(_with("SELECT category, round(center, 6) AS center, round(iqr, 6) AS iqr FROM scaler"))
def calibration_scaler(spark, sf_dir):
    return rounded(panel.calibration(panel.log_ratio(balanced_panel(spark, sf_dir)), span(spark, sf_dir)[0] + 3), "center", "iqr")


@query(_with("""SELECT entity, period, category, round(sqrt(value / (total * 1.25)) / sqrt(2.0), 6) AS coordinate FROM t UNION ALL SELECT entity, period, 'residual', round(sqrt((any_value(total) * 1.25 - sum(value)) / (any_value(total) * 1.25)) / sqrt(2.0), 6) FROM t GROUP BY entity, period"""))
def hellinger_profile(spark, sf_dir):
    # a total of which the categories are four fifths
    rows = panel.with_total(balanced_panel(spark, sf_dir)).withColumn("total", F.col("total") * 1.25)
    return rounded(panel.hellinger(rows, "total").select("entity", "period", "category", "coordinate"), "coordinate")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = panel.log_ratio(balanced_panel(spark, sf_dir))
    return panel.annual_profile(panel.frozen_profile(ratios, panel.calibration(ratios, span(spark, sf_dir)[0] + 3), SEGMENTS))


@query(_with("SELECT entity, category, round(coordinate, 6) AS coordinate FROM prof"))
def annual_profile(spark, sf_dir):
    return rounded(profiles(spark, sf_dir), "coordinate")


@query(_with("SELECT entity, CAST(cluster AS INT) AS cluster, round(distance, 6) AS distance, round((second - distance) / second, 6) AS margin FROM ranked WHERE rn = 1"))
def profile_scoring(spark, sf_dir):
    found = profiles(spark, sf_dir)
    first = found.select("entity").distinct().orderBy("entity").limit(4)
    number = first.agg(F.sort_array(F.collect_list("entity")).alias("e")).select(F.posexplode("e").alias("cluster", "entity"))
    protos = found.join(F.broadcast(number), "entity").select("cluster", "category", F.col("coordinate").alias("center_value"))
    return rounded(panel.nearest_prototype(found, protos), "distance", "margin")


@query(
    """WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT nation, CAST(year AS INT) AS year, n_orders, CASE WHEN year < 1997 + nation % 3 THEN 'old' ELSE 'new' END AS version FROM y"""
)
def registry_interval_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    facts = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey").groupBy("nation", "year").agg(F.count("*").alias("n_orders"))
    turn = (F.lit(1997) + F.col("n_nationkey") % 3).alias("turn")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), turn)
    old = nations.select("nation", F.lit(0).alias("year_from"), F.col("turn").alias("year_to"), F.lit("old").alias("version"))
    new = nations.select("nation", F.col("turn").alias("year_from"), F.lit(9999).alias("year_to"), F.lit("new").alias("version"))
    return panel.interval_join(facts, old.unionByName(new), "nation", "year")


@query("SELECT count(*) AS n_keys, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)")
def duplicate_key_audit(spark, sf_dir):
    return panel.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY ALL), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY ALL)
SELECT count(*) AS n_keys, count(*) FILTER (WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)) AS n_differing FROM a FULL JOIN b USING (o_custkey)"""
)
def multiset_reconcile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return panel.multiset_difference(orders.where("year <= 1997"), orders.where("year >= 1996"), "o_custkey")


@query(
    """SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN 'matched' WHEN count(DISTINCT c_mktsegment) > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN max(c_mktsegment) END AS value FROM customer GROUP BY c_nationkey"""
)
def unique_or_ambiguous(spark, sf_dir):
    return panel.unique_or_ambiguous(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query(r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[ \t\r\n]+', ' ', 'g')) AS name FROM supplier")
def name_normalise(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", panel.clean_name(F.col("s_name")).alias("name"))


# --- graphs over the embeddings -------------------------------------------------

_G = """v AS (SELECT vec_id AS id, label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
d AS (SELECT a.id AS src, b.id AS dst, sqrt(sum((b.x - a.x) ** 2)) AS distance FROM v a JOIN v b ON a.dim = b.dim AND a.id <> b.id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d QUALIFY rank <= 15),
s AS (SELECT median(distance) FILTER (WHERE distance > 0) AS s FROM k),
w AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, exp(-((distance / s) ** 2) / 2) AS weight FROM k, s),
e AS (SELECT src, dst, max(weight) AS weight, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT vec_id AS id, label AS cluster FROM embeddings),
m AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
b AS (SELECT x.cluster AS ci, y.cluster AS cj, count(*)::DOUBLE AS b FROM m JOIN l x ON src = x.id JOIN l y ON dst = y.id GROUP BY ALL)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def knn_edges(spark: SparkSession, sf_dir: str, k: int = 15) -> DataFrame:
    return graph.gaussian(graph.knn(vectors(spark, sf_dir), k))


@query(f"WITH {_G} SELECT src, dst, round(weight, 6) AS weight FROM e")
def knn_graph(spark, sf_dir):
    return rounded(knn_edges(spark, sf_dir), "weight")


@query(f"WITH {_G} SELECT src, dst, round(weight, 6) AS weight FROM e WHERE n = 2")
def knn_mutual(spark, sf_dir):
    return rounded(graph.gaussian(graph.knn(vectors(spark, sf_dir), 15), "mutual"), "weight")


@query(f"""WITH {_G}, c AS (SELECT src AS id, distance AS s7 FROM k WHERE rank = 7)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(exp(-distance * distance / (a.s7 * z.s7))), 6) AS weight FROM k JOIN c a ON src = a.id JOIN c z ON dst = z.id GROUP BY 1, 2""")
def local_scale_graph(spark, sf_dir):
    return rounded(graph.local_scale(graph.knn(vectors(spark, sf_dir), 15)), "weight")


#: Components of the graph: each node's least reachable one.
_REACH = """WITH RECURSIVE {0}, nodes AS (SELECT vec_id AS id, label FROM embeddings), reach AS (SELECT id, id AS root FROM nodes UNION SELECT m.dst, r.root FROM reach r JOIN m ON m.src = r.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query(_REACH.format(_G) + """, g AS (SELECT nodes.id, count(src) AS d FROM nodes LEFT JOIN m ON src = id GROUP BY nodes.id),
tri AS (SELECT count(*) AS t FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), wi AS (SELECT avg((a.label = b.label)::INT::DOUBLE) AS s FROM e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id)
SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, (SELECT count(DISTINCT root) FROM comp) AS n_components, count(*) FILTER (WHERE d = 0) AS n_isolates, round(avg(d), 6) AS mean_degree, (SELECT t FROM tri) AS n_triangles,
round(3 * (SELECT t FROM tri) / sum(d * (d - 1) / 2), 6) AS transitivity, round((SELECT s FROM wi), 6) AS within_cluster FROM g""")
def graph_structure(spark, sf_dir):
    return rounded(graph.structure(knn_edges(spark, sf_dir), labels(spark, sf_dir)), "mean_degree", "transitivity", "within_cluster")


@query(_REACH.format(_G.replace("e AS (SELECT src, dst, max(weight)", "e AS (SELECT src, dst, max(weight)").replace("rank <= 15", "rank <= 2")) + """, st AS (SELECT nodes.id, count(e1.src) AS d, coalesce(sum(e1.weight), 0) AS s FROM nodes LEFT JOIN (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) e1 ON e1.src = nodes.id GROUP BY nodes.id)
SELECT CAST(sum(d) / 2 AS BIGINT) AS n_edges, (SELECT count(DISTINCT root) FROM comp) AS n_components, count(*) FILTER (WHERE d = 0) AS n_isolates, round(avg(d), 6) AS mean_degree, round(median(s), 6) AS median_strength FROM st""")
def graph_summary(spark, sf_dir):
    return rounded(graph.summary(knn_edges(spark, sf_dir, 2), labels(spark, sf_dir)), "mean_degree", "median_strength")


@query(f"""WITH {_G}, t10 AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k WHERE rank <= 10)
SELECT round((SELECT count(*) FROM t10 JOIN e USING (src, dst)) / (SELECT count(*) FROM (SELECT src, dst FROM t10 UNION SELECT src, dst FROM e)), 6) AS jaccard""")
def edge_jaccard(spark, sf_dir):
    near = graph.knn(vectors(spark, sf_dir), 15)
    edges = lambda n: n.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return rounded(graph.edge_jaccard(edges(near.where("rank <= 10")), edges(near)), "jaccard")


@query(f"WITH {_G} SELECT ci, cj, b FROM b")
def block_sums(spark, sf_dir):
    return graph.block_sums(knn_edges(spark, sf_dir), labels(spark, sf_dir))


#: The labels, all in one cluster, and the labels beside a cluster without edges.
_PARTS = """parts AS (SELECT 'labels' AS part, id, cluster FROM l UNION ALL SELECT 'one', id, 0 FROM l UNION ALL SELECT 'edgeless', id, cluster FROM l UNION ALL SELECT 'edgeless', -1, 99 UNION ALL SELECT 'two edgeless', id, cluster FROM l UNION ALL SELECT 'two edgeless', -1, 99 UNION ALL SELECT 'two edgeless', -2, 98),
bp AS (SELECT x.part, x.cluster AS ci, y.cluster AS cj, count(*)::DOUBLE AS b FROM m JOIN parts x ON src = x.id JOIN parts y ON dst = y.id AND x.part = y.part GROUP BY ALL),
per AS (SELECT c.part, c.ci, coalesce(i, 0) AS i, coalesce(s, 0) AS s FROM (SELECT DISTINCT part, cluster AS ci FROM parts) c LEFT JOIN (SELECT part, ci, coalesce(sum(b) FILTER (WHERE ci = cj), 0) AS i, sum(b) AS s FROM bp GROUP BY ALL) USING (part, ci))"""


def partitions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    own = labels(spark, sf_dir)
    alone = own.sparkSession.createDataFrame([(-1, 99), (-2, 98)], "id long, cluster int")
    kind = own.schema["cluster"].dataType
    alone = alone.withColumn("cluster", F.col("cluster").cast(kind))
    return {"labels": own, "one": own.withColumn("cluster", F.lit(0).cast(kind)), "edgeless": own.unionByName(alone.where("id = -1")), "two edgeless": own.unionByName(alone)}


def of_partitions(spark: SparkSession, sf_dir: str, index) -> DataFrame:
    """One row of ``index(blocks, partition)`` for each partition."""
    edges, out = materialize(knn_edges(spark, sf_dir), "edges"), None
    for name, partition in partitions(spark, sf_dir).items():
        row = index(graph.block_sums(edges, partition), partition).withColumn("part", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_G}, {_PARTS}
SELECT part, count(*) AS k, round(CASE WHEN count(*) > 1 AND count(*) FILTER (WHERE s = 0) = 0 THEN avg(CASE WHEN s > 0 THEN i / s END) END, 6) AS avi, count(*) FILTER (WHERE s = 0) AS avi_undefined,
round(CASE WHEN count(*) > 1 THEN sum(i / t - (s / t) ** 2) END, 6) AS newman_q, round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN s > 0 THEN i / s ELSE 0 END) END, 6) AS turbo_mq FROM per JOIN (SELECT part, sum(s) AS t FROM per GROUP BY part) USING (part) GROUP BY part""")
def network_indices(spark, sf_dir):
    return rounded(of_partitions(spark, sf_dir, graph.network_indices), "avi", "newman_q", "turbo_mq")


@query(f"""WITH {_G}, {_PARTS}, o AS (SELECT part, ci, s - i AS o FROM per),
pr AS (SELECT x.part, x.ci, coalesce(b, 0) AS b, x.o + y.o - coalesce(b, 0) AS den FROM o x JOIN o y ON x.part = y.part AND x.ci <> y.ci LEFT JOIN bp ON bp.part = x.part AND bp.ci = x.ci AND bp.cj = y.ci),
u AS (SELECT part, count(*) FILTER (WHERE den <= 0) AS undefined_pairs, sum(CASE WHEN den > 0 THEN b / den END) AS s FROM pr GROUP BY part), kc AS (SELECT part, count(*) AS nk FROM o GROUP BY part)
SELECT part, round(CASE WHEN nk > 1 AND coalesce(undefined_pairs, 0) = 0 THEN s / nk END, 6) AS avu, coalesce(undefined_pairs, 0) AS undefined_pairs FROM kc LEFT JOIN u USING (part)""")
def avu(spark, sf_dir):
    return rounded(of_partitions(spark, sf_dir, graph.avu), "avu")


@query(f"""WITH {_G}, per AS (SELECT cluster, dim, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM v GROUP BY ALL), gr AS (SELECT dim, avg(x) AS g FROM v GROUP BY dim),
q AS (SELECT sum(n * (m - g) ** 2) AS ssb, sum(w) AS ssw, count(DISTINCT cluster) AS k, sum(n) FILTER (WHERE dim = 1) AS n FROM per JOIN gr USING (dim))
SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS ch, round((ssb / (k - 1)) / (ssw / (n - k)) / n, 6) AS ch_over_n FROM q""")
def calinski_harabasz(spark, sf_dir):
    return rounded(graph.calinski_harabasz(vectors(spark, sf_dir), labels(spark, sf_dir)), "ch", "ch_over_n")


@query(f"""WITH {_G}, pc AS (SELECT src, x.cluster AS own, y.cluster AS other, avg(distance) AS d FROM d JOIN l x ON src = x.id JOIN l y ON dst = y.id GROUP BY ALL),
ab AS (SELECT src, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM pc GROUP BY src),
sil AS (SELECT CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)
SELECT round(avg(s), 6) AS silhouette, round(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share FROM sil""")
def silhouette(spark, sf_dir):
    return rounded(graph.silhouette(vectors(spark, sf_dir), labels(spark, sf_dir)), "silhouette", "negative_share")


#: A second partition that merges, splits, scatters and shifts groups of the first.
_SECOND = "CASE WHEN label < 2 THEN 0 WHEN label = 2 THEN 20 + vec_id % 2 WHEN label = 3 AND vec_id % 3 = 0 THEN 4 WHEN label = 9 THEN 90 + vec_id % 7 ELSE label END"


@query(f"""WITH p AS (SELECT label AS i, {_SECOND} AS j FROM embeddings), sb AS (SELECT i, count(*) AS nb FROM p GROUP BY i), sa AS (SELECT j, count(*) AS na FROM p GROUP BY j),
c AS (SELECT i, j, nb, na, c / (nb + na - c) AS jaccard FROM (SELECT i, j, count(*) AS c FROM p GROUP BY ALL) JOIN sb USING (i) JOIN sa USING (j)),
k AS (SELECT *, count(*) OVER (PARTITION BY i) AS o, count(*) OVER (PARTITION BY j) AS n FROM c WHERE jaccard >= 0.3)
SELECT CASE WHEN count(k.j) = 0 THEN 'death' ELSE 'split' END AS event, CAST(sb.i AS VARCHAR) AS sources, coalesce(string_agg(CAST(k.j AS VARCHAR), ',' ORDER BY k.j), '') AS targets, any_value(sb.nb) AS size_before, CAST(coalesce(sum(k.na), 0) AS BIGINT) AS size_after, CAST(NULL AS DOUBLE) AS jaccard
FROM sb LEFT JOIN k ON sb.i = k.i GROUP BY sb.i HAVING count(k.j) <> 1
UNION ALL SELECT CASE WHEN count(k.i) = 0 THEN 'birth' ELSE 'merge' END, coalesce(string_agg(CAST(k.i AS VARCHAR), ',' ORDER BY k.i), ''), CAST(sa.j AS VARCHAR), CAST(coalesce(sum(k.nb), 0) AS BIGINT), any_value(sa.na), NULL FROM sa LEFT JOIN k ON sa.j = k.j GROUP BY sa.j HAVING count(k.i) <> 1
UNION ALL SELECT CASE WHEN na / nb > 1.1 THEN 'grow' WHEN na / nb < 0.9 THEN 'shrink' ELSE 'continue' END, CAST(i AS VARCHAR), CAST(j AS VARCHAR), nb, na, round(jaccard, 6) FROM k WHERE o = 1 AND n = 1""")
def cluster_events(spark, sf_dir):
    second = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(_SECOND).alias("cluster"))
    return rounded(graph.cluster_events(labels(spark, sf_dir), second), "jaccard")


# --- labels over time ----------------------------------------------------------

_L = """c AS (SELECT user_id AS key, CAST(ts AS DATE) - DATE '2024-01-01' AS t, event_type, count(*) AS n FROM events GROUP BY ALL),
lab AS (SELECT key, t, event_type AS label FROM c QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY n DESC, event_type) = 1)
"""


def daily_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent type of event per day, ties to the least."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t")
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), day, "event_type").count()
    return counts.groupBy("key", "t").agg(F.min(F.struct(-F.col("count"), "event_type"))["event_type"].alias("label"))


@query(f"""WITH {_L}, n AS (SELECT a.label AS label_from, b.label AS label_to, count(*) AS n FROM lab a JOIN lab b ON a.key = b.key AND b.t = a.t + 1 GROUP BY ALL)
SELECT label_from, label_to, n, round(n / sum(n) OVER (PARTITION BY label_from), 6) AS share_from, round(n / sum(n) OVER (PARTITION BY label_to), 6) AS share_to FROM n""")
def transition_matrix(spark, sf_dir):
    found = daily_labels(spark, sf_dir)
    after = found.select("key", (F.col("t") - 1).alias("t"), F.col("label").alias("label_to"))
    return rounded(graph.contingency(found.withColumnRenamed("label", "label_from").join(after, ["key", "t"]), "label_from", "label_to"), "share_from", "share_to")


@query(f"""WITH {_L}, w AS (SELECT key, label, lag(label) OVER o AS before, lead(label, 1) OVER o AS a, lead(label, 2) OVER o AS b, lead(label, 3) OVER o AS c FROM lab WINDOW o AS (PARTITION BY key ORDER BY t))
SELECT key, count(*) FILTER (WHERE label <> before) AS n_switches, count(*) FILTER (WHERE label <> before AND (coalesce(a = before, false) OR coalesce(b = before, false) OR coalesce(c = before, false))) AS n_flip_backs FROM w GROUP BY key""")
def switch_flipback(spark, sf_dir):
    return series.switches(daily_labels(spark, sf_dir))


@query(f"""WITH {_L}, x AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM lab a JOIN lab b ON a.key = b.key AND b.t = a.t + 1 GROUP BY ALL),
q AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS hn, sum(n) AS t FROM x),
qa AS (SELECT sum(m * (m - 1) / 2) AS sa, sum(m * ln(m)) AS ha FROM (SELECT sum(n) AS m FROM x GROUP BY la)), qb AS (SELECT sum(m * (m - 1) / 2) AS sb, sum(m * ln(m)) AS hb FROM (SELECT sum(n) AS m FROM x GROUP BY lb))
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(((hn - ha - hb) / t + ln(t)) / ((2 * ln(t) - ha / t - hb / t) / 2), 6) AS nmi FROM q, qa, qb""")
def ari_nmi(spark, sf_dir):
    found = daily_labels(spark, sf_dir)
    after = found.select("key", (F.col("t") - 1).alias("t"), F.col("label").alias("lb"))
    return rounded(graph.agreement(found.withColumnRenamed("label", "la").join(after, ["key", "t"]), "la", "lb"), "ari", "nmi")


# --- monthly series by nation ---------------------------------------------------

_S = """ser AS (SELECT c_nationkey AS key, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS t, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("t"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return orders.join(customers, "c_custkey").groupBy("key", "t").agg(F.sum("o_totalprice").alias("v"))


@query(f"""WITH {_S}, w AS (SELECT key, t, v - (avg(v) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(v) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 AS gap, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n FROM ser),
a AS (SELECT key, t % 12 AS month, avg(gap) AS m FROM w WHERE n = 13 GROUP BY ALL) SELECT key, month, round(m - avg(m) OVER (PARTITION BY key), 2) AS seasonal FROM a""")
def seasonal_profile(spark, sf_dir):
    return series.seasonal_profile(monthly(spark, sf_dir)).withColumn("seasonal", F.round("seasonal", 2))


@query(f"WITH {_S} SELECT key, round(regr_slope(v, t), 3) AS slope, round(regr_intercept(v, t), 3) AS intercept FROM ser GROUP BY key")
def linear_trend(spark, sf_dir):
    return series.linear_trend(monthly(spark, sf_dir)).withColumns({c: F.round(c, 3) for c in ("slope", "intercept")})


_Y = "y AS (SELECT key, t - 24 AS m, v FROM ser WHERE t BETWEEN 24 AND 47), sp AS (SELECT key, m, v, v - lag(v) OVER (PARTITION BY key ORDER BY m) AS d FROM y)"


def _at(i: int) -> str:
    return f"max(v) FILTER (WHERE m = {i})"


@query(f"""WITH {_S}, {_Y}, wd AS (SELECT key, count(*) AS n, max(d) FILTER (WHERE m = 12) AS seam, list(d) FILTER (WHERE m <> 12 AND d IS NOT NULL) AS ds, stddev_samp(d) FILTER (WHERE m <> 12) AS sd, {_at(11)} - {_at(10)} AS a, {_at(23)} - {_at(22)} AS b, {_at(12)} - {_at(0)} AS c, {_at(0)} - {_at(1)} AS d1, {_at(12)} - {_at(13)} AS d2, {_at(11)} - {_at(0)} AS e1, {_at(23)} - {_at(12)} AS e2, {_at(10)} - {_at(1)} AS f1, {_at(22)} - {_at(13)} AS f2 FROM sp GROUP BY key HAVING count(*) = 24),
sm AS (SELECT a.key, avg(b.v - a.v) AS g, min(b.v - a.v) AS h FROM y a JOIN y b ON a.key = b.key AND b.m = a.m + 12 GROUP BY a.key)
SELECT k.key, round(seam, 3) AS seam, CASE WHEN ds IS NOT NULL THEN len(list_filter(ds, lambda x: abs(x) >= abs(seam))) END AS n_larger, len(ds) AS n_steps, round(sd, 3) AS step_sd, round(a, 3) AS nov_dec_first, round(b, 3) AS nov_dec_second, round(c, 3) AS january_change, round(d1, 3) AS jan_feb_first, round(d2, 3) AS jan_feb_second,
round(e1, 3) AS jan_dec_first, round(e2, 3) AS jan_dec_second, round(f1, 3) AS feb_nov_first, round(f2, 3) AS feb_nov_second, round(CASE WHEN ds IS NOT NULL THEN g END, 3) AS same_month_mean, round(CASE WHEN ds IS NOT NULL THEN h END, 3) AS same_month_min FROM (SELECT DISTINCT key FROM ser) k LEFT JOIN wd USING (key) LEFT JOIN sm USING (key)""")
def seam_summary(spark, sf_dir):
    found = series.seams(monthly(spark, sf_dir), 24)
    return rounded(found, *[c for c in found.columns if c not in ("key", "n_larger", "n_steps")], places=3)


@query(f"""WITH {_S}, y AS (SELECT key, t, ln(v) AS v, (t >= 36)::INT::DOUBLE AS s FROM ser), c AS (SELECT key, count(*) AS n, var_pop(t) AS tt, var_pop(s) AS ss, covar_pop(t, s) AS ts, covar_pop(t, v) AS ty, covar_pop(s, v) AS sy, var_pop(v) AS yy FROM y GROUP BY key),
b AS (SELECT *, (ty * ss - sy * ts) / (tt * ss - ts * ts) AS trend, (sy * tt - ty * ts) / (tt * ss - ts * ts) AS step FROM c) SELECT key, round(trend, 6) AS trend, round(step, 6) AS step, round(sqrt(n * (yy - trend * ty - step * sy) / (n - 3)), 6) AS residual_sd FROM b""")
def trend_step(spark, sf_dir):
    return rounded(series.trend_step(monthly(spark, sf_dir).withColumn("v", F.ln("v")), 36), "trend", "step", "residual_sd")


_R = f"""{_S}, med AS (SELECT t, median(ln(v)) AS med FROM ser GROUP BY t), g AS (SELECT key, t, ln(v) - med AS g FROM ser JOIN med USING (t)),
res AS (SELECT key, t, CASE WHEN stddev_pop(g) OVER (PARTITION BY key) > 1e-12 THEN (g - avg(g) OVER (PARTITION BY key)) / stddev_pop(g) OVER (PARTITION BY key) ELSE 0 END AS r FROM g)"""


@query(f"WITH {_R} SELECT key, t, round(r, 6) AS r FROM res")
def residual_series(spark, sf_dir):
    return rounded(series.residual_series(monthly(spark, sf_dir)), "r")


#: The month after the last one that orders cover to its end.
_WHOLE = "(SELECT (year(max(o_orderdate) + INTERVAL 1 DAY) - 1995) * 12 + month(max(o_orderdate) + INTERVAL 1 DAY) - 1 FROM orders)"


@query(f"""WITH {_R.replace('FROM ser', f'FROM (SELECT * FROM ser WHERE t < {_WHOLE}) ser')}, cal AS (SELECT count(DISTINCT t) AS n FROM res), ok AS (SELECT key FROM res GROUP BY key HAVING count(*) = (SELECT n FROM cal)), rr AS (SELECT key::BIGINT AS key, t, r FROM res WHERE key IN (SELECT key FROM ok)), lags AS (SELECT CAST(unnest(range(-3, 4)) AS INT) AS lag),
c AS (SELECT x.key AS a, y.key AS b, lag, round(coalesce(CASE WHEN stddev_pop(x.r) > 1e-12 AND stddev_pop(y.r) > 1e-12 THEN covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r)) END, 0), 12) AS corr FROM rr x CROSS JOIN lags JOIN rr y ON y.t = x.t + lag AND x.key < y.key GROUP BY ALL)
SELECT a, b, lag, round(corr, 6) AS corr FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY corr DESC, abs(lag), lag DESC) = 1""")
def lagged_corr(spark, sf_dir):
    after = F.max(F.date_add("o_orderdate", 1)).alias("after")
    end = table(spark, sf_dir, "orders").agg(after).select(((F.year("after") - 1995) * 12 + F.month("after") - 1).alias("end"))
    months = monthly(spark, sf_dir).join(F.broadcast(end), F.col("t") < F.col("end")).drop("end")
    rows = series.residual_series(months).select(F.col("key").cast("long").alias("key"), "t", F.lit(0).alias("c"), F.col("r").alias("v"))
    return rounded(neighbours.lagged_correlation(rows, 1), "corr")


# --- outcomes by group ------------------------------------------------------------

_ETA = "SELECT round(sum(n * (m - g) ** 2) / (sum(n * (m - g) ** 2) + sum(w)), 6) AS eta2 FROM (SELECT count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM x GROUP BY c_mktsegment), (SELECT avg(y) AS g FROM x)"


@query(f"WITH x AS (SELECT c_mktsegment, c_acctbal AS y FROM customer) {_ETA}")
def eta_squared(spark, sf_dir):
    return rounded(stats.eta_squared(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"), "eta2")


@query(f"WITH x AS (SELECT c_mktsegment, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS y FROM customer) {_ETA}")
def within_region_eta(spark, sf_dir):
    return rounded(stats.eta_squared(stats.centred(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal"), "c_mktsegment", "c_acctbal"), "eta2")


@query("""WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS r FROM customer),
q AS (SELECT sum(s * s / m) AS q, count(*) AS k, sum(m) AS n FROM (SELECT sum(r) AS s, count(*) AS m FROM r GROUP BY g)), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT count(*) AS c FROM customer GROUP BY c_acctbal))
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::DOUBLE ** 3 - n)), 6) AS h, k, CAST(n AS BIGINT) AS n FROM q, t""")
def kruskal_h(spark, sf_dir):
    return rounded(stats.kruskal_h(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"), "h")


@query("""WITH v AS (SELECT n_nationkey AS id, (n_nationkey + 1) * (n_nationkey + 1) / 2000.0::DOUBLE AS p FROM nation), r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p AS raw FROM v)
SELECT id, round(p, 6) AS p, round(least(1.0, max(raw) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""")
def holm(spark, sf_dir):
    n = F.col("n_nationkey") + 1
    return rounded(stats.holm(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (n * n / F.lit(2000.0)).alias("p"))), "p", "adjusted")


@query("""WITH e AS (SELECT c_nationkey AS region, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS e FROM customer)
SELECT region, count(*) AS n, round(sum(e * e), 2) AS sse, round(var_samp(e), 2) AS variance FROM e GROUP BY region""")
def region_error_sums(spark, sf_dir):
    errors = stats.centred(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").withColumnRenamed("c_nationkey", "region")
    return stats.region_error_sums(errors, "region", "c_acctbal").withColumns({c: F.round(c, 2) for c in ("sse", "variance")})
