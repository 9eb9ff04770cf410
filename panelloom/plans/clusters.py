"""Queries of clusterings; those that start from random numbers have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import clustering, leiden, models, network
from panelloom.plans.queries import _G, knn_edges, labels, vectors
from panelloom.plans.registry import query, rounded
from panelloom.sources.shared import materialize

K, ROUNDS = 4, 3
_START = f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, x FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT {K}))"


def _round(i: int) -> str:
    """One round of assignment and averages in SQL."""
    return f"""a{i} AS (SELECT id, x, cluster, d FROM (SELECT p.id, p.x, c.cluster, list_distance(p.x, c.x) AS d, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.x, c.x), c.cluster) AS r FROM p, c{i} c) WHERE r = 1),
c{i + 1} AS (SELECT cluster, list(m ORDER BY dim) AS x FROM (SELECT cluster, dim, avg(v) AS m FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a{i}) GROUP BY ALL) GROUP BY cluster)"""


@query(f"WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), {_START}, {', '.join(_round(i) for i in range(ROUNDS + 1))} SELECT cluster::INTEGER AS cluster, count(*) AS n, sum(id)::BIGINT AS ids, round(sum(d * d), 6) AS squares FROM a{ROUNDS} GROUP BY cluster")
def lloyd_rounds(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    start = [list(r["vector"]) for r in rows.orderBy("id").limit(K).collect()]
    found, centres, _ = clustering.lloyd(rows, start, ROUNDS)
    to = clustering.nearest(F.col("vector"), centres)
    summed = rows.select("id", to.alias("to")).groupBy("to.cluster").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.col("to.distance") ** 2).alias("squares"))
    return rounded(summed, "squares")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_edges(spark, sf_dir).select("src", "dst", "weight")


@query(f"""WITH {_G}, sq AS (SELECT cluster, dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT sum(q - s * s / n) / (SELECT sum(t) FROM (SELECT sum(q) - sum(s) * sum(s) / sum(n) AS t FROM sq GROUP BY dim)) AS sse FROM sq),
u AS (SELECT coalesce(sum(weight) FILTER (a.cluster <> z.cluster), 0) / sum(weight) AS cut FROM e JOIN l a ON src = a.id JOIN l z ON dst = z.id)
SELECT round(sse + 0.25 * cut, 6) AS objective, round(sse, 6) AS sse_share, round(cut, 6) AS cut_share FROM t, u""")
def joint_objective(spark, sf_dir):
    return rounded(clustering.joint_objective(vectors(spark, sf_dir), links(spark, sf_dir), labels(spark, sf_dir), 0.25), "objective", "sse_share", "cut_share")


@query("""WITH v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
z AS (SELECT id, dim, coalesce((x - avg(x) OVER d) / nullif(stddev_pop(x) OVER d, 0), 0) AS z FROM v WINDOW d AS (PARTITION BY dim)), n AS (SELECT sqrt(sum(z * z)) AS n FROM z)
SELECT id, (dim - 1)::INTEGER AS dim, round(z / n, 6) AS x FROM z, n""")
def standard_block(spark, sf_dir):
    return rounded(clustering.block(vectors(spark, sf_dir)).select("id", F.posexplode("vector").alias("dim", "x")), "x")


@query("""WITH s AS (SELECT vec_id AS id, label AS cluster, CASE WHEN label % 3 = 0 THEN vec_id % 4 WHEN label % 3 = 1 THEN NULL END AS sub FROM embeddings),
n AS (SELECT cluster, sub, count(*) AS n, min(id) AS first FROM s WHERE sub IS NOT NULL GROUP BY cluster, sub), g AS (SELECT cluster, sub, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS place FROM n)
SELECT id, cluster || CASE WHEN cluster % 3 = 2 THEN '' ELSE '.' || coalesce(place, 0) END AS type FROM s LEFT JOIN g USING (cluster, sub)""")
def two_level_types(spark, sf_dir):
    level = labels(spark, sf_dir)
    splits = level.where("cluster % 3 < 2").withColumn("sub", F.when(F.col("cluster") % 3 == 0, F.col("id") % 4))
    return leiden.composed(level, splits)


@query(f"""WITH {_G}, mc AS (SELECT cluster, dim, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL), tot AS (SELECT sum(t) AS t FROM (SELECT sum(x * x) - sum(x) * sum(x) / count(*) AS t FROM v GROUP BY dim)), mass AS (SELECT sum(weight) AS mass FROM e),
gap AS (SELECT v.id, v.cluster AS here, mc.cluster AS c, mc.n, sum((x - mean) ** 2) AS gap FROM v JOIN mc ON v.dim = mc.dim GROUP BY ALL), lk AS (SELECT x.src AS id, l.cluster AS c, sum(weight) AS w FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) x JOIN l ON x.dst = l.id GROUP BY ALL),
g AS (SELECT gap.*, coalesce(w, 0) AS w FROM gap LEFT JOIN lk USING (id, c)), own AS (SELECT id, gap * n / (n - 1) AS leave, w AS kept FROM g WHERE c = here AND n > 1),
ch AS (SELECT g.id, here, c, (gap * n / (n + 1) - leave) / t + 0.25 * (kept - w) / mass AS change FROM g JOIN own USING (id), tot, mass WHERE c <> here)
SELECT id, here AS cluster, c AS "to", round(change, 9) AS change FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY change, c) = 1""")
def best_moves(spark, sf_dir):
    return rounded(models.best_moves(vectors(spark, sf_dir), links(spark, sf_dir), labels(spark, sf_dir), 0.25), "change", places=9)


@query(f"""WITH {_G}, sh AS (SELECT id, c, CASE WHEN cluster = c THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END AS s FROM l, (SELECT unnest(range(10)) AS c)), bw AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), vol AS (SELECT sum(weight) AS vol FROM bw),
ins AS (SELECT sum(weight * a.s * z.s) AS ins FROM bw JOIN sh a ON src = a.id JOIN sh z ON dst = z.id AND z.c = a.c), dg AS (SELECT src AS id, sum(weight) AS deg FROM bw GROUP BY src),
pc AS (SELECT c, sum(coalesce(deg, 0) * s) AS vc, sum(s) AS size FROM sh LEFT JOIN dg USING (id) GROUP BY c), o AS (SELECT sum(vc * vc) AS vv, sqrt(sum(size * size)) AS norm, sum(size) AS n FROM pc)
SELECT round(vv / (vol * vol) - ins / vol + norm * sqrt(10) / n - 1, 6) AS loss, round(vv / (vol * vol) - ins / vol, 6) AS spectral, round(norm * sqrt(10) / n - 1, 6) AS collapse FROM ins, vol, o""")
def soft_modularity(spark, sf_dir):
    share = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when(c == F.col("cluster"), 0.91).otherwise(0.01))
    return rounded(models.soft_modularity(labels(spark, sf_dir).select("id", share.alias("share")), links(spark, sf_dir)), "loss", "spectral", "collapse")


_SEEDS = (1, 2, 3)


@query(f"""WITH r AS (SELECT s AS seed, vec_id AS id, (label + (vec_id % (s + 2) = 0)::INT) % (8 + s) AS cluster FROM embeddings, (SELECT unnest({list(_SEEDS)}) AS s)),
n AS (SELECT a.seed AS seed_a, b.seed AS seed_b, a.cluster AS x, b.cluster AS y, count(*) AS n FROM r a JOIN r b USING (id) WHERE a.seed < b.seed GROUP BY ALL),
s AS (SELECT seed_a, seed_b, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n GROUP BY ALL), sa AS (SELECT seed_a, seed_b, sum(m * (m - 1) / 2) AS sa FROM (SELECT seed_a, seed_b, x, sum(n) AS m FROM n GROUP BY ALL) GROUP BY ALL), sb AS (SELECT seed_a, seed_b, sum(m * (m - 1) / 2) AS sb FROM (SELECT seed_a, seed_b, y, sum(n) AS m FROM n GROUP BY ALL) GROUP BY ALL)
SELECT seed_a::BIGINT AS seed_a, seed_b::BIGINT AS seed_b, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s JOIN sa USING (seed_a, seed_b) JOIN sb USING (seed_a, seed_b)""")
def seed_agreement(spark, sf_dir):
    rows = labels(spark, sf_dir).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in _SEEDS])))
    moved = (F.col("cluster") + (F.col("id") % (F.col("seed") + 2) == 0).cast("int")) % (8 + F.col("seed"))
    return rounded(leiden.seed_agreement(rows.select("seed", "id", moved.alias("cluster"))), "ari")


@query(None)
def kmeans_profiles(spark, sf_dir):
    return clustering.kmeans(vectors(spark, sf_dir), K, seeds=tuple(range(5)))[0]


@query(None)
def mixture_profiles(spark, sf_dir):
    return clustering.gaussian_mixture(vectors(spark, sf_dir), K)[0]


@query(None)
def ward_profiles(spark, sf_dir):
    return clustering.ward_in_rounds(vectors(spark, sf_dir), K)


@query(None)
def spectral_profiles(spark, sf_dir):
    return clustering.spectral(materialize(links(spark, sf_dir), "edges"), labels(spark, sf_dir), K)


@query(None)
def features_and_network(spark, sf_dir):
    return clustering.features_and_network(vectors(spark, sf_dir), materialize(links(spark, sf_dir), "edges"), K, seeds=(1, 2))[0]


@query(None)
def graph_regularised(spark, sf_dir):
    return clustering.graph_regularised(vectors(spark, sf_dir), links(spark, sf_dir), labels(spark, sf_dir))


@query(None)
def gap_statistic(spark, sf_dir):
    return clustering.gap_statistic(vectors(spark, sf_dir), [1, 2, 3, 4], references=4, starts=2)


@query(None)
def tuned_prototypes(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    start = [list(r["vector"]) for r in rows.orderBy("id").limit(K).collect()]
    _, centres, _ = clustering.lloyd(rows, start)
    centres, biases, _ = models.tuned_prototypes(rows, centres, least=5)
    return rows.select("id", clustering.nearest(F.col("vector"), centres, biases)["cluster"].alias("cluster"))


@query(None)
def leiden_consensus(spark, sf_dir):
    return leiden.consensus(links(spark, sf_dir), 1.0, [1, 2, 3], least=10)[0]


@query(None)
def temporal_leiden(spark, sf_dir):
    edges = materialize(links(spark, sf_dir), "edges")
    months = edges.withColumn("period", F.explode(F.array(*map(F.lit, ("2023-01-01", "2023-02-01", "2023-03-01")))))
    slices = months.withColumn("weight", F.col("weight") * (1 + F.month("period") / 10))
    return leiden.temporal_leiden(slices, 1.0, leiden.interslice_weight(slices, "2023-02-01", 0.1), 1729)




@query(None)
def network_communities(spark, sf_dir):
    """Communities of a graph network after all its epochs; what it learns is tested on planted groups."""
    found, _ = network.GraphNetwork(vectors(spark, sf_dir), links(spark, sf_dir)).fit(K)
    return found.select("id", "cluster", F.array_max("share").alias("share"))
