"""Queries of neighbour graphs, layers and graphs of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import graph, neighbours
from panelloom.plans.queries import _G, knn_edges, labels, vectors
from panelloom.plans.registry import query, rounded, table
from panelloom.sources.shared import materialize

# --- places: one per nation, strewn over the globe by its key ---------------------

_PLACES = """pl AS (SELECT n_nationkey AS id, n_regionkey AS region, (n_nationkey * 37 % 140 - 70)::DOUBLE AS lat, (n_nationkey * 83 % 340 - 170)::DOUBLE AS lon FROM nation),
gc AS (SELECT a.id AS src, b.id AS dst, 2 * 6371.0088 * asin(sqrt(least(1.0, sin((radians(b.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin((radians(b.lon) - radians(a.lon)) / 2) ** 2))) AS distance FROM pl a JOIN pl b ON a.id < b.id),
road AS (SELECT src, dst, CASE WHEN distance < 9000 THEN distance ELSE 'inf'::DOUBLE END AS distance FROM gc), way AS (SELECT src, dst, distance FROM road UNION ALL SELECT dst, src, distance FROM road),
nr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM way WHERE distance < 'inf'::DOUBLE QUALIFY rank <= 4), sg AS (SELECT median(distance) FILTER (WHERE distance > 0) AS s FROM nr),
re AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(exp(-((distance / s) ** 2) / 2)) AS weight FROM nr, sg GROUP BY 1, 2)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.cast("long").alias("id"), F.col("n_regionkey").alias("region"), (key * 37 % 140 - 70).cast("double").alias("lat"), (key * 83 % 340 - 170).cast("double").alias("lon"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = places(spark, sf_dir), places(spark, sf_dir)
    pairs = a.select(F.col("id").alias("src"), F.col("lat").alias("la"), F.col("lon").alias("oa")).join(b.select(F.col("id").alias("dst"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), F.col("src") < F.col("dst"))
    return pairs.select("src", "dst", neighbours.great_circle(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")).alias("distance"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).withColumn("distance", F.when(F.col("distance") < 9000, F.col("distance")).otherwise(float("inf")))


@query(f"WITH {_PLACES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(distance, 6) AS distance FROM gc")
def great_circle_distances(spark, sf_dir):
    return rounded(distances(spark, sf_dir), "distance")


@query(f"WITH {_PLACES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(weight, 6) AS weight FROM re")
def road_knn_graph(spark, sf_dir):
    return rounded(neighbours.road_knn(roads(spark, sf_dir), 4), "weight")


@query(f"""WITH {_PLACES}, one AS (SELECT src, dst, distance * (1 + src / 50.0::DOUBLE) AS distance FROM way), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM one WHERE distance < 'inf'::DOUBLE QUALIFY rank <= 3),
s2 AS (SELECT coalesce(median(distance) FILTER (WHERE distance > 0), 1.0) AS s FROM nn)
SELECT CAST(least(src, dst) AS BIGINT) AS src, CAST(greatest(src, dst) AS BIGINT) AS dst, round(max(exp(-((distance / s) ** 2) / 2)), 6) AS weight FROM nn, s2 GROUP BY 1, 2""")
def distance_knn_graph(spark, sf_dir):
    way = neighbours.both_ways(roads(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), "distance"), "distance", "distance")
    return rounded(neighbours.distance_knn(way.withColumn("distance", F.col("distance") * (1 + F.col("src") / 50)), 3), "weight")


_COS = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
cs AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.x, b.x) AS similarity FROM u a JOIN u b ON a.id <> b.id),
ck AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM cs QUALIFY rank <= 10)"""


@query(f"WITH {_COS} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(similarity), 6) AS weight FROM ck WHERE similarity > 0 GROUP BY 1, 2")
def cosine_knn_graph(spark, sf_dir):
    return rounded(neighbours.cosine_knn(vectors(spark, sf_dir), 10), "weight")


@query("""SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.col("embedding").cast("array<double>").alias("x"))
    b = a.select(F.col("src").alias("dst"), F.col("x").alias("y"))
    return rounded(a.join(b, F.col("dst") == F.col("src") + 1).select("src", "dst", neighbours.cosine(F.col("x"), F.col("y")).alias("similarity")), "similarity")


@query("""WITH s AS (SELECT o_custkey % 60 AS src, o_orderkey % 60 AS dst, sum(o_totalprice) - 300000 AS similarity FROM orders WHERE o_custkey % 60 <> o_orderkey % 60 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM s QUALIFY rank <= 5)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(similarity), 2) AS weight FROM k WHERE similarity > 0 GROUP BY 1, 2""")
def similarity_knn_graph(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 60).alias("src"), (F.col("o_orderkey") % 60).alias("dst")).agg((F.sum("o_totalprice") - 300000).alias("similarity"))
    return rounded(neighbours.similarity_knn(s, 5), "weight", places=2)


_CLIQUE = "cl AS (SELECT a.id AS src, b.id AS dst, 1 / (n - 1) AS weight FROM (SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM l) a JOIN l b ON a.cluster = b.cluster AND a.id < b.id)"


@query(f"WITH {_G}, {_CLIQUE} SELECT src, dst, round(weight, 6) AS weight FROM cl")
def same_region_graph(spark, sf_dir):
    return rounded(neighbours.same_region(labels(spark, sf_dir).withColumnRenamed("cluster", "region")), "weight")


@query(f"""WITH {_G}, {_CLIQUE}, nn AS (SELECT count(*)::DOUBLE AS n_all FROM l), x AS (SELECT src, dst, 0.25 * weight * n_all / (2 * (SELECT sum(weight) FROM e)) AS w FROM e, nn UNION ALL SELECT src, dst, 0.75 * weight * n_all / (2 * (SELECT sum(weight) FROM cl)) FROM cl, nn)
SELECT src, dst, round(sum(w), 6) AS weight FROM x GROUP BY ALL""")
def layer_mix(spark, sf_dir):
    n = labels(spark, sf_dir).count()
    clique = neighbours.same_region(labels(spark, sf_dir).withColumnRenamed("cluster", "region"))
    return rounded(neighbours.mix_layers(knn_edges(spark, sf_dir), clique, 0.25, n), "weight")


@query(f"WITH {_G} SELECT src, dst, round(weight / (2 * (SELECT sum(weight) FROM e)) * 1000, 6) AS weight FROM e")
def layer_unit_total(spark, sf_dir):
    return neighbours.unit_total(knn_edges(spark, sf_dir)).select("src", "dst", F.round(F.col("weight") * 1000, 6).alias("weight"))


_RADIUS = 0.05


@query(f"""WITH p AS (SELECT c_custkey AS id, c_custkey * 7919 % 10007 / 10007.0::DOUBLE AS x, c_custkey * 104729 % 10009 / 10009.0::DOUBLE AS y FROM customer),
d AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id < b.id) SELECT src, dst, round(exp(-((d / {_RADIUS}) ** 2)), 6) AS weight FROM d WHERE d <= {_RADIUS}""")
def geometric_graph(spark, sf_dir):
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(key.alias("id"), (key * 7919 % 10007 / F.lit(10007.0)).alias("x"), (key * 104729 % 10009 / F.lit(10009.0)).alias("y"))
    return rounded(neighbours.geometric(points, _RADIUS), "weight")


@query(f"""WITH {_G}, st AS (SELECT src, sum(weight) AS s FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src)
SELECT e.src, e.dst, round(weight / sqrt(a.s * z.s), 6) AS weight FROM e JOIN st a ON a.src = e.src JOIN st z ON z.src = e.dst""")
def normalised_adjacency(spark, sf_dir):
    return rounded(neighbours.normalised_adjacency(knn_edges(spark, sf_dir)), "weight")


@query(f"""WITH {_G}, pr AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) AS a, row_number() OVER (PARTITION BY cluster ORDER BY md5(id::VARCHAR || ':7'), id) AS z FROM l),
mv AS (SELECT x.id, y.id AS t FROM pr x JOIN pr y ON x.cluster = y.cluster AND x.a = y.z) SELECT least(x.t, y.t) AS src, greatest(x.t, y.t) AS dst, round(weight, 6) AS weight FROM e JOIN mv x ON x.id = src JOIN mv y ON y.id = dst""")
def permuted_graph(spark, sf_dir):
    return rounded(neighbours.permute_within(knn_edges(spark, sf_dir), labels(spark, sf_dir).withColumnRenamed("cluster", "group"), 7), "weight")


@query(f"""WITH {_G}, w2 AS (SELECT d.src, d.dst, d.distance, row_number() OVER (PARTITION BY d.src ORDER BY distance, d.dst) AS rank FROM d JOIN l a ON a.id = d.src JOIN l z ON z.id = d.dst AND a.cluster = z.cluster QUALIFY rank <= 5)
SELECT src, dst, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM w2""")
def masked_neighbours(spark, sf_dir):
    return rounded(neighbours.knn_within(vectors(spark, sf_dir), labels(spark, sf_dir).withColumnRenamed("cluster", "group"), 5), "distance")


@query(f"""WITH {_G}, mean AS (SELECT a.cluster, d.src AS id, sum(distance) / (count(*) + 1) AS distance FROM d JOIN l a ON a.id = d.src JOIN l z ON z.id = d.dst AND a.cluster = z.cluster GROUP BY ALL)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 12), id) AS INT) AS rank, id, round(distance, 6) AS distance FROM mean QUALIFY rank <= 3""")
def central_members(spark, sf_dir):
    return rounded(neighbours.central_members(vectors(spark, sf_dir), labels(spark, sf_dir), 3), "distance")


@query(f"""WITH {_G}, y AS (SELECT vec_id AS id, embedding[1]::DOUBLE + vec_id % 7 AS y FROM embeddings), pm AS (SELECT src AS id, median(y) AS p FROM k JOIN y ON y.id = dst GROUP BY src)
SELECT id, round(p, 6) AS peer_reference, round(abs(p - y), 6) AS discrepancy FROM pm JOIN y USING (id)""")
def peer_concordance(spark, sf_dir):
    outcomes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") + F.col("vec_id") % 7).alias("y"))
    return rounded(neighbours.peer_concordance(graph.knn(vectors(spark, sf_dir), 15), outcomes), "peer_reference", "discrepancy")


@query(f"""WITH {_G}, tr AS (SELECT vec_id AS id, label AS type, 10 + vec_id % 9 AS level FROM embeddings), f AS (SELECT unnest([1.1, 1.25, 1.5, 2.0])::DOUBLE AS factor),
q AS (SELECT src, factor, dst, k.rank, a.type = z.type AND a.level / z.level >= 1 / factor AND a.level / z.level <= factor AS fits FROM k JOIN tr a ON a.id = src JOIN tr z ON z.id = dst CROSS JOIN f)
SELECT src, factor, count(*) FILTER (WHERE fits) AS n_eligible, arg_min(dst, rank) FILTER (WHERE fits) AS first FROM q GROUP BY ALL""")
def analogue_screen(spark, sf_dir):
    traits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), (10 + F.col("vec_id") % 9).alias("level"))
    return neighbours.analogues(graph.knn(vectors(spark, sf_dir), 15), traits)


# --- half-yearly sales of nations by market segment -------------------------------

_H = """h0 AS (SELECT c_nationkey::BIGINT AS key, CAST((year(o_orderdate) - 1995) * 2 + (month(o_orderdate) - 1) // 6 AS INT) AS t, c_mktsegment AS c, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL),
hs AS (SELECT * FROM h0 WHERE key IN (SELECT key FROM h0 GROUP BY key HAVING count(*) = (SELECT count(DISTINCT (t, c)) FROM h0)))"""


def half_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, t, c, v`` of the nations that lack no cell."""
    half = ((F.year("o_orderdate") - 1995) * 2 + F.floor((F.month("o_orderdate") - 1) / 6)).cast("int")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"), half.alias("t"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("key"), F.col("c_mktsegment").alias("c"))
    cells = orders.join(customers, "c_custkey").groupBy("key", "t", "c").agg(F.sum("o_totalprice").alias("v"))
    n = cells.agg(F.count_distinct("t", "c").alias("n"))
    full = cells.groupBy("key").agg(F.count("*").alias("own")).crossJoin(F.broadcast(n)).where("own = n").select("key")
    return cells.join(full, "key", "left_semi")


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln v less the cell's median, then each series' mean and deviation."""
    from pyspark.sql import Window

    rows = half_yearly(spark, sf_dir)
    median = rows.groupBy("t", "c").agg(F.median(F.ln("v")).alias("med"))
    gaps = rows.join(median, ["t", "c"]).select("key", "t", "c", (F.ln("v") - F.col("med")).alias("g"))
    own = Window.partitionBy("key", "c")
    sd = F.stddev_pop("g").over(own)
    return gaps.select("key", "t", "c", F.when(sd > 1e-12, (F.col("g") - F.avg("g").over(own)) / sd).otherwise(0.0).alias("v"))


_HR = f"""{_H}, hm AS (SELECT t, c, median(ln(v)) AS med FROM hs GROUP BY t, c), hg AS (SELECT key, t, c, ln(v) - med AS g FROM hs JOIN hm USING (t, c)),
hr AS (SELECT key, t, c, CASE WHEN stddev_pop(g) OVER (PARTITION BY key, c) > 1e-12 THEN (g - avg(g) OVER (PARTITION BY key, c)) / stddev_pop(g) OVER (PARTITION BY key, c) ELSE 0 END AS v FROM hg)"""

_LAG = f"""{_HR}, lg AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS lag),
pc AS (SELECT x.key AS a, y.key AS b, lag, x.c, coalesce(CASE WHEN stddev_pop(x.v) > 1e-12 AND stddev_pop(y.v) > 1e-12 THEN covar_pop(x.v, y.v) / (stddev_pop(x.v) * stddev_pop(y.v)) END, 0) AS r FROM hr x CROSS JOIN lg JOIN hr y ON y.t = x.t + lag AND x.c = y.c AND x.key < y.key GROUP BY ALL),
mc AS (SELECT a, b, lag, round(avg(r), 12) AS corr FROM pc GROUP BY ALL), lb AS (SELECT * FROM mc QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY corr DESC, abs(lag), lag DESC) = 1)"""


@query(f"WITH {_LAG} SELECT a, b, lag, round(corr, 6) AS corr FROM lb")
def lagged_series(spark, sf_dir):
    return rounded(neighbours.lagged_correlation(residuals(spark, sf_dir), 5, 2), "corr")


@query(f"""WITH {_H}, tm AS (SELECT t, c, median(v) AS med FROM hs GROUP BY t, c), tg AS (SELECT key, t, c, v - med AS g FROM hs JOIN tm USING (t, c)), tc AS (SELECT key, t, c, g - avg(g) OVER (PARTITION BY key, c) AS g FROM tg),
tu AS (SELECT key, t, c, g / sqrt(sum(g * g) OVER (PARTITION BY key)) AS u FROM tc), ts AS (SELECT x.key AS src, y.key AS dst, least(1, greatest(0, sum(x.u * y.u))) AS s FROM tu x JOIN tu y ON x.t = y.t AND x.c = y.c AND x.key <> y.key GROUP BY ALL),
tk AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 4) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(s), 6) AS weight FROM tk WHERE s > 0 GROUP BY 1, 2""")
def trajectory_graph(spark, sf_dir):
    return rounded(neighbours.trajectory_knn(half_yearly(spark, sf_dir), 4), "weight")


#: Row by row: the costs of one step of the first series against all of the second.
_DTW = f"""{_HR}, sv AS (SELECT key, t + 1 AS p, list(v ORDER BY c) AS x FROM hr GROUP BY ALL), sl AS (SELECT key, list(x ORDER BY p) AS s FROM sv GROUP BY key),
dp AS (SELECT x.key AS a, y.key AS b, x.s AS x, y.s AS y, 0::BIGINT AS p, list_concat([0.0::DOUBLE], list_transform(range(len(y.s)), lambda q: 'inf'::DOUBLE)) AS prev FROM sl x JOIN sl y ON x.key < y.key
 UNION ALL SELECT a, b, x, y, p + 1, list_reduce(range(1, len(y) + 1), lambda acc, q: list_append(acc, CASE WHEN abs(q - p - 1) <= 2 THEN list_sum(list_transform(list_zip(x[p + 1], y[q]), lambda z: (z[1] - z[2]) ** 2)) + least(acc[len(acc)], prev[q + 1], prev[q]) ELSE 'inf'::DOUBLE END), ['inf'::DOUBLE]) FROM dp WHERE p < len(x)),
dt AS (SELECT a, b, sqrt(prev[len(prev)]) AS distance FROM dp WHERE p = len(x))"""


@query(f"WITH RECURSIVE {_DTW} SELECT a, b, round(distance, 6) AS distance FROM dt")
def dtw_distances(spark, sf_dir):
    return rounded(neighbours.dtw(residuals(spark, sf_dir), 5, 2), "distance")


@query(f"""WITH RECURSIVE {_DTW}, {_LAG.replace(_HR + ', ', '')},
an AS (SELECT key, c, median(ln(v)) AS x FROM hs GROUP BY ALL), ad AS (SELECT x.key AS src, y.key AS dst, sqrt(sum((x.x - y.x) ** 2)) AS d FROM an x JOIN an y USING (c) WHERE x.key <> y.key GROUP BY ALL),
dw AS (SELECT a AS src, b AS dst, distance AS d FROM dt UNION ALL SELECT b, a, distance FROM dt), lw AS (SELECT a AS src, b AS dst, corr AS s FROM lb UNION ALL SELECT b, a, corr FROM lb),
ru AS (SELECT DISTINCT 'profile' AS rule, least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 4)
 UNION ALL SELECT DISTINCT 'dtw', least(src, dst), greatest(src, dst) FROM (SELECT * FROM dw QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 4)
 UNION ALL SELECT DISTINCT 'lagged', least(src, dst), greatest(src, dst) FROM (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 4) WHERE s > 0),
sz AS (SELECT rule, count(*) AS n FROM ru GROUP BY rule), cm AS (SELECT x.rule AS a, y.rule AS b, count(*) AS n FROM ru x JOIN ru y ON x.src = y.src AND x.dst = y.dst AND x.rule < y.rule GROUP BY ALL)
SELECT x.rule AS a, y.rule AS b, x.n AS n_a, y.n AS n_b, round(coalesce(cm.n, 0) / (x.n + y.n - coalesce(cm.n, 0)), 6) AS jaccard FROM sz x JOIN sz y ON x.rule < y.rule LEFT JOIN cm ON cm.a = x.rule AND cm.b = y.rule""")
def edge_rules(spark, sf_dir):
    series = materialize(residuals(spark, sf_dir), "series")
    annual = half_yearly(spark, sf_dir).groupBy("key", "c").agg(F.median(F.ln("v")).alias("v")).withColumn("t", F.lit(0))
    rules = {
        "profile": graph.gaussian(graph.knn(neighbours.series_vectors(annual), 4)),
        "dtw": neighbours.distance_knn(neighbours.both_ways(neighbours.dtw(series, 5, 2), "distance", "distance"), 4),
        "lagged": neighbours.similarity_knn(neighbours.both_ways(neighbours.lagged_correlation(series, 5, 2), "corr", "similarity"), 4),
    }
    return rounded(neighbours.compare_rules(rules), "jaccard")


@query(f"""WITH {_H}, mv AS (SELECT key, t, c, ln(v) AS x FROM hs), an AS (SELECT key, c, median(x) AS x FROM mv GROUP BY ALL),
ad AS (SELECT x.key AS src, y.key AS dst, sqrt(sum((x.x - y.x) ** 2)) AS d FROM an x JOIN an y USING (c) WHERE x.key <> y.key GROUP BY ALL), pool AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM ad QUALIFY place <= 8),
md AS (SELECT x.t, x.key AS src, y.key AS dst, sqrt(sum((x.x - y.x) ** 2)) AS d FROM mv x JOIN mv y ON x.c = y.c AND x.t = y.t AND x.key <> y.key GROUP BY ALL),
vt AS (SELECT src, dst, count(*) AS votes FROM (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY t, src ORDER BY d, dst) <= 3) GROUP BY ALL)
SELECT src, dst, round(coalesce(votes, 0) / (SELECT count(DISTINCT t) FROM mv), 6) AS frequency, CAST(row_number() OVER (PARTITION BY src ORDER BY coalesce(votes, 0) DESC, d, place) AS INT) AS rank FROM pool LEFT JOIN vt USING (src, dst) QUALIFY rank <= 3""")
def consensus_peers(spark, sf_dir):
    rows = materialize(half_yearly(spark, sf_dir).withColumn("v", F.ln("v")), "sales")
    annual = neighbours.series_vectors(rows.groupBy("key", "c").agg(F.median("v").alias("v")).withColumn("t", F.lit(0)))
    monthly = rows.groupBy(F.col("key").alias("id"), F.col("t").alias("period")).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("x")).select("id", "period", F.transform("x", lambda y: y["v"]).alias("vector"))
    return rounded(neighbours.consensus_peers(annual, monthly, 3, 8), "frequency")


@query(f"""WITH {_LAG}, an AS (SELECT key, c, median(ln(v)) AS x FROM hs GROUP BY ALL), ad AS (SELECT x.key AS src, y.key AS dst, sqrt(sum((x.x - y.x) ** 2)) AS d FROM an x JOIN an y USING (c) WHERE x.key <> y.key GROUP BY ALL),
pk AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 4), pg AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(exp(-((d / s) ** 2) / 2)) AS w FROM pk, (SELECT median(d) FILTER (WHERE d > 0) AS s FROM pk) GROUP BY 1, 2),
lw AS (SELECT a AS src, b AS dst, corr AS s FROM lb UNION ALL SELECT b, a, corr FROM lb), cg AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(s) AS w FROM (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 4) WHERE s > 0 GROUP BY 1, 2),
mx AS (SELECT src, dst, 0.5 * w / (2 * (SELECT sum(w) FROM pg)) AS w FROM pg UNION ALL SELECT src, dst, 0.5 * w / (2 * (SELECT sum(w) FROM cg)) FROM cg) SELECT src, dst, round(sum(w), 6) AS weight FROM mx GROUP BY ALL""")
def multiplex_layers(spark, sf_dir):
    annual = half_yearly(spark, sf_dir).groupBy("key", "c").agg(F.median(F.ln("v")).alias("v")).withColumn("t", F.lit(0))
    profile = graph.gaussian(graph.knn(neighbours.series_vectors(annual), 4))
    moves = neighbours.similarity_knn(neighbours.both_ways(neighbours.lagged_correlation(residuals(spark, sf_dir), 5, 2), "corr", "similarity"), 4)
    return rounded(neighbours.mix_layers(profile, moves, 0.5), "weight")
