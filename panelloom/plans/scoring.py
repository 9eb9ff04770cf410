"""Queries of frozen models over the panel of brands by month of shipment."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import scoring
from panelloom.plans.queries import vectors
from panelloom.plans.registry import query, rounded, table
from panelloom.sources import files, loaders, sinks
from panelloom.sources.shared import materialize, shared_dir

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAMES = ["c1", "c2", "c3", "c4", "c5"]
#: A model as another fit would have left it.
SCALER = {"mode": "log_ratios_to_total", "ratio_center": [-1.7, -1.72, -1.71, -1.7, -1.73], "ratio_iqr": [0.5, 0.6, 0.55, 0.45, 0.65]}
CENTRES = [[0.1, 0.0, -0.1, 0.05, 0.0], [-0.2, 0.1, 0.1, 0.0, 0.1], [0.15, -0.2, 0.0, 0.1, -0.05], [0.0, 0.2, -0.15, -0.1, 0.1]]
BIASES = [0.0, 0.02, -0.01, 0.01]
TURN = [[0.9, 0.1, 0.0, 0.0, 0.0], [-0.1, 0.9, 0.1, 0.0, 0.0], [0.0, -0.1, 0.9, 0.1, 0.0], [0.0, 0.0, -0.1, 0.9, 0.1], [0.1, 0.0, 0.0, -0.1, 0.9]]
OFFSETS = [[round(0.01 * ((m * 7 + d * 3) % 11 - 5), 6) for d in range(5)] for m in range(12)]
COHORT = [f"Brand#{i}" for i in range(1, 16)]


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, period, c1 ... c5, total`` of the brands' months in which every segment bought."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-01").alias("period"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    rows = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(parts, "l_partkey")
    wide = rows.groupBy("entity", "period").pivot("c_mktsegment", SEGMENTS).agg(F.sum("value"))
    total = sum((F.col(s) for s in SEGMENTS[1:]), F.col(SEGMENTS[0]))
    whole = wide.where(total.isNotNull())
    return whole.select("entity", "period", *[F.col(s).alias(n) for s, n in zip(SEGMENTS, NAMES, strict=True)], total.alias("total"))


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


_W = """w0 AS (SELECT p_brand AS entity, strftime(l_shipdate, '%Y-%m-01') AS period, c_mktsegment AS seg, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
wp AS (SELECT *, sum(v) OVER (PARTITION BY entity, period) AS total, dense_rank() OVER (ORDER BY seg) AS dim FROM w0 QUALIFY count(*) OVER (PARTITION BY entity, period) = 5)"""
_F = f"""{_W}, fx AS (SELECT entity, period, (dim - 1)::INT AS dim, (ln(v / total) - ({_list(SCALER['ratio_center'])})[dim]) / ({_list(SCALER['ratio_iqr'])})[dim] / sqrt(5.0::DOUBLE) AS x FROM wp),
an AS (SELECT entity, year, dim, x FROM (SELECT entity, substr(period, 1, 4)::INT AS year, dim, median(x) AS x, count(DISTINCT period) AS n FROM fx GROUP BY ALL) WHERE n = 12)"""


def _centres(name: str = "ce", values=CENTRES) -> str:
    rows = ", ".join(f"({i}, {_list(c)}, {b!r}::DOUBLE)" for i, (c, b) in enumerate(zip(values, BIASES, strict=True)))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(cluster, c, bias))"


def _near(source: str, keys: str, tag: str) -> str:
    """CTEs of distances to the centres of ``source`` (keys, dim, x)."""
    return f"""{tag}d AS (SELECT {keys}, cluster, sqrt(sum((x - c[dim + 1]) ** 2)) AS d FROM {source}, ce GROUP BY ALL), {tag} AS (SELECT {keys}, cluster, d, lead(d) OVER (PARTITION BY {keys} ORDER BY d, cluster) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY d, cluster) AS rn FROM {tag}d QUALIFY rn = 1)"""


_IN = "entity IN (" + ", ".join(f"'{c}'" for c in COHORT) + ")"
MODEL = {"scaler": SCALER, "centers": CENTRES, "ids": COHORT}


@query(f"WITH {_F}, {_centres()}, {_near('fx', 'entity, period', 'nm')} SELECT entity, period, cluster, round(d, 6) AS distance, round((s - d) / s, 6) AS margin, {_IN} AS in_reference_cohort FROM nm")
def frozen_monthly(spark, sf_dir):
    return rounded(scoring.predict_frozen(monthly_panel(spark, sf_dir), NAMES, MODEL), "distance", "margin")


@query(f"WITH {_F}, {_centres()}, {_near('an', 'entity, year', 'na')} SELECT entity, year || '-01-01' AS period, cluster, round(d, 6) AS distance, round((s - d) / s, 6) AS margin, {_IN} AS in_reference_cohort FROM na")
def frozen_annual(spark, sf_dir):
    return rounded(scoring.predict_frozen(monthly_panel(spark, sf_dir), NAMES, MODEL, "annual"), "distance", "margin")


_LEVEL = {**SCALER, "level_weight": 0.2, "level_center": 13.0, "level_iqr": 0.9}


@query(f"WITH {_F} SELECT entity, period, dim, round(sqrt(0.8) * x, 6) AS x FROM fx UNION ALL SELECT entity, period, 5, round(sqrt(0.2) * (ln(any_value(total)) - 13.0) / 0.9, 6) FROM wp GROUP BY entity, period")
def frozen_level(spark, sf_dir):
    return rounded(scoring.frozen_features(monthly_panel(spark, sf_dir), NAMES, _LEVEL), "x")


@query(f"WITH {_W}, t AS (SELECT DISTINCT entity, period, total FROM wp WHERE period <= '1997-12-01') SELECT round(median(ln(total)), 6) AS level_center, round(quantile_cont(ln(total), 0.75) - quantile_cont(ln(total), 0.25), 6) AS level_iqr FROM t")
def level_scaler(spark, sf_dir):
    return rounded(scoring.level_scaler(monthly_panel(spark, sf_dir), "1997-12-01"), "level_center", "level_iqr")


@query(f"WITH {_W} SELECT 'c' || dim AS category, round(median(ln(v / total)), 6) AS center, round(quantile_cont(ln(v / total), 0.75) - quantile_cont(ln(v / total), 0.25), 6) AS iqr FROM wp WHERE period <= '1997-12-01' GROUP BY dim")
def ratio_scaler(spark, sf_dir):
    return rounded(scoring.ratio_scaler(monthly_panel(spark, sf_dir), NAMES, "1997-12-01"), "center", "iqr")


def _times(source: str, keys: str, matrix, out: str) -> str:
    """A CTE of row vectors (keys, dim, x) times a matrix."""
    rows = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, r in enumerate(matrix) for j, v in enumerate(r))
    return f"{out} AS (SELECT {keys}, j AS dim, sum(x * v) AS x FROM {source} JOIN (VALUES {rows}) t(i, j, v) ON dim = i GROUP BY {keys}, j)"


ARTIFACT = {"scaler": SCALER, "pre_aggregation_transform": TURN, "rule": {"transform": np.array(TURN).T.tolist(), "centers": CENTRES, "biases": BIASES}}


@query(f"""WITH {_F}, {_centres()}, {_times('fx', 'entity, period', TURN, 'mv')}, a7 AS (SELECT entity, dim, median(x) AS x, count(DISTINCT period) AS n FROM mv WHERE period LIKE '1997%' GROUP BY ALL), aw AS (SELECT entity, dim, x FROM a7 WHERE n = 12), {_times('aw', 'entity', np.array(TURN).T, 'ar')},
sc AS (SELECT entity, cluster, sum((x - c[dim + 1]) ** 2) + any_value(bias) AS s FROM ar, ce GROUP BY ALL) SELECT entity, 1997 AS year, cluster FROM sc QUALIFY row_number() OVER (PARTITION BY entity ORDER BY s, cluster) = 1""")
def frontier_annual(spark, sf_dir):
    return scoring.predict_frontier(monthly_panel(spark, sf_dir), NAMES, ARTIFACT, 1997)


_ID = ", ".join(f"({m + 1}, {d}, {OFFSETS[m][d]!r}::DOUBLE)" for m in range(12) for d in range(5))


@query(f"""WITH {_F}, {_centres()}, of AS (SELECT entity, period, dim, x - o AS x FROM fx JOIN (VALUES {_ID}) t(m, d, o) ON m = substr(period, 6, 2)::INT AND d = dim WHERE period LIKE '1998%'), {_times('of', 'entity, period', TURN, 'mt')}, a8 AS (SELECT entity, dim, median(x) AS x, count(DISTINCT period) AS n FROM mt GROUP BY ALL), aw AS (SELECT entity, dim, x FROM a8 WHERE n = 12),
{_near('aw', 'entity', 'nt')} SELECT entity, cluster, round(d, 6) AS distance, round((s - d) / s, 6) AS margin, d > 0.2 AS distance_extrapolation, NOT {_IN} AS new_entity FROM nt""")
def temporal_annual(spark, sf_dir):
    artifact = {"scaler": SCALER, "offsets": OFFSETS, "metric": TURN, "centers": CENTRES, "distance_q99": 0.2, "training_ids": COHORT}
    return rounded(scoring.predict_temporal(monthly_panel(spark, sf_dir), NAMES, artifact, 1998), "distance", "margin")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.frozen_features(monthly_panel(spark, sf_dir), NAMES, SCALER)


@query(f"WITH {_F}, m AS (SELECT substr(period, 6, 2)::INT AS month, dim, median(x) AS m FROM fx GROUP BY ALL) SELECT month, dim, round(m - avg(m) OVER (PARTITION BY dim), 6) AS \"offset\" FROM m")
def calendar_offsets(spark, sf_dir):
    return rounded(scoring.calendar_offsets(features(spark, sf_dir)), "offset")


@query(f"""WITH {_F}, rf AS (SELECT dim, median(x) AS m FROM fx WHERE {_IN} GROUP BY dim) SELECT entity, period, dim, round(x - (m - ([0.01, 0.02, 0.03, 0.04, 0.05])[dim + 1]), 6)::DOUBLE AS x FROM fx JOIN rf USING (dim)""")
def relative_location(spark, sf_dir):
    long = features(spark, sf_dir)
    return rounded(scoring.relative_location(long, long.where(F.col("entity").isin(COHORT)), [0.01, 0.02, 0.03, 0.04, 0.05]), "x")


_PACK = f"""{_F}, rc AS (SELECT entity, substr(period, 6, 2)::INT AS month, dim, x AS base FROM fx WHERE period LIKE '1996%' AND entity IN (SELECT entity FROM fx WHERE period LIKE '1996%' GROUP BY entity HAVING count(DISTINCT period) = 12)),
cg AS (SELECT rc.entity, month, rc.dim, f.x - base AS delta FROM rc LEFT JOIN (SELECT entity, substr(period, 6, 2)::INT AS month, dim, x FROM fx WHERE period LIKE '1997%') f USING (entity, month, dim)),
pk AS (SELECT month, dim, count(*) AS n, count(delta) AS k, median(coalesce(delta, '-inf'::DOUBLE)) AS lo0, median(coalesce(delta, 'inf'::DOUBLE)) AS hi0, list_sort(list(delta) FILTER (WHERE delta IS NOT NULL)) AS d FROM cg GROUP BY ALL),
pb AS (SELECT month, dim, n, k, list_concat(list_transform(range(n - k), lambda i: '-inf'::DOUBLE), d) AS lo, list_concat(d, list_transform(range(n - k), lambda i: 'inf'::DOUBLE)) AS hi FROM pk),
pc AS (SELECT month, dim, n, k, CASE WHEN lo[(n - 1) // 2 + 1] = lo[n // 2 + 1] THEN lo[n // 2 + 1] ELSE (lo[(n - 1) // 2 + 1] + lo[n // 2 + 1]) / 2 END AS low, CASE WHEN hi[(n - 1) // 2 + 1] = hi[n // 2 + 1] THEN hi[n // 2 + 1] ELSE (hi[(n - 1) // 2 + 1] + hi[n // 2 + 1]) / 2 END AS high FROM pb),
ps AS (SELECT *, CASE WHEN n = k THEN 'complete_reference' WHEN min((low > '-inf'::DOUBLE AND high < 'inf'::DOUBLE)::INT) OVER (PARTITION BY month) = 1 THEN 'partial_reference_bounded' ELSE 'reference_unbounded' END AS status FROM pc),
pq AS (SELECT *, CASE WHEN status <> 'reference_unbounded' THEN low / 2 + high / 2 END AS rep FROM ps)"""
_FIN = "CASE WHEN {0} > '-inf'::DOUBLE AND {0} < 'inf'::DOUBLE THEN round({0}, 6) END AS {0}"


@query(f"WITH {_PACK} SELECT month, dim, n AS reference_n, k AS observed_n, {_FIN.format('low')}, {_FIN.format('high')}, round(rep, 6) AS representative, status FROM pq")
def reference_packets(spark, sf_dir):
    long = features(spark, sf_dir)
    found = scoring.reference_packets(long, scoring.reference_cohort(long, 1996), 1997)
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 6))
    return found.withColumns({c: finite(c) for c in ("low", "high", "representative")})


#: The box certificate, margin by margin.
_BOX = """bx AS (SELECT b.entity, b.cluster AS chosen, o.cluster AS other, sum(2 * (b.c[dim + 1] - o.c[dim + 1]) * CASE WHEN b.c[dim + 1] >= o.c[dim + 1] THEN lo ELSE hi END + o.c[dim + 1] ** 2 - b.c[dim + 1] ** 2) AS m FROM (SELECT rn.entity, rn.cluster, ce.c FROM rn JOIN ce USING (cluster)) b JOIN ce o ON o.cluster <> b.cluster JOIN md ON md.entity = b.entity GROUP BY ALL),
tl AS (SELECT entity, 1e-10 * (1 + max(s)) AS t FROM (SELECT entity, cluster, sum((lo / 2 + hi / 2 - c[dim + 1]) ** 2) AS s FROM md, ce GROUP BY ALL) GROUP BY entity), cf AS (SELECT entity, min(m) > any_value(t) AS certain FROM bx JOIN tl USING (entity) GROUP BY entity)"""


@query(f"""WITH {_PACK}, {_centres()}, rw AS (SELECT f.entity, f.dim, f.period, f.x, q.low, q.high, q.rep FROM fx f LEFT JOIN pq q ON q.month = substr(f.period, 6, 2)::INT AND q.dim = f.dim WHERE period LIKE '1997%'),
en AS (SELECT entity, dim, count(DISTINCT period) AS months, count(rep) AS told, median(x) AS a, median(x - rep) AS r, median(x - high) AS lo, median(x - low) AS hi FROM rw GROUP BY ALL), st AS (SELECT entity, min(months) = 12 AS whole, min(told) = 12 AS told FROM en GROUP BY entity),
ab AS (SELECT entity, dim, a AS x FROM en), rl AS (SELECT en.entity, dim, r AS x FROM en JOIN st USING (entity) WHERE whole AND st.told), {_near('ab', 'entity', 'ln')}, {_near('rl', 'entity', 'rn')}, md AS (SELECT en.entity, dim, lo, hi FROM en JOIN st USING (entity) WHERE whole AND st.told), {_BOX}
SELECT st.entity, CASE WHEN NOT whole THEN 'incomplete_entity_year' WHEN NOT told THEN 'relative_unavailable' ELSE 'descriptive_dual_profile' END AS status, CASE WHEN whole THEN ln.cluster END AS absolute_label, rn.cluster AS relative_label, cf.certain AS relative_certain FROM st JOIN ln USING (entity) LEFT JOIN rn ON rn.entity = st.entity LEFT JOIN cf ON cf.entity = st.entity""")
def dual_labels(spark, sf_dir):
    return scoring.predict_dual(monthly_panel(spark, sf_dir), NAMES, SCALER, CENTRES, 1996, 1997)


@query(f"""WITH {_F}, {_centres()}, a7 AS (SELECT entity, dim, x FROM an WHERE year = 1997), sc AS (SELECT entity, cluster, sum((x - c[dim + 1]) ** 2) AS s FROM a7, ce GROUP BY ALL), ow AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY entity ORDER BY s, cluster) = 1),
g AS (SELECT sc.entity, min((sc.s - ow.s) / (2 * sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) ** 2))))) AS radius FROM sc JOIN ow ON ow.entity = sc.entity AND ow.cluster <> sc.cluster JOIN ce a ON a.cluster = ow.cluster JOIN ce b ON b.cluster = sc.cluster GROUP BY sc.entity)
SELECT entity, cluster, round(radius, 6) AS radius, true AS no_worse_than_nearest FROM ow JOIN g USING (entity)""")
def continuous_codes(spark, sf_dir):
    found = scoring.predict_continuous(monthly_panel(spark, sf_dir), NAMES, SCALER, CENTRES, 1997)
    long = scoring.vectors_of(scoring.annual(features(spark, sf_dir)).where("year = 1997"), "entity")
    both = found.join(long.select("entity", scoring.nearest(F.col("vector"), CENTRES)["distance"].alias("d")), "entity")
    return both.select("entity", "cluster", F.round("radius", 6).alias("radius"), (F.col("squared_residual") <= F.col("d") * F.col("d") + 1e-9).alias("no_worse_than_nearest"))


@query(f"WITH {_W}, l AS (SELECT entity, period, dim, ln(v / total) AS r, avg(ln(v / total)) OVER (PARTITION BY entity, period) AS m FROM wp) SELECT entity, period, round(any_value(m), 6) AS shared, " + ", ".join(f"round(max(r - m) FILTER (WHERE dim = {i + 1}), 6) AS c{i}" for i in range(5)) + " FROM l GROUP BY entity, period")
def log_contrasts(spark, sf_dir):
    found = scoring.contrasts(monthly_panel(spark, sf_dir), NAMES)
    return rounded(found, *[c for c in found.columns if c not in ("entity", "period")])


@query(f"WITH {_W} SELECT entity, period, " + ", ".join(f"round(max(100 * v / total) FILTER (WHERE dim = {i}), 6) AS c{i}" for i in range(1, 6)) + " FROM wp GROUP BY entity, period")
def ratio_table(spark, sf_dir):
    return rounded(scoring.ratios(monthly_panel(spark, sf_dir), NAMES), *NAMES)


@query("""WITH q AS (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer) SELECT c_custkey, round((c_acctbal - m) / r, 6) AS c_acctbal FROM customer, q""")
def robust_standard(spark, sf_dir):
    return rounded(scoring.standardised(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


@query("""WITH m AS (SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT c_nationkey, round(1.4826 * median(abs(c_acctbal - m)), 6) AS mad FROM customer JOIN m USING (c_nationkey) GROUP BY ALL""")
def robust_spread(spark, sf_dir):
    return rounded(scoring.spread(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal"), "mad")


_V8 = "v8 AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, CASE WHEN generate_subscripts(embedding, 1) = 3 THEN 1.0::DOUBLE ELSE unnest(embedding)::DOUBLE END AS x FROM embeddings)"


@query(f"WITH {_V8}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM v8 GROUP BY dim), z AS (SELECT id, dim, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END AS z FROM v8 JOIN s USING (dim)) SELECT id, CAST(dim AS INT) AS dim, round(1000 * z / (SELECT sqrt(sum(z * z)) FROM z), 5) AS x FROM z")
def unit_block(spark, sf_dir):
    long = vectors(spark, sf_dir).select("id", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x")).withColumn("x", F.when(F.col("dim") == 2, 1.0).otherwise(F.col("x")))
    return scoring.unit_block(long).withColumn("x", F.round(F.col("x") * 1000, 5))


@query("""WITH x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), c AS (SELECT 0.5 + 0.5 * covar_samp(a, a) AS p, 0.5 * covar_samp(a, b) AS q, 0.5 + 0.5 * covar_samp(b, b) AS r FROM x),
-- the inverse root of a symmetric matrix of two: (adj + root of the determinant) over both roots
k AS (SELECT p, q, r, sqrt(p * r - q * q) AS d, sqrt(p + r + 2 * sqrt(p * r - q * q)) AS t FROM c) SELECT id, round(a * (r + d) / (d * t) - b * q / (d * t), 6) AS x, round(b * (p + d) / (d * t) - a * q / (d * t), 6) AS y FROM x, k""")
def whitened_pairs(spark, sf_dir):
    cut = vectors(spark, sf_dir).select("id", F.slice(F.col("vector").cast("array<double>"), 1, 2).alias("vector"))
    found = scoring.whitened(cut, 0.5)
    return rounded(found.select("id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y")), "x", "y")


@query(f"WITH {_F}, {_centres()}, {_near('an', 'entity, year', 'na')} SELECT entity, cluster, round(d, 6) AS distance FROM na WHERE year = 1996")
def verified_reference(spark, sf_dir):
    rows = monthly_panel(spark, sf_dir).where("period >= '1996-01-01' AND period < '1997-01-01'")
    whole = rows.groupBy("entity").agg(F.count("*").alias("n")).where("n = 12").select("entity")
    panel = materialize(rows.join(whole, "entity", "left_semi"), "panel")
    paths = {name: f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("panel", "labels")}
    sinks.write_csv(panel, paths["panel"])
    sinks.write_csv(scoring.predict_frozen(panel, NAMES, MODEL, "annual").select("entity", "cluster"), paths["labels"])
    pins = {f"{name}_sha256": files.file_digests(spark, path).first()["sha256"] for name, path in paths.items()}
    lock = scoring.sealed({**paths, **pins, "year": 1996, "scaler": SCALER, "centers": CENTRES})
    return rounded(loaders.load_reference(spark, lock, NAMES)[1].withColumnRenamed("id", "entity"), "distance")
