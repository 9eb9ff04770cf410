"""Queries of effects, regressions, draws and bounds, over customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import regression, stats
from panelloom.plans.registry import query, rounded, table

# --- customers with an outcome, a covariate, a type and a region -------------------

_CU = """cu AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS region, c_mktsegment AS seg, c_acctbal AS y, (c_custkey * 37 % 101) / 101.0::DOUBLE AS x, ((c_custkey // 3) % 2)::DOUBLE AS z, (c_custkey * 61 % 89) / 89.0::DOUBLE AS w,
c_acctbal - 20 * (c_custkey * 37 % 101) / 101.0::DOUBLE AS e1, c_acctbal * 0.9 AS e2 FROM customer)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    x = key * 37 % 101 / F.lit(101.0)
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").cast("long").alias("region"),
        F.col("c_mktsegment").alias("seg"),
        F.col("c_acctbal").alias("y"),
        x.alias("x"),
        (F.floor(key / 3) % 2).cast("double").alias("z"),
        (key * 61 % 89 / F.lit(89.0)).alias("w"),
        (F.col("c_acctbal") - 20 * x).alias("e1"),
        (F.col("c_acctbal") * 0.9).alias("e2"),
    )


_EPS = "SELECT sum(n * (m - g) ** 2) AS b, sum(s) AS w, count(*) AS k, sum(n) AS n FROM (SELECT seg, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS s FROM cu GROUP BY seg), (SELECT avg(y) AS g FROM cu)"


@query(f"WITH {_CU} SELECT round((b - (k - 1) * w / (n - k)) / (b + w), 6) AS epsilon2 FROM ({_EPS})")
def epsilon_squared(spark, sf_dir):
    return rounded(stats.epsilon_squared(customers(spark, sf_dir), "seg", "y"), "epsilon2")


@query(f"""WITH {_CU}, r AS (SELECT region AS g, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS r FROM cu), q AS (SELECT sum(s * s / m) AS q, count(*) AS k, sum(m) AS n FROM (SELECT sum(r) AS s, count(*) AS m FROM r GROUP BY g HAVING count(*) >= 5)), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT count(*) AS c FROM cu GROUP BY y)),
h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::DOUBLE ** 3 - n)) AS h, k, CAST(n AS BIGINT) AS n FROM q, t),
-- the chi-squared tail of an even number of degrees of freedom is a finite sum
p AS (SELECT exp(-h / 2) * sum((h / 2) ** i / exp(lgamma(i + 1))) AS p FROM h, range(0, 12) s(i) GROUP BY h) SELECT round(h, 6) AS h, round(p, 6) AS p, round((h - k + 1) / (n - k), 6) AS epsilon2, k, n FROM h, p""")
def kruskal_test(spark, sf_dir):
    return rounded(stats.kruskal_test(customers(spark, sf_dir), "region", "y"), "h", "p", "epsilon2")


@query("""WITH r AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) / any_value(o_totalprice) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
SELECT count(*) AS n, count(*) FILTER (WHERE r > 1) AS n_above, round(min(r), 6) AS q0, round(quantile_cont(r, 0.01), 6) AS q01, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.99), 6) AS q99, round(max(r), 6) AS q100 FROM r""")
def ratio_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("part"))
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return rounded(stats.ratio_audit(rows, F.try_divide("part", "o_totalprice")), "q0", "q01", "q50", "q99", "q100")


@query(f"""WITH {_CU}, c AS (SELECT region, seg, count(*) AS c FROM cu GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY c DESC, seg) AS p FROM c QUALIFY p <= 3), m AS (SELECT region, string_agg(seg || ':' || c, ',' ORDER BY p) AS most FROM p GROUP BY region)
SELECT region, count(*) AS n, round(median(y), 6) AS y, round(median(x), 6) AS x, any_value(most) AS most FROM cu JOIN m USING (region) GROUP BY region""")
def group_profile(spark, sf_dir):
    return rounded(stats.group_profile(customers(spark, sf_dir), "region", ["y", "x"], "seg"), "y", "x")


@query(f"WITH {_CU}, c AS (SELECT region, seg, count(*) AS n FROM cu GROUP BY ALL) SELECT region, seg, n FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, seg) = 1")
def modal_value(spark, sf_dir):
    return stats.modal(customers(spark, sf_dir), "region", "seg")


@query(f"""WITH {_CU}, g AS (SELECT region, avg(y) AS y, avg(x) AS x FROM cu GROUP BY region), o AS (SELECT avg(y) AS ay, avg(x) AS ax FROM cu), u AS (SELECT region, 'y' AS name, (y - ay) / ay AS d FROM g, o UNION ALL SELECT region, 'x', (x - ax) / ax FROM g, o)
SELECT region, name, round(d, 6) AS deviation, abs(d) >= 0.1 AS salient FROM u""")
def mirkin_deviation(spark, sf_dir):
    return rounded(stats.mirkin(customers(spark, sf_dir), "region", ["y", "x"], 0.1), "deviation")


_GAPS = f"{_CU}, gp AS (SELECT id, region, seg, x, CASE WHEN id % 4 <> 1 THEN y END AS y, CASE WHEN id % 7 <> 2 AND region <> 5 THEN w END AS w FROM cu)"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return rows.select("id", "region", "seg", "x", F.when(F.col("id") % 4 != 1, F.col("y")).alias("y"), F.when((F.col("id") % 7 != 2) & (F.col("region") != 5), F.col("w")).alias("w"))


@query(f"WITH {_GAPS} SELECT region, count(*) AS n, count(y) AS y, count(w) AS w FROM gp GROUP BY GROUPING SETS ((region), ())")
def coverage(spark, sf_dir):
    return stats.coverage(gappy(spark, sf_dir), "region", ["y", "w"])


@query(f"""WITH {_GAPS}, b AS (SELECT region, w AS v, x AS a, 1 - x AS b FROM gp), r AS (SELECT region, v IS NOT NULL AS seen, coalesce((v - b) ** 2 - (v - a) ** 2, least(b * b - a * a, (1 - b) ** 2 - (1 - a) ** 2)) AS lo, coalesce((v - b) ** 2 - (v - a) ** 2, greatest(b * b - a * a, (1 - b) ** 2 - (1 - a) ** 2)) AS hi FROM b),
p AS (SELECT region, count(*) AS n, count(*) FILTER (WHERE seen) AS s, sum(lo) AS lo, sum(hi) AS hi FROM r GROUP BY region), o AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS observed, count(*) FILTER (WHERE s = 0) AS unseen_regions, avg(lo / n) AS equal_low, avg(hi / n) AS equal_high, sum(lo) / sum(n) AS row_low, sum(hi) / sum(n) AS row_high FROM p)
SELECT n, observed, unseen_regions, round(equal_low, 6) AS equal_low, round(equal_high, 6) AS equal_high, round(row_low, 6) AS row_low, round(row_high, 6) AS row_high, CASE WHEN equal_low > 0 THEN 'candidate_better' WHEN equal_high < 0 THEN 'candidate_worse' ELSE 'not_identified' END AS conclusion FROM o""")
def loss_bounds(spark, sf_dir):
    rows = gappy(spark, sf_dir).withColumn("other", 1 - F.col("x"))
    return rounded(stats.loss_bounds(rows, "region", "w", "x", "other"), "equal_low", "equal_high", "row_low", "row_high")


@query(f"""WITH {_GAPS}, n AS (SELECT region, count(*) AS n FROM gp GROUP BY region), o AS (SELECT region, count(w) AS k, list_sort(list(w) FILTER (WHERE w IS NOT NULL)) AS v FROM gp GROUP BY region),
f AS (SELECT region, k, n, list_concat(list_transform(range(n - k), lambda i: '-inf'::DOUBLE), coalesce(v, [])) AS lo, list_concat(coalesce(v, []), list_transform(range(n - k), lambda i: 'inf'::DOUBLE)) AS hi FROM o JOIN n USING (region)),
z AS (SELECT region, k, lo[(n - 1) // 2 + 1] AS la, lo[n // 2 + 1] AS lb, hi[(n - 1) // 2 + 1] AS ha, hi[n // 2 + 1] AS hb FROM f)
SELECT region, k AS observed, CASE WHEN isinf(la) OR isinf(lb) THEN CASE WHEN la = lb THEN la ELSE (la + lb) / 2 END ELSE round((la + lb) / 2, 6) END AS low, CASE WHEN isinf(ha) OR isinf(hb) THEN CASE WHEN ha = hb THEN ha ELSE (ha + hb) / 2 END ELSE round((ha + hb) / 2, 6) END AS high FROM z""")
def median_bounds(spark, sf_dir):
    rows = gappy(spark, sf_dir)
    found = stats.median_bounds(rows, "region", "w", rows.groupBy("region").agg(F.count("*").alias("n")))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 6)).otherwise(F.col(c)).alias(c)
    return found.select("region", "observed", finite("low"), finite("high"))


@query("""WITH o AS (SELECT c_nationkey AS nation, month(o_orderdate) AS m, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT nation, round(avg(v) FILTER (WHERE m IN (6, 7, 8)) - avg(v) FILTER (WHERE m NOT IN (6, 7, 8)), 4) AS contrast FROM o GROUP BY GROUPING SETS ((nation), ())""")
def seasonal_contrast(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").alias("m"), "o_totalprice")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    return rounded(stats.seasonal_contrast(rows, "nation", "m", "o_totalprice"), "contrast", places=4)


@query("""WITH o AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, year(o_orderdate) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT nation, seg, median(v) FILTER (WHERE y = 1996) AS a, median(v) FILTER (WHERE y = 1998) AS b FROM o GROUP BY ALL)
SELECT seg, count(*) AS n, round(median(b - a), 4) AS change FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY seg""")
def paired_change(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_totalprice")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")), "c_custkey")
    return rounded(stats.paired_change(rows, "nation", "seg", "y", "o_totalprice", 1996, 1998), "change", places=4)


@query("""WITH s AS (SELECT o_custkey AS cust, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL), w AS (SELECT cust, max(v) FILTER (WHERE p = '1-URGENT') AS a, max(v) FILTER (WHERE p = '2-HIGH') AS b, max(v) FILTER (WHERE p = '3-MEDIUM') AS c FROM s GROUP BY cust)
SELECT cust, round(a + b + c, 2) AS total, round(a / (a + b + c), 6) AS share_0, round(b / (a + b + c), 6) AS share_1, round(c / (a + b + c), 6) AS share_2 FROM w""")
def wide_outcomes(spark, sf_dir):
    parts = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(parts)).select(F.col("o_custkey").alias("cust"), "o_orderpriority", "o_totalprice")
    found = stats.wide_outcomes(orders, "cust", "o_orderpriority", "o_totalprice", parts)
    return rounded(rounded(found, "total", places=2), "share_0", "share_1", "share_2")


@query("""SELECT c_custkey AS id, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log_balance, c_nationkey || '|' || c_mktsegment AS stratum FROM customer""")
def outcome_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), F.round(stats.transformed(F.col("c_acctbal"), "log"), 6).alias("log_balance"), stats.stratum("region_type", F.col("c_nationkey"), F.col("c_mktsegment")).alias("stratum"))


@query(f"""WITH {_GAPS}, u AS (SELECT 'y' AS indicator, seg AS "group", y AS v FROM gp UNION ALL SELECT 'w', seg, w FROM gp) SELECT indicator, "group", count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM u WHERE v IS NOT NULL GROUP BY ALL""")
def effects_by_group(spark, sf_dir):
    return rounded(stats.effects_by_group(gappy(spark, sf_dir), "seg", ["y", "w"]), "q25", "median", "q75")


@query(f"""WITH {_CU}, g AS (SELECT region, avg(y) AS y, avg(x) AS x, CASE WHEN region <> 3 THEN avg(w) END AS w FROM cu GROUP BY region), b AS (SELECT avg(y) AS y, avg(x) AS x, avg(w) AS w FROM cu)
SELECT region, round(g.y, 6) AS y, round(g.x, 6) AS x, round(g.w, 6) AS w, g.y >= 0.95 * b.y AS pass_y, g.x <= 1.02 * b.x AS pass_x, coalesce(abs(g.w - b.w) <= 0.03, false) AS pass_w, g.y >= 0.95 * b.y AND g.x <= 1.02 * b.x AND coalesce(abs(g.w - b.w) <= 0.03, false) AS passes FROM g, b""")
def acceptance_gates(spark, sf_dir):
    rows = customers(spark, sf_dir)
    found = rows.groupBy("region").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.when(F.col("region") != 3, F.avg("w")).alias("w"))
    baseline = rows.agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.avg("w").alias("w"))
    return rounded(stats.gates(found, baseline, {"y": ("least", 0.95), "x": ("most", 1.02), "w": ("near", 0.03)}), "y", "x", "w")


# --- regressions ---------------------------------------------------------------------

#: Moments within regions of an outcome, a covariate and one more regressor.
_IN = f"""{_CU}, dm AS (SELECT id, region, y - avg(y) OVER r AS y, x - avg(x) OVER r AS x, z - avg(z) OVER r AS z FROM cu WINDOW r AS (PARTITION BY region)),
mo AS (SELECT sum(y * y) AS yy, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(x * z) AS xz, count(*) AS n, count(DISTINCT region) AS g FROM dm),
fi AS (SELECT yy - xy * xy / xx AS r0, yy - (xy * xy * zz - 2 * xy * zy * xz + zy * zy * xx) / (xx * zz - xz * xz) AS r1, n, g, yy, xx, zz, xy, zy, xz FROM mo), ts AS (SELECT var_pop(y) * count(*) AS t FROM cu)"""


@query(f"WITH {_IN} SELECT round(1 - r0 / t, 6) AS r2_base, round(1 - r1 / t, 6) AS r2_full, round((r0 - r1) / t, 6) AS delta_r2, round((r0 - r1) / r0, 6) AS partial_r2, round((r0 - r1) / (r1 / (n - g - 2)), 6) AS f, n FROM fi, ts")
def r2_gain(spark, sf_dir):
    found = regression.r2_gain(customers(spark, sf_dir), "y", ["x"], "region", ["z"])
    return rounded(found.drop("p"), "r2_base", "r2_full", "delta_r2", "partial_r2", "f")


@query(f"""WITH {_IN}, a AS (SELECT yy - xy * xy / xx AS yy, zz - xz * xz / xx AS zz, zy - xz * xy / xx AS zy, n FROM mo) SELECT round(zy * zy / zz / yy, 6) AS partial_r2, n FROM a""")
def within_stratum_r2(spark, sf_dir):
    return rounded(regression.within_stratum_r2(customers(spark, sf_dir), "y", ["z"], "region", "x"), "partial_r2")


@query(f"""WITH {_CU}, m AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM cu), e AS (SELECT region, sum(y - a - b * x) AS s0, sum((y - a - b * x) * x) AS s1 FROM cu, m GROUP BY region),
f AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*) AS g FROM e), v AS (SELECT g / (g - 1) * (n - 1) / (n - 2) * (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (n * sxx - sx * sx) ** 2 AS v, b, g FROM m, f)
SELECT round(b * b / v, 6) AS f, 1 AS df1, g - 1 AS df2 FROM v""")
def cluster_wald(spark, sf_dir):
    return rounded(regression.cluster_wald(customers(spark, sf_dir), "y", ["x"], "region", ["x"]).drop("p"), "f")


@query(f"WITH {_CU} SELECT round(regr_r2(y, x), 6) AS r2, round(regr_intercept(y, x), 4) AS intercept, round(regr_slope(y, x), 4) AS slope, count(*) AS n FROM cu")
def simple_ols(spark, sf_dir):
    found = regression.ols(customers(spark, sf_dir), "y", ["x"])
    row = (round(float(found["r2"]), 6), round(float(found["coefficients"][0]), 4), round(float(found["coefficients"][1]), 4), found["n"])
    return spark.createDataFrame([row], "r2 double, intercept double, slope double, n long")


@query(f"""WITH {_CU}, q AS (SELECT id, x, z, x * x AS x_x, x * z AS x_z, z * z AS z_z, seg FROM cu), v AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS i FROM (SELECT DISTINCT seg FROM cu WHERE region < 20))
SELECT id, round(x_x, 6) AS x_x, round(x_z, 6) AS x_z, z_z, CAST(q.seg = (SELECT seg FROM v WHERE i = 1) AS INT)::DOUBLE AS t1, CAST(q.seg = (SELECT seg FROM v WHERE i = 4) AS INT)::DOUBLE AS t4 FROM q""")
def design_columns(spark, sf_dir):
    rows = customers(spark, sf_dir)
    wide, _ = regression.polynomial(rows, ["x", "z"])
    wide, _ = regression.type_design(rows.where("region < 20"), wide, "seg", "t")
    return rounded(wide.select("id", "x_x", "x_z", "z_z", "t1", "t4"), "x_x", "x_z")


def _draws(n: str, draws: int, seed: int) -> str:
    """The table of picks, as SQL."""
    return f"(SELECT d AS draw, s AS slot, ('0x' || substr(md5('{seed}:' || d || ':' || s), 1, 12))::BIGINT % {n} AS pick FROM range({draws}) a(d), range({n}) b(s))"


_REGIONS = f"{_CU}, rg AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS pick FROM (SELECT DISTINCT region FROM cu)), wt AS (SELECT draw, region, count(*) AS w FROM {_draws('25', 40, 11)} JOIN rg USING (pick) GROUP BY ALL)"


@query(f"WITH {_REGIONS} SELECT CAST(draw AS BIGINT) AS draw, region, CAST(any_value(wt.w) AS BIGINT) AS times, CAST(any_value(wt.w) * count(*) AS BIGINT) AS n FROM wt JOIN cu USING (region) GROUP BY draw, region")
def draw_table(spark, sf_dir):
    rows = customers(spark, sf_dir)
    placed = regression.numbered(rows.select("region").distinct(), "region")
    picks = regression.draw_table(spark, 40, placed.count(), 11).join(F.broadcast(placed), "pick").groupBy("draw", "region").agg(F.count("*").alias("times"))
    return rows.groupBy("region").agg(F.count("*").alias("c")).join(picks, "region").select("draw", "region", "times", (F.col("times") * F.col("c")).alias("n"))


@query(f"""WITH {_REGIONS}, s AS (SELECT region, sum(e2 - e1) AS s, count(*) AS c FROM cu GROUP BY region), e AS (SELECT draw, sum(w * s) / sum(w * c) AS e FROM wt JOIN s USING (region) GROUP BY draw)
SELECT round((SELECT sum(s) / sum(c) FROM s), 6) AS mean_improvement, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high, (SELECT count(*) FROM cu) AS n, (SELECT count(*) FROM s) AS n_regions FROM e""")
def region_bootstrap(spark, sf_dir):
    return rounded(regression.region_bootstrap(customers(spark, sf_dir), "region", "e1", "e2", 40, 11), "mean_improvement", "low", "high")


@query(f"""WITH {_CU}, u AS (SELECT e2 - e1 AS d, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM cu), dw AS (SELECT a.d AS draw, ('0x' || substr(md5('3:' || a.d || ':' || place), 1, 12))::BIGINT % n AS pick FROM range(30) a(d), u),
e AS (SELECT draw, avg(u.d) AS e FROM dw JOIN u ON place = pick GROUP BY draw) SELECT round((SELECT avg(d) FROM u), 6) AS mean_improvement, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high, (SELECT count(*) FROM u) AS n FROM e""")
def entity_bootstrap(spark, sf_dir):
    return rounded(regression.entity_bootstrap(customers(spark, sf_dir), "id", "e1", "e2", 30, 3), "mean_improvement", "low", "high")


@query(f"""WITH {_REGIONS}, dm AS (SELECT region, y - avg(y) OVER r AS y, x - avg(x) OVER r AS x, z - avg(z) OVER r AS z FROM cu WINDOW r AS (PARTITION BY region)), mo AS (SELECT region, sum(y * y) AS yy, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(x * z) AS xz FROM dm GROUP BY region), rw AS (SELECT region, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM cu GROUP BY region),
t AS (SELECT draw, sum(w * yy) AS yy, sum(w * xx) AS xx, sum(w * zz) AS zz, sum(w * xy) AS xy, sum(w * zy) AS zy, sum(w * xz) AS xz, sum(w * q) - sum(w * s) ** 2 / sum(w * n) AS t FROM wt JOIN mo USING (region) JOIN rw USING (region) GROUP BY draw)
SELECT CAST(draw AS BIGINT) AS draw, round(((xy * xy * zz - 2 * xy * zy * xz + zy * zy * xx) / (xx * zz - xz * xz) - xy * xy / xx) / t, 6) AS delta_r2 FROM t""")
def gain_bootstrap(spark, sf_dir):
    return rounded(regression.gain_bootstrap(customers(spark, sf_dir), "y", ["x"], "region", ["z"], 40, 11), "delta_r2")


_PERM = """dr AS (SELECT unnest(range({3})) AS draw), pa AS (SELECT draw, id, region, seg, {0}, row_number() OVER (PARTITION BY draw, region ORDER BY id) AS a, row_number() OVER (PARTITION BY draw, region ORDER BY md5('{1}:' || draw || ':' || id), id) AS b FROM {2}, dr)"""


@query(f"""WITH {_CU}, dm AS (SELECT id, region, seg, y - avg(y) OVER (PARTITION BY region) AS y FROM cu), {_PERM.format('y', 9, 'dm', 999)}, ev AS (SELECT -1 AS draw, y, seg FROM dm UNION ALL SELECT p.draw, p.y, q.seg FROM pa p JOIN pa q ON p.draw = q.draw AND p.region = q.region AND p.a = q.b),
g AS (SELECT draw, seg, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM ev GROUP BY ALL), et AS (SELECT draw, sum(n * (m - gm) ** 2) / (sum(n * (m - gm) ** 2) + sum(w)) AS e FROM g JOIN (SELECT draw, avg(y) AS gm FROM ev GROUP BY draw) USING (draw) GROUP BY draw), o AS (SELECT e AS own FROM et WHERE draw = -1)
SELECT round(own, 6) AS eta2, round((1 + count(*) FILTER (WHERE draw >= 0 AND e >= own - 1e-12)) / 1000, 6) AS p FROM et, o GROUP BY own""")
def permutation_test(spark, sf_dir):
    return rounded(regression.permutation_test(customers(spark, sf_dir), "id", "y", "seg", "region", 999, 9), "eta2", "p")


@query(f"""WITH {_CU}, m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM cu), rs AS (SELECT id, region, seg, x, z, y, a + b * x AS fit, y - a - b * x AS e FROM cu, m), {_PERM.format('x, z, fit, e', 4, 'rs', 19)},
ev AS (SELECT -1 AS draw, y, x, z FROM rs UNION ALL SELECT p.draw, p.fit + q.e, p.x, p.z FROM pa p JOIN pa q ON p.draw = q.draw AND p.region = q.region AND p.a = q.b),
mo AS (SELECT draw, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy, covar_pop(x, z) * count(*) AS xz FROM ev GROUP BY draw),
fs AS (SELECT draw, n, yy - xy * xy / xx AS r0, yy - (xy * xy * zz - 2 * xy * zy * xz + zy * zy * xx) / (xx * zz - xz * xz) AS r1 FROM mo), ff AS (SELECT draw, (r0 - r1) / (r1 / (n - 3)) AS f FROM fs), o AS (SELECT f AS own FROM ff WHERE draw = -1)
SELECT round(own, 5) AS f, round((1 + count(*) FILTER (WHERE draw >= 0 AND f >= own - 1e-9)) / 20, 6) AS p FROM ff, o GROUP BY own""")
def freedman_lane(spark, sf_dir):
    found = regression.freedman_lane(customers(spark, sf_dir), "id", "y", ["x"], ["z"], "region", 19, 4)
    return rounded(rounded(found, "f", places=5), "p")


_LORO = f"""{_CU}, al AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM cu), re AS (SELECT region, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM cu GROUP BY region),
df AS (SELECT region, al.n - re.n AS n, al.sx - re.sx AS sx, al.sy - re.sy AS sy, al.sxx - re.sxx AS sxx, al.sxy - re.sxy AS sxy FROM re, al), co AS (SELECT region, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sx, sy, n FROM df),
pr AS (SELECT id, region, y, (sy - b * sx) / n + b * x AS predicted FROM cu JOIN co USING (region))"""


@query(f"WITH {_LORO} SELECT id, region, round(y, 6) AS y, round(predicted, 4) AS predicted FROM pr")
def held_out_predictions(spark, sf_dir):
    found = regression.held_out_predictions(customers(spark, sf_dir), "id", "y", ["x"], "region")
    return rounded(rounded(found, "y"), "predicted", places=4)


@query(f"""WITH {_LORO}, e AS (SELECT region, y - predicted AS e FROM pr), p AS (SELECT region, count(*) AS n, sum(e * e) AS s, sum(abs(e)) AS a, avg(e) AS m, var_samp(e) AS v FROM e GROUP BY region)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_regions, round(sqrt(sum(s) / sum(n)), 4) AS rmse, round(sum(a) / sum(n), 4) AS mae, round(avg(s / n), 2) AS equal_region_mse, round(avg(v), 2) AS equal_region_variance, round(avg(m), 4) AS equal_region_mean_error, count(v) AS regions_with_pairs FROM p""")
def prediction_scores(spark, sf_dir):
    found = regression.held_out_predictions(customers(spark, sf_dir), "id", "y", ["x"], "region")
    scores = regression.prediction_scores(found, "region", "y", "predicted")
    return rounded(rounded(scores, "rmse", "mae", "equal_region_mean_error", places=4), "equal_region_mse", "equal_region_variance", places=2)
