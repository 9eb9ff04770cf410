"""Queries of partitions: quality, agreement, renaming, selection of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import assignment, graph, partitions
from panelloom.plans.queries import _G, _L, _SECOND, daily_labels, knn_edges, labels, vectors
from panelloom.plans.registry import query, rounded, table
from panelloom.sources.shared import materialize


def _sdbw(tag: str, dims: int) -> str:
    """CTEs of S_Dbw over the first ``dims`` coordinates."""
    return f"""v{tag} AS (SELECT id, cluster, dim, x FROM v WHERE dim <= {dims}), c{tag} AS (SELECT cluster, dim, avg(x) AS m, var_pop(x) AS s FROM v{tag} GROUP BY ALL),
n{tag} AS (SELECT cluster, sqrt(sum(s * s)) AS norm FROM c{tag} GROUP BY cluster), r{tag} AS (SELECT sqrt(sum(norm)) / count(*) AS radius, avg(norm) AS mean_norm, count(*) AS k FROM n{tag}), t{tag} AS (SELECT sqrt(sum(s * s)) AS total FROM (SELECT var_pop(x) AS s FROM v{tag} GROUP BY dim)),
i{tag} AS (SELECT cluster, count(*) FILTER (WHERE d <= radius) AS d, count(*) AS n FROM (SELECT id, cluster, sqrt(sum((x - m) ** 2)) AS d FROM v{tag} JOIN c{tag} USING (cluster, dim) GROUP BY ALL), r{tag} GROUP BY cluster),
mid{tag} AS (SELECT a.cluster AS i, b.cluster AS j, a.dim, (a.m + b.m) / 2 AS m FROM c{tag} a JOIN c{tag} b ON a.dim = b.dim AND a.cluster < b.cluster),
q{tag} AS (SELECT i, j, count(*) FILTER (WHERE d <= radius) AS num, count(*) AS m FROM (SELECT i, j, id, sqrt(sum((x - m) ** 2)) AS d FROM v{tag} JOIN mid{tag} ON v{tag}.dim = mid{tag}.dim AND (cluster = i OR cluster = j) GROUP BY ALL), r{tag} GROUP BY ALL),
b{tag} AS (SELECT count(*) FILTER (WHERE greatest(x.d, y.d) = 0) AS u, sum(CASE WHEN greatest(x.d, y.d) > 0 THEN 2 * num / greatest(x.d, y.d) END) AS b, count(*) FILTER (WHERE greatest(x.n - x.d, y.n - y.d) = 0) AS uo, sum(CASE WHEN greatest(x.n - x.d, y.n - y.d) > 0 THEN 2 * (m - num) / greatest(x.n - x.d, y.n - y.d) END) AS bo FROM q{tag} JOIN i{tag} x ON x.cluster = i JOIN i{tag} y ON y.cluster = j),
o{tag} AS (SELECT {dims} AS dims, round(CASE WHEN u = 0 THEN mean_norm / total + b / (k * (k - 1)) END, 6) AS s_dbw, round(CASE WHEN uo = 0 THEN mean_norm / total + bo / (k * (k - 1)) END, 6) AS s_dbw_outside, round(radius, 6) AS radius, u AS undefined_pairs, uo AS undefined_pairs_outside FROM b{tag}, r{tag}, t{tag})"""


@query(f"WITH {_G}, {_sdbw('a', 2)}, {_sdbw('b', 64)}, {_sdbw('z', 8)} SELECT * FROM oa UNION ALL SELECT * FROM ob UNION ALL SELECT * FROM oz")
def s_dbw(spark, sf_dir):
    out = None
    for dims in (2, 8, 64):
        cut = vectors(spark, sf_dir).withColumn("vector", F.slice("vector", 1, dims))
        row = partitions.s_dbw(cut, labels(spark, sf_dir)).withColumn("dims", F.lit(dims))
        out = row if out is None else out.unionByName(row)
    return rounded(out, "s_dbw", "s_dbw_outside", "radius")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, a, b``: the labels and a partition that merges, splits and scatters them."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("a"), F.expr(_SECOND).cast("long").alias("b"))


_AB = f"p AS (SELECT vec_id AS id, label AS a, ({_SECOND})::BIGINT AS b FROM embeddings)"


@query(f"""WITH {_AB}, c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), ma AS (SELECT a, sum(n)::BIGINT AS x FROM c GROUP BY a), mb AS (SELECT b, sum(n)::BIGINT AS y FROM c GROUP BY b), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
e AS (SELECT x, y, t, unnest(range(greatest(1, CAST(x + y - t AS BIGINT)), least(x, y) + 1)) AS k FROM ma, mb, t),
emi AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS e FROM e),
mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS m FROM c JOIN ma USING (a) JOIN mb USING (b), t), h AS (SELECT ((SELECT -sum(x / t * ln(x / t)) FROM ma) + (SELECT -sum(y / t * ln(y / t)) FROM mb)) / 2 AS h FROM t)
SELECT round((m - e) / (h - e), 6) AS ami, CAST(t AS BIGINT) AS n FROM mi, emi, h, t""")
def ami(spark, sf_dir):
    return rounded(partitions.adjusted_information(second(spark, sf_dir), "a", "b"), "ami")


_DAYS = f"{_L}, x AS (SELECT a.label AS la, b.label AS lb FROM lab a JOIN lab b ON a.key = b.key AND b.t = a.t + 1)"


def day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = daily_labels(spark, sf_dir)
    after = found.select("key", (F.col("t") - 1).alias("t"), F.col("label").alias("lb"))
    return found.withColumnRenamed("label", "la").join(after, ["key", "t"])


@query(f"""WITH RECURSIVE {_DAYS}, ct AS (SELECT la, lb, count(*) AS n FROM x GROUP BY ALL), ra AS (SELECT la, dense_rank() OVER (ORDER BY la) AS i FROM (SELECT DISTINCT la FROM x)), rb AS (SELECT lb, dense_rank() OVER (ORDER BY lb) AS j FROM (SELECT DISTINCT lb FROM x)),
pm AS (SELECT []::BIGINT[] AS p UNION ALL SELECT list_append(p, j) FROM pm, rb WHERE NOT list_contains(p, j) AND len(p) < 5), full_p AS (SELECT p FROM pm WHERE len(p) = 5),
tot AS (SELECT p, sum(CASE WHEN p[i] = j THEN n ELSE 0 END) AS s FROM full_p, ct JOIN ra USING (la) JOIN rb USING (lb) GROUP BY p), best AS (SELECT p FROM tot WHERE s = (SELECT max(s) FROM tot))
SELECT la, lb, n, (SELECT count(*) FROM best WHERE p[i] = j) > 0 AS in_some, (SELECT count(*) FROM best WHERE p[i] = j) = (SELECT count(*) FROM best) AS in_all FROM ct JOIN ra USING (la) JOIN rb USING (lb)""")
def label_matching(spark, sf_dir):
    return assignment.matching(day_pairs(spark, sf_dir), "la", "lb")


@query(f"""WITH RECURSIVE p AS (SELECT label % 4 AS a, (label * 3 + vec_id // 9) % 4 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT unnest(range(4)) AS j),
pm AS (SELECT []::BIGINT[] AS p UNION ALL SELECT list_append(p, j) FROM pm, d WHERE NOT list_contains(p, j) AND len(p) < 4), best AS (SELECT p FROM pm, c WHERE len(p) = 4 GROUP BY p ORDER BY sum(CASE WHEN p[b + 1] = a THEN n ELSE 0 END) DESC, p LIMIT 1)
SELECT CAST(b AS INT) AS label, CAST(p[b + 1] AS INT) AS "to", CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN p[b + 1] = a THEN n ELSE 0 END) AS BIGINT) AS n_matched FROM c, best GROUP BY ALL""")
def permutation_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("a"), ((F.col("label") * 3 + F.floor(F.col("vec_id") / 9)) % 4).alias("b"))
    return assignment.align_small(rows, "a", "b", 4)


@query(f"""WITH {_AB}, g AS (SELECT b, count(*) AS n, min(id) AS f FROM p GROUP BY b), s AS (SELECT b, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INT) AS by_size, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS by_first FROM g) SELECT id, by_size, by_first FROM p JOIN s USING (b)""")
def canonical_labels(spark, sf_dir):
    own = second(spark, sf_dir).select("id", F.col("b").alias("cluster"))
    return partitions.canonical(own).withColumnRenamed("cluster", "by_size").join(partitions.canonical(own, "first").withColumnRenamed("cluster", "by_first"), "id")


@query(f"""WITH {_AB}, q AS (SELECT 'second' AS case_, a, b FROM p UNION ALL SELECT 'renamed', a, 9 - a FROM p UNION ALL SELECT 'merged', a, a // 2 FROM p)
SELECT case_ AS name, (SELECT max(n) FROM (SELECT count(DISTINCT b) AS n FROM q x WHERE x.case_ = q.case_ GROUP BY a)) = 1 AND (SELECT max(n) FROM (SELECT count(DISTINCT a) AS n FROM q x WHERE x.case_ = q.case_ GROUP BY b)) = 1 AS equivalent FROM q GROUP BY case_""")
def partition_equivalence(spark, sf_dir):
    own = second(spark, sf_dir)
    cases = {"second": own, "renamed": own.withColumn("b", 9 - F.col("a")), "merged": own.withColumn("b", F.floor(F.col("a") / 2))}
    out = None
    for name, pairs in cases.items():
        row = partitions.equivalent(pairs, "a", "b").select(F.lit(name).alias("name"), "equivalent")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_AB}, s AS (SELECT id, count(*) OVER (PARTITION BY a, b) - 1 AS c, count(*) OVER (PARTITION BY a) - 1 AS o, count(*) OVER (PARTITION BY b) - 1 AS n FROM p)
SELECT id, round(CASE WHEN o + n - c > 0 THEN c / (o + n - c) ELSE 1 END, 6) AS jaccard, round(CASE WHEN o > 0 THEN c / o END, 6) AS retention FROM s""")
def neighbourhood_jaccard(spark, sf_dir):
    return rounded(partitions.neighbourhoods(second(spark, sf_dir), "a", "b"), "jaccard", "retention")


_REPEATS = "r AS (SELECT vec_id AS id, label AS g, label // 2 AS r1, vec_id % 3 AS r2, (label + vec_id) % 5 AS r3 FROM embeddings)"


@query(f"""WITH {_REPEATS}, q AS (SELECT least(x.g, y.g) AS "left", greatest(x.g, y.g) AS "right", (x.r1 = y.r1)::INT + (x.r2 = y.r2)::INT + (x.r3 = y.r3)::INT AS together FROM r x JOIN r y ON x.id < y.id)
SELECT "left", "right", together, count(*) AS pairs FROM q GROUP BY ALL""")
def pair_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.floor(F.col("label") / 2).alias("r1"), (F.col("vec_id") % 3).alias("r2"), ((F.col("label") + F.col("vec_id")) % 5).alias("r3"))
    return partitions.pair_histogram(rows, "g", ["r1", "r2", "r3"])


# --- candidates: one per nation, with indices from its key ---------------------------

_CAND = """cand AS (SELECT n_nationkey::BIGINT AS key, n_name AS partition, CAST(2 + n_nationkey % 3 AS INT) AS k, CAST(n_nationkey * 13 % 50 AS INT) AS min_size, (n_nationkey * 37 % 100) / 100.0::DOUBLE AS seed_ari,
CASE WHEN n_nationkey % 11 <> 10 THEN (n_nationkey * 17 % 23) / 23.0::DOUBLE END AS sw, (n_nationkey * 29 % 13) / 13.0::DOUBLE AS mq, CASE WHEN n_nationkey % 7 <> 3 THEN (n_nationkey * 5 % 19) / 19.0::DOUBLE END AS sdbw,
CASE WHEN n_nationkey % 4 = 0 THEN 'fit' WHEN n_nationkey % 4 = 1 THEN 'year_2024' WHEN n_nationkey % 4 = 2 THEN 'external' ELSE 'year_2024' END AS role_a, CASE WHEN n_nationkey % 5 = 0 THEN 'selection' ELSE 'external' END AS role_b, 0.5::DOUBLE AS flat FROM nation)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    share = lambda a, b: n * a % b / F.lit(float(b))
    return table(spark, sf_dir, "nation").select(
        n.alias("key"),
        F.col("n_name").alias("partition"),
        (2 + n % 3).cast("int").alias("k"),
        (n * 13 % 50).cast("int").alias("min_size"),
        share(37, 100).alias("seed_ari"),
        F.when(n % 11 != 10, share(17, 23)).alias("sw"),
        share(29, 13).alias("mq"),
        F.when(n % 7 != 3, share(5, 19)).alias("sdbw"),
        F.when(n % 4 == 0, "fit").when(n % 4 == 1, "year_2024").when(n % 4 == 2, "external").otherwise("year_2024").alias("role_a"),
        F.when(n % 5 == 0, "selection").otherwise("external").alias("role_b"),
        F.lit(0.5).alias("flat"),
    )


@query(f"""WITH {_CAND}, o AS (SELECT key, 'sw' AS i, sw AS v FROM cand UNION ALL SELECT key, 'mq', mq FROM cand UNION ALL SELECT key, 'sdbw', -sdbw FROM cand), pr AS (SELECT x.i AS a, y.i AS b, x.v AS x, y.v AS y FROM o x JOIN o y USING (key) WHERE x.i <= y.i AND x.v IS NOT NULL AND y.v IS NOT NULL),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM pr)
SELECT a, b, count(*) AS n, round(CASE WHEN count(*) > 2 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS rho FROM rk GROUP BY ALL""")
def index_agreement(spark, sf_dir):
    return rounded(partitions.spearman(candidates(spark, sf_dir), "key", {"sw": 1, "mq": 1, "sdbw": -1}), "rho")


_ADM = "adm AS (SELECT *, coalesce(sw, '-inf'::DOUBLE) AS osw FROM cand WHERE seed_ari >= 0.2 AND min_size >= 5 AND k BETWEEN 2 AND 4), front AS (SELECT * FROM adm r WHERE NOT EXISTS (SELECT 1 FROM adm o WHERE o.osw >= r.osw AND o.mq >= r.mq AND (o.osw > r.osw OR o.mq > r.mq)))"


@query(f"WITH {_CAND}, {_ADM} SELECT partition, k, round(sw, 6) AS sw, round(mq, 6) AS mq FROM front")
def pareto_front(spark, sf_dir):
    rows = candidates(spark, sf_dir).where("seed_ari >= 0.2 and min_size >= 5 and k between 2 and 4")
    return rounded(partitions.pareto(rows, "partition", {"sw": 1, "mq": 1}).select("partition", "k", "sw", "mq"), "sw", "mq")


@query(f"""WITH {_CAND}, {_ADM}, rk AS (SELECT *, 1.0 * (rank() OVER (ORDER BY osw) + (count(*) OVER (PARTITION BY osw) - 1) / 2) + 2.0 * (rank() OVER (ORDER BY mq) + (count(*) OVER (PARTITION BY mq) - 1) / 2) AS rank_sum FROM front)
SELECT partition, rk.rank_sum IS NOT NULL AS on_front, CAST(rank_sum AS DOUBLE) AS rank_sum, CAST(CASE WHEN rank_sum IS NOT NULL THEN row_number() OVER (ORDER BY rank_sum DESC NULLS LAST, adm.seed_ari DESC, partition) END AS INT) AS place FROM adm LEFT JOIN (SELECT partition, rank_sum FROM rk) rk USING (partition)""")
def variant_selection(spark, sf_dir):
    allowed = (F.col("seed_ari") >= 0.2) & (F.col("min_size") >= 5) & F.col("k").between(2, 4)
    return partitions.select_variant(candidates(spark, sf_dir), "partition", allowed, {"sw": 1, "mq": 1}, [("sw", 1, 1.0), ("mq", 1, 2.0)], [("seed_ari", 1)])


@query(f"""WITH {_CAND}, g AS (SELECT key, sin(key * 1.7) AS sw, cos(key * 2.3) AS ch, sin(key * 3.1) AS sdbw, key % 4 <> 3 AS ok FROM cand WHERE key BETWEEN 2 AND 12),
u AS (SELECT key, 'a' AS f, sw AS v FROM g UNION ALL SELECT key, 'a', ch FROM g UNION ALL SELECT key, 'b', -sdbw FROM g), w AS (SELECT key, 'a' AS f, sw > lag(sw) OVER (ORDER BY key) AND sw > lead(sw) OVER (ORDER BY key) AS up FROM g UNION ALL SELECT key, 'a', ch > lag(ch) OVER (ORDER BY key) AND ch > lead(ch) OVER (ORDER BY key) FROM g UNION ALL SELECT key, 'b', -sdbw > lag(-sdbw) OVER (ORDER BY key) AND -sdbw > lead(-sdbw) OVER (ORDER BY key) FROM g),
vt AS (SELECT key, count(DISTINCT f) AS votes FROM w WHERE up GROUP BY key), r AS (SELECT key, ok AS admissible, coalesce(votes, 0) AS votes, sw FROM g LEFT JOIN vt USING (key)),
one AS (SELECT coalesce(max(key) FILTER (WHERE admissible AND votes >= 2), arg_max(key, sw) FILTER (WHERE admissible)) AS best FROM r) SELECT key AS k, admissible, votes, key = best AS chosen FROM r, one""")
def k_selection(spark, sf_dir):
    n = F.col("key")
    rows = candidates(spark, sf_dir).where("key between 2 and 12").select(n.alias("k"), F.sin(n * 1.7).alias("sw"), F.cos(n * 2.3).alias("ch"), F.sin(n * 3.1).alias("sdbw"))
    return partitions.select_k(rows, "k", {"sw": 1, "ch": 1, "sdbw": -1}, F.col("k") % 4 != 3, "sw", {"sw": "a", "ch": "a"})


@query(f"""WITH {_CAND}, o AS (SELECT key * 0.01::DOUBLE AS omega, 0.5 - key * 0.004 + (key % 3) * 0.01 AS mq FROM cand), e AS (SELECT omega, mq, (SELECT mq FROM o WHERE omega = 0) AS base FROM o)
SELECT round(omega, 6) AS omega, round(mq, 6)::DOUBLE AS mq, round(1 - mq / base, 6)::DOUBLE AS "drop", mq >= 0.9 * base AS eligible, omega = (SELECT max(omega) FROM e WHERE mq >= 0.9 * base) AS selected FROM e""")
def omega_selection(spark, sf_dir):
    n = F.col("key")
    rows = candidates(spark, sf_dir).select((n * 0.01).alias("omega"), (F.lit(0.5) - n * 0.004 + (n % 3) * 0.01).alias("mq"))
    return rounded(partitions.select_omega(rows, "omega", "mq", 0.1), "omega", "mq", "drop")


_AXES = [("sw", "role_a", 1), ("mq", "role_b", 1), ("sdbw", "role_a", -1), ("flat", "role_b", 1)]
_POOL = """po AS (SELECT 'sw' AS axis, partition, sw AS value, sw AS score FROM cand WHERE k = 3 AND min_size >= 4 AND role_a IN ('year_2024', 'external') AND sw IS NOT NULL UNION ALL SELECT 'mq', partition, mq, mq FROM cand WHERE k = 3 AND min_size >= 4 AND role_b IN ('year_2024', 'external')
UNION ALL SELECT 'sdbw', partition, sdbw, -sdbw FROM cand WHERE k = 3 AND min_size >= 4 AND role_a IN ('year_2024', 'external') AND sdbw IS NOT NULL UNION ALL SELECT 'flat', partition, flat, flat FROM cand WHERE k = 3 AND min_size >= 4 AND role_b IN ('year_2024', 'external')),
pool AS (SELECT *, count(*) OVER (PARTITION BY axis) AS candidates FROM po QUALIFY candidates >= 2)"""


@query(f"WITH {_CAND}, {_POOL} SELECT axis, partition, round(value, 6) AS value, candidates FROM pool WHERE axis <> 'flat' QUALIFY row_number() OVER (PARTITION BY axis ORDER BY score DESC, partition DESC) = 1")
def axis_winners(spark, sf_dir):
    return rounded(partitions.winners(candidates(spark, sf_dir), _AXES, 3, 4), "value")


@query(f"""WITH {_CAND}, {_POOL}, p AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY score DESC, partition) AS p FROM pool), m AS (SELECT partition, round(avg(p), 3) AS mean_rank, count(*) AS n_axes FROM p GROUP BY partition)
SELECT partition, mean_rank, n_axes, CAST(row_number() OVER (ORDER BY mean_rank, n_axes DESC, partition) AS INT) AS place FROM m""")
def neutral_rank(spark, sf_dir):
    return partitions.neutral_rank(candidates(spark, sf_dir), _AXES, 3, 4)


@query(f"""WITH {_L}, ce AS (SELECT 'base' AS run, label AS track, key AS id, t FROM lab UNION ALL SELECT 'odd', CASE WHEN key % 3 = 0 THEN 'x' ELSE label END, key, t FROM lab UNION ALL SELECT 'late', label, key, t + 1 FROM lab),
n AS (SELECT run, track, count(*) AS n FROM ce GROUP BY ALL), cm AS (SELECT x.track, y.run, y.track AS other, count(*) AS c FROM ce x JOIN ce y ON x.id = y.id AND x.t = y.t AND x.run = 'base' AND y.run <> 'base' GROUP BY ALL)
SELECT a.track, a.n AS n_cells, r.run, round(coalesce(max(c / (a.n + b.n - c)), 0), 6) AS jaccard FROM n a CROSS JOIN (SELECT DISTINCT run FROM ce WHERE run <> 'base') r LEFT JOIN cm ON cm.track = a.track AND cm.run = r.run LEFT JOIN n b ON b.run = cm.run AND b.track = cm.other WHERE a.run = 'base' GROUP BY ALL""")
def track_recurrence(spark, sf_dir):
    base = daily_labels(spark, sf_dir).select(F.lit("base").alias("run"), F.col("label").alias("track"), F.col("key").alias("id"), "t")
    odd = base.select(F.lit("odd").alias("run"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("track")).alias("track"), "id", "t")
    late = base.select(F.lit("late").alias("run"), "track", "id", (F.col("t") + 1).alias("t"))
    return rounded(partitions.best_track_match(base.unionByName(odd).unionByName(late), "base"), "jaccard")


@query(f"""WITH {_L}, sr AS (SELECT unnest(range(3)) AS run), ch AS (SELECT run, t, key AS id, (key + t * run) % 4 < 3 AS changed, (key * 7 + t + run) % 5 = 0 AS ambiguous FROM lab, sr)
SELECT t, id, count(*) FILTER (WHERE changed AND NOT ambiguous) AS votes, count(*) FILTER (WHERE ambiguous) AS n_ambiguous, count(*) FILTER (WHERE changed AND NOT ambiguous) = 3 AS unanimous FROM ch GROUP BY ALL""")
def transition_votes(spark, sf_dir):
    runs = daily_labels(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumnRenamed("key", "id")
    changes = runs.select("run", "t", "id", ((F.col("id") + F.col("t") * F.col("run")) % 4 < 3).alias("changed"), ((F.col("id") * 7 + F.col("t") + F.col("run")) % 5 == 0).alias("ambiguous"))
    return partitions.transition_votes(changes)


#: Five frozen scales; the direction along which a common denominator moves.
_IQR = [0.5, 0.8, 1.1, 0.7, 0.9]
_UNIT = [x / (sum((1 / y) ** 2 for y in _IQR) ** 0.5) for x in [1 / y for y in _IQR]]


@query(f"""WITH {_G}, u AS (SELECT id, cluster, dim, x FROM v WHERE dim <= 5 UNION ALL SELECT id, cluster, -1, sum(x * ([{', '.join(f'{x!r}::DOUBLE' for x in _UNIT)}])[dim]) FROM v WHERE dim <= 5 GROUP BY id, cluster),
per AS (SELECT cluster, dim, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM u GROUP BY ALL), sx AS (SELECT dim, sum(n * (m - g) ** 2) AS b, sum(w) AS w FROM per JOIN (SELECT dim, avg(x) AS g FROM u GROUP BY dim) USING (dim) GROUP BY dim),
o AS (SELECT sum(b + w) FILTER (WHERE dim > 0) AS t, sum(b + w) FILTER (WHERE dim = -1) AS a, sum(b) FILTER (WHERE dim > 0) AS bt, sum(b) FILTER (WHERE dim = -1) AS ba FROM sx)
SELECT round(t, 6) AS total_ss, round(a, 6) AS axis_total_ss, round(bt, 6) AS between_ss, round(ba, 6) AS axis_between_ss, round(a / t, 6) AS axis_total_fraction, round(ba / bt, 6) AS axis_between_fraction, round(ba / a, 6) AS axis_eta_squared FROM o""")
def axis_decomposition(spark, sf_dir):
    cut = vectors(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 5))
    found = partitions.axis_decomposition(cut, labels(spark, sf_dir), [1 / x for x in _IQR])
    return rounded(found, *found.columns)


@query("""WITH x AS (SELECT vec_id AS id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings), k AS (SELECT a.label % 2 AS s, b.label % 2 AS t, avg(exp(-(list_distance(a.v, b.v) ** 2) / (2 * 1.5 * 1.5))) AS m FROM x a, x b GROUP BY ALL)
SELECT round((SELECT m FROM k WHERE s = 0 AND t = 0) + (SELECT m FROM k WHERE s = 1 AND t = 1) - 2 * (SELECT m FROM k WHERE s = 0 AND t = 1), 6) AS mmd2""")
def gaussian_mmd(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rounded(partitions.mmd2(rows.where("label % 2 = 0").drop("label"), rows.where("label % 2 = 1").drop("label"), 1.5), "mmd2")


# --- indices by period -----------------------------------------------------------------

_PERIODS = {"p0": "label", "p1": "label % 5", "p2": "0", "p3": "label // 2"}
_PERIOD_SQL = " UNION ALL ".join(f"SELECT '{name}' AS period, vec_id AS id, ({expr})::BIGINT AS cluster FROM embeddings" for name, expr in _PERIODS.items())
_MONTHLY = f"""{_G}, pt AS ({_PERIOD_SQL}), bp AS (SELECT x.period, x.cluster AS ci, y.cluster AS cj, count(*)::DOUBLE AS b FROM m JOIN pt x ON src = x.id JOIN pt y ON dst = y.id AND x.period = y.period GROUP BY ALL),
pe AS (SELECT period, ci, coalesce(sum(b) FILTER (WHERE ci = cj), 0) AS i, sum(b) AS s FROM bp GROUP BY ALL), ix AS (SELECT period, count(*) AS k, CASE WHEN count(*) > 1 THEN avg(i / s) END AS avi, CASE WHEN count(*) > 1 THEN sum(i / t - (s / t) ** 2) END AS newman_q FROM pe JOIN (SELECT period, sum(s) AS t FROM pe GROUP BY period) USING (period) GROUP BY period)"""


def period_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, out = materialize(knn_edges(spark, sf_dir), "edges"), None
    for name, expr in _PERIODS.items():
        own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(expr.replace("//", "div")).cast("long").alias("cluster"))
        row = graph.network_indices(graph.block_sums(edges, own), own).select(F.lit(name).alias("period"), "k", "avi", "newman_q")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_MONTHLY} SELECT period, k, round(avi, 6) AS avi, round(newman_q, 6) AS newman_q FROM ix")
def period_quality(spark, sf_dir):
    return rounded(period_indices(spark, sf_dir), "avi", "newman_q")


@query(f"WITH {_MONTHLY} SELECT count(*) AS n_rows, round(avg(avi), 6) AS avi, count(avi) AS avi_valid, round(avg(newman_q), 6) AS newman_q, count(newman_q) AS newman_q_valid FROM ix")
def quality_summary(spark, sf_dir):
    return rounded(partitions.mean_valid(period_indices(spark, sf_dir), ["avi", "newman_q"]), "avi", "newman_q")


@query(f"""WITH {_G}, pt AS ({_PERIOD_SQL}), x AS (SELECT a.period AS p, a.id, a.cluster AS la, b.cluster AS lb FROM pt a JOIN pt b USING (id) WHERE b.period = 'p' || (a.period[2]::INT + 1)), c AS (SELECT p, la, lb, count(*) AS n FROM x GROUP BY ALL),
q AS (SELECT p, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c GROUP BY p), qa AS (SELECT p, sum(z * (z - 1) / 2) AS sa FROM (SELECT p, la, sum(n) AS z FROM c GROUP BY ALL) GROUP BY p), qb AS (SELECT p, sum(z * (z - 1) / 2) AS sb FROM (SELECT p, lb, sum(n) AS z FROM c GROUP BY ALL) GROUP BY p)
SELECT 'p' || (p[2]::INT + 1) AS period, round(CASE WHEN (sa + sb) / 2 = sa * sb / (t * (t - 1) / 2) THEN 1 ELSE (s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) END, 6) AS ari_previous FROM q JOIN qa USING (p) JOIN qb USING (p)""")
def previous_agreement(spark, sf_dir):
    out, names = None, list(_PERIODS)
    for before, after in zip(names, names[1:], strict=False):
        cut = lambda name: F.expr(_PERIODS[name].replace("//", "div")).cast("long")
        pairs = table(spark, sf_dir, "embeddings").select(cut(before).alias("a"), cut(after).alias("b"))
        row = graph.agreement(pairs, "a", "b").select(F.lit(after).alias("period"), F.col("ari").alias("ari_previous"))
        out = row if out is None else out.unionByName(row)
    return rounded(out, "ari_previous")
