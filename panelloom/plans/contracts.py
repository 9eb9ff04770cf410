"""Queries of contracts, verified joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import text
from panelloom.operators import contracts
from panelloom.plans.queries import _G, knn_edges, labels
from panelloom.plans.registry import query, rounded, table
from panelloom.sources.shared import materialize

# --- a panel of customers by month of order, with faults ---------------------------------

_PN = """pn AS (SELECT DISTINCT CASE WHEN o_custkey % 97 = 5 THEN '' ELSE 'tid_' || o_custkey END AS entity_id, CASE WHEN o_custkey % 89 = 7 THEN '0' || o_custkey WHEN o_custkey % 83 = 11 THEN 'x' || o_custkey ELSE o_custkey::VARCHAR END AS territory_id,
strftime(o_orderdate, '%Y-%m-') || CASE WHEN o_custkey % 79 = 3 THEN '02' ELSE '01' END AS period FROM orders), pr AS (SELECT * FROM pn UNION ALL SELECT * FROM pn WHERE territory_id LIKE '%77')"""


def faulty_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    name = key.cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.when(key % 97 == 5, "").otherwise(F.concat(F.lit("tid_"), name)).alias("entity_id"),
        F.when(key % 89 == 7, F.concat(F.lit("0"), name)).when(key % 83 == 11, F.concat(F.lit("x"), name)).otherwise(name).alias("territory_id"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.when(key % 79 == 3, "02").otherwise("01")).alias("period"),
    ).distinct()
    return rows.unionByName(rows.where("territory_id like '%77'"))


@query(f"""WITH {_PN}, m AS (SELECT unnest(['1995-01-01', '1995-02-01', '1890-01-01']) AS p), z AS (SELECT DISTINCT entity_id, regexp_replace(territory_id, '^0+(.)', '\\1') AS n FROM pr)
SELECT count(*) FILTER (WHERE entity_id = '') AS bad_entity, count(*) FILTER (WHERE NOT regexp_full_match(period, '[0-9]{{4}}-[0-9]{{2}}-01')) AS bad_period, count(*) FILTER (WHERE NOT regexp_full_match(territory_id, '[0-9]+')) AS bad_territory,
count(*) FILTER (WHERE entity_id <> 'tid_' || regexp_replace(territory_id, '^0+(.)', '\\1')) AS wrong_entity, count(*) - count(DISTINCT (entity_id, period)) AS duplicate_keys, abs(count(DISTINCT entity_id) - 1000) AS entity_count_off,
count(DISTINCT period) FILTER (WHERE period NOT IN (SELECT p FROM m)) + 3 - count(DISTINCT period) FILTER (WHERE period IN (SELECT p FROM m)) AS months_off,
(SELECT count(*) FROM (SELECT entity_id FROM z GROUP BY entity_id HAVING count(*) > 1)) AS many_entity_id, (SELECT count(*) FROM (SELECT n FROM z GROUP BY n HAVING count(*) > 1)) AS many_territory FROM pr""")
def panel_contract(spark, sf_dir):
    return contracts.panel_contract(faulty_panel(spark, sf_dir), 1000, ["1995-01-01", "1995-02-01", "1890-01-01"])


@query(f"""WITH {_G}, dr AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, CASE WHEN src % 50 = 3 THEN weight / 2 WHEN src % 50 = 4 THEN -1 ELSE weight END FROM e WHERE src % 50 <> 5 UNION ALL SELECT id, id, 1 FROM l WHERE cluster = 0 UNION ALL SELECT 7, -1, 1 UNION ALL SELECT -1, 7, 1),
su AS (SELECT src, dst, sum(weight) AS w FROM dr WHERE src <> dst GROUP BY ALL HAVING sum(weight) <> 0)
SELECT (SELECT count(*) FROM dr WHERE src = dst) AS loops, (SELECT count(*) FROM dr WHERE weight < 0) AS bad_weight, (SELECT count(*) FROM su a FULL JOIN su b ON a.src = b.dst AND a.dst = b.src WHERE a.w IS NULL OR b.w IS NULL OR a.w <> b.w) AS asymmetric,
(SELECT count(*) FROM (SELECT src AS id FROM dr UNION ALL SELECT dst FROM dr) WHERE id NOT IN (SELECT id FROM l)) AS unknown_nodes""")
def graph_contract(spark, sf_dir):
    edges = materialize(knn_edges(spark, sf_dir), "edges")
    s = F.col("src")
    back = edges.where(s % 50 != 5).select(F.col("dst").alias("src"), s.alias("dst"), F.when(s % 50 == 3, F.col("weight") / 2).when(s % 50 == 4, -1.0).otherwise(F.col("weight")).alias("weight"))
    own = labels(spark, sf_dir)
    loops = own.where("cluster = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    lost = spark.createDataFrame([(7, -1, 1.0), (-1, 7, 1.0)], "src long, dst long, weight double")
    return contracts.graph_contract(edges.unionByName(back).unionByName(loops).unionByName(lost), own)


@query("""WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 61 <> 8 THEN label END AS cluster FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 71 = 2 UNION ALL SELECT NULL, 3)
SELECT count(*) FILTER (WHERE id IS NULL) AS missing_id, count(*) FILTER (WHERE cluster IS NULL) AS missing_label, count(id) - count(DISTINCT id) AS repeated_id, CAST(count(DISTINCT cluster) < 2 AS INT) AS too_few_clusters, CAST(count(DISTINCT cluster) >= count(*) AS INT) AS too_many_clusters FROM p""")
def label_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    faulty = rows.withColumn("cluster", F.when(F.col("id") % 61 != 8, F.col("cluster"))).unionByName(rows.where("id % 71 = 2"))
    none = spark.createDataFrame([(None, 3)], "id long, cluster int").withColumn("cluster", F.col("cluster").cast(rows.schema["cluster"].dataType))
    return contracts.label_contract(faulty.unionByName(none))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-01') AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS place FROM orders WHERE strftime(o_orderdate, '%Y-%m-01') BETWEEN '1996-03-01' AND '1998-02-01'")
def month_window(spark, sf_dir):
    return contracts.month_window(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-01").alias("period")), "1996-03-01", "1998-02-01")


_NM = "nm AS (SELECT CASE WHEN o_custkey % 211 = 9 THEN NULL ELSE 'c' || o_custkey // 5 END AS name, o_orderkey // 3 AS k, CASE WHEN o_orderkey % 1009 = 1 THEN -1 ELSE o_totalprice END AS v FROM orders)"


@query(f"""WITH {_NM}, c AS (SELECT *, count(*) OVER (PARTITION BY name, k) AS n FROM nm), f AS (SELECT name, CASE WHEN name IS NULL THEN 'missing_name' WHEN max(n) > 1 THEN 'duplicate_key' WHEN max(CASE WHEN v > 0 THEN 0 ELSE 1 END) = 1 THEN 'bad_value' END AS reason FROM c GROUP BY name)
SELECT coalesce(reason, 'kept') AS reason, count(DISTINCT nm.name) AS names, count(*) AS n_rows FROM nm JOIN f ON nm.name IS NOT DISTINCT FROM f.name GROUP BY ALL""")
def whole_names(spark, sf_dir):
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(key % 211 != 9, F.concat(F.lit("c"), F.floor(key / 5).cast("string"))).alias("name"), F.floor(order / 3).alias("k"), F.when(order % 1009 == 1, -1.0).otherwise(F.col("o_totalprice")).alias("v"))
    kept, faults = contracts.whole_names(rows, "name", ["k"], ~(F.col("v") > 0))
    faults = faults.withColumnRenamed("name", "faulty")
    dropped = rows.join(faults, F.col("name").eqNullSafe(F.col("faulty"))).select("name", "reason")
    return kept.select("name", F.lit("kept").alias("reason")).unionByName(dropped).groupBy("reason").agg(F.count_distinct("name").alias("names"), F.count("*").alias("n_rows"))


_PC = "c0 AS (SELECT c_custkey AS id, c_custkey // 2 AS a, (c_custkey * 7 + 3) % 311 AS b FROM customer WHERE c_acctbal > 3000)"
_ROUNDS = 40


@query(
    f"WITH {_PC}, "
    + ", ".join(f"c{i + 1} AS (SELECT id, a, b FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM c{i}) WHERE na >= 2 AND nb >= 2)" for i in range(_ROUNDS))
    + f" SELECT id, a, b FROM c{_ROUNDS}"
)
def peer_cohort(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("a"), ((F.col("c_custkey") * 7 + 3) % 311).alias("b"))
    return contracts.peer_cohort(rows, ["a", "b"])


@query("SELECT c_custkey, c_acctbal, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def one_to_one_join(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return rounded(contracts.one_to_one(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), sums, ["c_custkey"]), "total", places=2)


@query("""SELECT s_suppkey, s_nationkey, upper(n_name) = n_name AS name_verified, coalesce(s_acctbal > 0, false) AS value_verified, n_regionkey <> 2 AS region_verified, upper(n_name) = n_name AND s_acctbal > 0 AND n_regionkey <> 2 AS join_verified
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def verified_join(spark, sf_dir):
    checks = {"name_verified": F.upper("n_name") == F.col("n_name"), "value_verified": F.col("s_acctbal") > 0, "region_verified": F.col("n_regionkey") != 2}
    registry = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    found = contracts.verified_join(table(spark, sf_dir, "supplier"), registry, "s_nationkey", checks)
    return found.select("s_suppkey", "s_nationkey", *checks, "join_verified")


@query("""WITH s AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) SELECT 'in' AS side, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM s
UNION ALL SELECT 'out', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def membership_split(spark, sf_dir):
    members = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    inside, outside = contracts.split_membership(table(spark, sf_dir, "customer"), members, "c_custkey")
    total = lambda t, side: t.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return total(inside, "in").unionByName(total(outside, "out"))


@query("""WITH co AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'город ' ELSE '' END || 'Место' || c_custkey // 4 AS name FROM customer), ar AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'муниципальный район ' ELSE '' END || 'Место' || o_custkey // 4 AS area FROM orders),
st AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), 'внутригородская территория города федерального значения|муниципальный район|муниципальный округ|городской округ|город|поселок', ' ', 'g'), ' +', ' ', 'g')) AS s FROM co),
sa AS (SELECT *, trim(regexp_replace(regexp_replace(lower(area), 'внутригородская территория города федерального значения|муниципальный район|муниципальный округ|городской округ|город|поселок', ' ', 'g'), ' +', ' ', 'g')) AS s FROM ar),
ex AS (SELECT name, count(*) AS n, min(entity_id) AS e FROM co GROUP BY name), ss AS (SELECT s, count(*) AS n, min(entity_id) AS e FROM st GROUP BY s)
SELECT area, CASE WHEN ex.n = 1 THEN ex.e WHEN ex.n IS NULL AND ss.n = 1 THEN ss.e END AS entity_id FROM sa LEFT JOIN ex ON ex.name = area LEFT JOIN ss ON ss.s = sa.s""")
def name_matching(spark, sf_dir):
    key = F.col("c_custkey")
    cohort = table(spark, sf_dir, "customer").select(key.alias("entity_id"), F.concat(F.when(key % 3 == 0, "город ").otherwise(""), F.lit("Место"), F.floor(key / 4).cast("string")).alias("name"))
    areas = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "муниципальный район ").otherwise(""), F.lit("Место"), F.floor(F.col("o_custkey") / 4).cast("string")).alias("area"))
    return contracts.match_names(areas, cohort, text.stem)


_BR = """sr AS (SELECT lpad((10000000 + o_custkey % 700)::VARCHAR, 8, '0') || '000' AS full_code, CASE WHEN o_orderkey % 13 <> 4 THEN (o_custkey % 700 + CASE WHEN o_orderkey % 199 = 3 THEN 1 ELSE 0 END)::DOUBLE END AS value, CASE WHEN o_custkey % 700 % 31 = 6 THEN 'odd' ELSE '' END AS comment FROM orders),
so AS (SELECT substr(full_code, 1, 8) AS code, CASE WHEN substr(full_code, 1, 8)::INT % 37 = 0 THEN NULL ELSE value END AS value, comment FROM sr), en AS (SELECT c_custkey AS entity_id, (10000000 + c_custkey)::VARCHAR AS code FROM customer)"""


@query(f"""WITH {_BR}, p AS (SELECT code, count(*) FILTER (WHERE comment = 'odd') AS odd, count(DISTINCT value) FILTER (WHERE comment <> 'odd') AS n, max(value) FILTER (WHERE comment <> 'odd') AS v FROM so GROUP BY code),
t AS (SELECT entity_id, code, v, CASE WHEN n IS NULL THEN 'no_code_match' WHEN n = 0 AND odd > 0 THEN 'flagged_anomalous' WHEN n = 0 THEN 'empty_in_source' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM en LEFT JOIN p USING (code)) SELECT entity_id, code, CASE WHEN status = 'matched' THEN v END AS value, status FROM t""")
def code_bridge(spark, sf_dir):
    key, order = F.col("o_custkey") % 700, F.col("o_orderkey")
    code = text.municipal_code(F.concat((key + 10000000).cast("string"), F.lit("000")))
    value = F.when(order % 13 != 4, (key + F.when(order % 199 == 3, 1).otherwise(0)).cast("double"))
    source = table(spark, sf_dir, "orders").select(code.alias("code"), value.alias("value"), F.when(key % 31 == 6, "odd").otherwise("").alias("comment"))
    source = source.withColumn("value", F.when(F.col("code").cast("int") % 37 != 0, F.col("value")))
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") + 10000000).cast("string").alias("code"))
    return contracts.bridge_values(entities, source, "odd")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY ALL), b AS (SELECT c_custkey AS k, 1 AS n FROM customer WHERE c_acctbal > 0)
SELECT count(*) FILTER (WHERE b.n IS NULL) AS only_first, count(*) FILTER (WHERE a.n IS NULL) AS only_second, count(*) FILTER (WHERE a.n > 1) AS repeated_first, count(*) FILTER (WHERE b.n > 1) AS repeated_second FROM a FULL JOIN b USING (k)""")
def endpoint_alignment(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    return contracts.align(a, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT conflicting_key, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS conflicting_key FROM lineitem) GROUP BY ALL")
def conflict_flags(spark, sf_dir):
    return contracts.conflict_flag(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").groupBy("conflicting_key").agg(F.count("*").alias("n"))


# --- scalar functions ------------------------------------------------------------------

_TOKENS = ["", "...", "x", "SD", "ND", "-", "12 345,5", " 7 ", "abc", "-3,25", "1e5", "+.5", "0", "–", "1,2,3"]
_TK = f"tk AS (SELECT o_orderkey AS id, (['{chr(39).join([]) + (chr(39) + ', ' + chr(39)).join(_TOKENS)}'])[o_orderkey % {len(_TOKENS)} + 1] || CASE WHEN o_orderkey % {len(_TOKENS)} = 6 THEN (o_orderkey % 10)::VARCHAR ELSE '' END AS t FROM orders)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("o_orderkey"), len(_TOKENS)
    token = F.element_at(F.array(*map(F.lit, _TOKENS)), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.concat(token, F.when(key % n == 6, (key % 10).cast("string")).otherwise("")).alias("t"))


_NUM = "replace(replace(trim(regexp_replace(t, ' +', ' ', 'g')), ' ', ''), ',', '.')"


@query(f"""WITH {_TK}, c AS (SELECT id, trim(regexp_replace(t, ' +', ' ', 'g')) AS t, {_NUM} AS p FROM tk), s AS (SELECT id, CASE WHEN t = '' THEN 'missing' WHEN t IN ('...', '…', 'х', 'x', 'X', 'Х') THEN 'suppressed' WHEN t IN ('SD', 'UD') THEN 'suppressed_or_unknown' WHEN t IN ('ND', 'CD', 'NR') THEN 'not_reported' WHEN t IN ('-', '–', '—') THEN 'not_applicable_or_absent'
WHEN regexp_full_match(p, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN 'observed' ELSE 'unparsed' END AS status, p FROM c) SELECT id, CASE WHEN status = 'observed' THEN ltrim(p, '+')::DOUBLE END AS value, status FROM s""")
def number_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("id", text.number_status(F.col("t")).alias("x")).select("id", "x.value", "x.status")


@query(f"""WITH {_TK}, c AS (SELECT id, trim(t) AS t, try_cast(ltrim({_NUM}, '+') AS DOUBLE) AS p FROM tk), s AS (SELECT id, p, CASE WHEN lower(t) IN ('', '...', '…', 'x', 'х', 'na', 'n/a', 'null', 'none') THEN 'missing_or_suppressed' WHEN upper(t) IN ('SD', 'UD', 'ND', 'CD', 'NR') THEN 'source_marker_' || upper(t) WHEN t IN ('-', '–', '—') THEN 'not_applicable_or_absent'
WHEN p IS NULL THEN 'invalid_numeric' WHEN p = 0 THEN 'zero' WHEN p < 0 THEN 'negative' ELSE 'observed' END AS status FROM c) SELECT id, round(CASE WHEN status = 'observed' THEN ln(p) END, 6) AS value, status FROM s""")
def wage_tokens(spark, sf_dir):
    return rounded(tokens(spark, sf_dir).select("id", text.wage_status(F.col("t")).alias("x")).select("id", "x.value", "x.status"), "value")


@query("""WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Город  Ёлкин ' WHEN 1 THEN 'муниципальный район Орёл-' WHEN 2 THEN 'г. Минск (до 2015 года) ' WHEN 3 THEN 'ЗАТО Звёздный ' ELSE 'Supplier ' END || s_suppkey AS name FROM supplier),
a AS (SELECT id, replace(trim(regexp_replace(lower(name), ' +', ' ', 'g')), 'ё', 'е') AS t FROM n), b AS (SELECT id, regexp_replace(t, '\\((до|с) [0-9][^)]*\\)', ' ', 'g') AS t FROM a), c AS (SELECT id, replace(replace(replace(t, 'муниципальный район', ' '), 'городской округ', ' '), 'муниципальный округ', ' ') AS t FROM b),
d AS (SELECT id, ' ' || regexp_replace(t, '([^0-9a-zа-я])', ' \\1 ', 'g') || ' ' AS t FROM c), e AS (SELECT id, regexp_replace(t, ' (город|район|г|зато) ', '  ', 'g') AS t FROM d) SELECT id, regexp_replace(t, '[^а-яa-z0-9]', '', 'g') AS key FROM e""")
def name_keys(spark, sf_dir):
    n = F.col("s_suppkey")
    name = F.concat(F.when(n % 5 == 0, "Город  Ёлкин ").when(n % 5 == 1, "муниципальный район Орёл-").when(n % 5 == 2, "г. Минск (до 2015 года) ").when(n % 5 == 3, "ЗАТО Звёздный ").otherwise("Supplier "), n.cast("string"))
    return table(spark, sf_dir, "supplier").select(n.alias("id"), text.name_key(name).alias("key"))


_KINDS = """cp AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'Среднемесячная заработная плата работников организаций  (без субъектов малого предпринимательства)' WHEN 1 THEN 'Среднемесячная заработная плата работников организаций' WHEN 2 THEN 'Среднесписочная численность работников организаций (без субъектов малого)' WHEN 3 THEN 'Оценка численности населения на 1 января текущего года'
WHEN 4 THEN 'Численность всего населения по полу и возрасту на 1 января текущего года, человек' WHEN 5 THEN 'Среднемесячная номинальная начисленная заработная плата работников крупных' ELSE p_name END AS t, CASE p_partkey % 4 WHEN 0 THEN 'Раздел А Сельское' WHEN 1 THEN 'Раздел C Добыча' WHEN 2 THEN 'Раздел' ELSE 'Раздел О  прочее' END AS s FROM part)"""


@query(f"""WITH {_KINDS}, c AS (SELECT id, trim(regexp_replace(lower(t), ' +', ' ', 'g')) AS t, s FROM cp) SELECT id, CASE WHEN starts_with(t, 'среднемесячная заработная плата работников организаций') AND contains(t, 'без субъектов малого') THEN 'wage' WHEN starts_with(t, 'среднесписочная численность работников организаций') AND contains(t, 'без субъектов малого') THEN 'headcount'
WHEN starts_with(t, 'среднемесячная номинальная начисленная заработная плата работников крупных') THEN 'efficiency_wage' WHEN t = 'оценка численности населения на 1 января текущего года' THEN 'population' WHEN starts_with(t, 'численность всего населения по полу и возрасту на 1 января текущего года') THEN 'population_age_sex' END AS kind,
nullif(translate(regexp_extract(s, '^Раздел +([^ ]) ', 1), 'АВЕНСО', 'ABEHCO'), '') AS letter FROM c""")
def indicator_kinds(spark, sf_dir):
    key = F.col("p_partkey")
    captions = [text.WAGE.capitalize() + "  (" + text.NO_SMALL + " предпринимательства)", text.WAGE.capitalize(), text.HEADCOUNT.capitalize() + " (" + text.NO_SMALL + ")", text.POPULATION.capitalize(), text.POPULATION_AGE_SEX.capitalize() + ", человек", text.EFFICIENCY_WAGE.capitalize()]
    caption = F.when(key % 7 == 6, F.col("p_name")).otherwise(F.element_at(F.array(*map(F.lit, [*captions, ""])), (key % 7 + 1).cast("int")))
    section = F.element_at(F.array(*map(F.lit, ["Раздел А Сельское", "Раздел C Добыча", "Раздел", "Раздел О  прочее"])), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("id"), text.indicator_kind(caption).alias("kind"), text.section_letter(section).alias("letter"))


@query("""SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, CAST(year(o_orderdate + INTERVAL 3 HOUR) AS INT) AS local_year FROM orders""")
def month_starts(spark, sf_dir):
    month = F.date_trunc("month", "o_orderdate")
    # the start of a month in Moscow as a UTC stamp, for every other row a plain date
    stamp = F.concat(F.date_format(F.to_utc_timestamp(month, "Europe/Moscow"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    given = F.when(F.col("o_orderkey") % 2 == 0, stamp).otherwise(F.date_format(month, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.month_start(given).alias("period"), text.local_year(F.col("o_orderdate")).alias("local_year"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents""")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("sha"))


@query("""SELECT c_custkey AS id, replace(replace(replace(format('{:,.1f}', c_acctbal), ',', '_'), '.', ','), '_', ' ') AS number, (['янв', 'фев', 'мар', 'апр', 'май', 'июн', 'июл', 'авг', 'сен', 'окт', 'ноя', 'дек'])[c_custkey % 12 + 1] || ' 2023' AS month,
round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 3 END, 6) AS clean FROM customer""")
def formatted_values(spark, sf_dir):
    key, v = F.col("c_custkey"), F.col("c_acctbal")
    period = F.concat(F.lit("2023-"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("-01"))
    odd = F.when(v > 0, v / 3).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "customer").select(key.alias("id"), text.formatted_number(v, 1).alias("number"), text.formatted_month(period).alias("month"), text.rounded_or_null(odd).alias("clean"))


@query("""WITH p AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey * 13 % 170)::DOUBLE AS lon, (40 + n_nationkey * 7 % 40)::DOUBLE AS lat FROM nation), k AS (SELECT (sin(radians(50)) + sin(radians(70))) / 2 AS n), c AS (SELECT n, cos(radians(50)) ** 2 + 2 * n * sin(radians(50)) AS c FROM k),
r AS (SELECT id, sqrt(c - 2 * n * sin(radians(lat))) / n AS rho, n * radians(lon - 100) AS th, sqrt(c - 2 * n * sin(radians(40))) / n AS r0 FROM p, c) SELECT id, round(rho * sin(th), 6) AS x, round(rho * cos(th) - r0, 6) AS y FROM r""")
def albers_projection(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    x, y = text.albers((key * 13 % 170).cast("double"), (40 + key * 7 % 40).cast("double"))
    return rounded(table(spark, sf_dir, "nation").select(key.alias("id"), x.alias("x"), y.alias("y")), "x", "y")
