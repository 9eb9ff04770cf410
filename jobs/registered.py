"""The jobs as queries: each runs twice into a new shared folder and returns what then stands there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import monthly_panel, source_register
from panelloom.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1-monthly-panel")
    for _ in range(2):
        monthly_panel.run(spark, f"{sf_dir}/orders.parquet", f"{folder}/panel", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/panel").withColumn("period", F.col("period").cast("string"))


def job2_source_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2-source-register")
    for _ in range(2):
        source_register.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/register")
    return spark.read.parquet(f"{folder}/register")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_monthly_panel": job1_monthly_panel, "job2_source_register": job2_source_register}

ORACLE_SQL: dict[str, str] = {
    "job1_monthly_panel": """
WITH cells AS (
  SELECT o_custkey AS entity, o_orderpriority AS category, strftime(o_orderdate, '%Y-%m-01') AS period,
         sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n_orders
  FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
  GROUP BY ALL HAVING sum(round(o_totalprice * 100)::BIGINT) > 0)
SELECT entity, category, cents / 100 AS value, n_orders,
       round(cents / (sum(cents) OVER w)::DOUBLE, 9) AS share,
       round(sqrt(cents / (sum(cents) OVER w)::DOUBLE) / sqrt(2), 9) AS coordinate,
       count(*) OVER w = 5 AS complete, period
FROM cells WINDOW w AS (PARTITION BY entity, period)""",
    "job2_source_register": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha256
           FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
s AS (SELECT sha256, min(doc_id) AS first_doc_id, count(*) AS copies FROM d GROUP BY sha256),
i AS (SELECT doc_id, count(DISTINCT sha256) > 1 AS conflicting FROM d GROUP BY doc_id),
m AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT *, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: regexp_matches(x, '[0-9]')) AS tokens FROM d),
n AS (SELECT *, list_filter(list_transform(tokens, lambda x: replace(regexp_replace(x, '[\s\x{00A0}]+', '', 'g'), ',', '.')),
                            lambda x: regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') AND abs(try_cast(x AS DOUBLE)) < 1e20) AS numbers FROM t)
SELECT doc_id, lang, sha256, first_doc_id, copies, conflicting, length(text) AS chars,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines,
       len(tokens) AS digit_tokens, len(numbers) AS numbers, quality, toxic, source
FROM n JOIN s USING (sha256) JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
