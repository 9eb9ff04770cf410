"""Queries of sources and sinks: each writes files made of the driver's tables and reads them back."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.text import NO_SMALL, WAGE, territory_id
from panelloom.plans.registry import query, table
from panelloom.sources import archives, files, passports, sinks
from panelloom.sources.shared import materialize, shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_custkey::VARCHAR AS mo, strftime(date_trunc('month', o_orderdate), '%Y-%m-01') AS period, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def export_scan(spark, sf_dir):
    month = F.trunc("o_orderdate", "month").cast("timestamp") - F.expr("interval 3 hours")
    stamp = F.concat(F.date_format(month, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mo"), stamp.alias("period"), F.lit("all").alias("category_15"), F.col("o_totalprice").alias("value"), F.lit("A").alias("obs_status"), F.lit("руб.").alias("unit_measure"), F.lit(0).alias("unit_mult"), F.lit("Месяц").alias("freq"))
    path = _place(spark, "export")
    rows.write.csv(path, sep=";", header=True)
    return files.read_export(spark, path).groupBy("mo", "period").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT c_name || ', \"' || c_mktsegment || '\"' AS name, c_custkey::VARCHAR AS id, format('{:.6g}', c_acctbal) AS balance FROM customer")
def strict_table(spark, sf_dir):
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    rows = table(spark, sf_dir, "customer").select(name.alias("name"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("balance"))
    path = _place(spark, "table")
    sinks.write_csv(rows, path, line_end="\n", digits=6)
    return files.read_strict_csv(spark, path)


@query("""WITH r AS (SELECT DISTINCT l_partkey AS x, l_suppkey + 1000000 AS y FROM lineitem)
SELECT x AS a, y AS b, ((x * 7 + y) % 1000)::DOUBLE AS distance FROM r WHERE x % 5 <> 0 AND (x + y) % 3 <> 0""")
def road_scan(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("x"), (F.col("l_suppkey").cast("long") + 1_000_000).alias("y")).distinct()
    kind = F.when((F.col("x") + F.col("y")) % 3 == 0, "rail").otherwise("highway")
    # parts have even ids and suppliers odd ones, so that they differ however many there are
    part, supplier = 2 * F.col("x"), 2 * F.col("y") + 1
    rows = ends.select(supplier.alias("territory_id_x"), part.alias("territory_id_y"), kind.alias("type"), ((F.col("x") * 7 + F.col("y")) % 1000).cast("double").alias("distance"), F.lit("unread").alias("note"))
    path = _place(spark, "roads")
    rows.write.parquet(path)
    cohort = ends.where("x % 5 <> 0").select(part.alias("territory_id")).unionByName(ends.select(supplier.alias("territory_id")))
    end = lambda odd: F.shiftright(F.when(F.col("a") % 2 == odd, F.col("a")).otherwise(F.col("b")), 1)
    return files.read_roads(spark, path, cohort).select(end(0).alias("a"), end(1).alias("b"), "distance")


def _page(name, wage, unit):
    row = lambda style, a, b, c: F.concat(F.lit(f'<tr><td class="{style}">'), a, F.lit("</td><td>"), b, F.lit("</td><td>"), c, F.lit("</td></tr>"))
    head = F.concat(F.lit(f"<div>{passports.CAPTION}</div><div>{passports.TITLE}</div><div>type</div><div>"), name, F.lit("</div><div>за 2023 год</div><table>"))
    none = F.lit("")
    return F.concat(head, row("pok", F.lit(f"{WAGE} {NO_SMALL}"), none, none), row('prizn" style="padding-left: 4pt', F.lit("Всего"), none, none), row('prizn" style="padding-left: 8pt', F.lit("январь-декабрь"), unit, wage), F.lit("</table>"))


@query("SELECT c_custkey AS path, c_name AS source_name, 'wage' AS kind, 'Всего' AS sector, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey + 0.5 END AS value, CASE WHEN c_custkey % 7 = 0 THEN 'unexpected_unit' WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'observed' END AS value_status, 3 AS source_row FROM customer WHERE c_custkey % 11 <> 0")
def passport_scan(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.when(key % 5 == 0, "").otherwise(F.concat(key.cast("string"), F.lit(",5")))
    page = _page(F.col("c_name"), text, F.when(key % 7 == 0, "тонна").otherwise(passports.ROUBLE))
    pages = table(spark, sf_dir, "customer").select(key.alias("path"), F.when(key % 11 == 0, passports.ABSENT).otherwise(page).cast("binary").alias("content"))
    found = materialize(passports.read_passports(pages, 2023), "passports")  # pages are parsed once
    names = found.select("path", "source_name")
    return passports.observations(found).join(names, "path").select("path", "source_name", "kind", "sector", "value", "value_status", "source_row")


#: Rows that one written archive, stream or workbook holds.
_BLOCK = 500


def _packed(rows: DataFrame, key: str, made, extra: str = "") -> DataFrame:
    """``path, content`` of files of up to ``_BLOCK`` neighbouring keys, made in tasks; ``made`` takes a frame in their order."""

    def pack(frame):
        frame = frame.sort_values(key, kind="stable")
        return pd.DataFrame([{"path": f"block-{frame[key].iloc[0] // _BLOCK}", **made(frame)}])

    return rows.groupBy(F.floor(F.col(key) / _BLOCK)).applyInPandas(pack, f"path string, content binary{extra}")


def _zipped(**members: str) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in members.items():
            archive.writestr(f"x/{name}.csv", text)
    return held.getvalue()


def _book(rows: list[tuple], sheet: str) -> bytes:
    """A workbook of one sheet, texts inline."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v!r}</v></c>"
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="{sheet}" r:id="a"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return held.getvalue()


@query(f"""SELECT c_custkey::VARCHAR AS oktmo, '2023' AS year, (c_custkey // 3)::VARCHAR AS region, row_number() OVER (PARTITION BY c_custkey // {_BLOCK} ORDER BY c_custkey) + 1 AS source_row,
count(*) FILTER (c_custkey % 4 > 0) OVER (PARTITION BY c_custkey // 3) > 1 AS conflicting_key FROM customer QUALIFY c_custkey % 4 > 0""")
def annual_member(spark, sf_dir):
    def made(frame):
        lines = "".join(f"{k};Y;2023;{'all' if k % 4 else 'part'};{k // 3}\n" for k in frame["c_custkey"])
        return {"content": _zipped(year2023_a="oktmo;indicator_code;year;indicator_period;region\n" + lines, year2022_a="")}

    zips = _packed(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", made)
    return files.read_annual_member(zips, 2023, "Y", "all", ["region"]).select("oktmo", "year", "region", "source_row", "conflicting_key")


@query(f"""SELECT o_custkey::VARCHAR AS custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT o_orderkey // {_BLOCK}) AS streams FROM orders GROUP BY o_custkey""")
def inflated_streams(spark, sf_dir):
    def made(frame):
        lines = "".join(f'{c};"{v:.2f}"\n' for c, v in zip(frame["o_custkey"], frame["o_totalprice"], strict=True))
        raw = ("custkey;price\n" + lines).encode()
        engine = zlib.compressobj(wbits=-zlib.MAX_WBITS)
        return {"content": engine.compress(raw) + engine.flush(), "length": len(raw), "crc": zlib.crc32(raw)}

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = archives.inflated_records(_packed(rows, "o_orderkey", made, ", length long, crc long"), ("custkey", "price"))
    cents = F.round(F.col("record")["price"].cast("double") * 100).cast("long")
    return found.groupBy(F.col("record")["custkey"].alias("custkey")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.count_distinct("path").alias("streams"))


@query("SELECT c_custkey::VARCHAR AS territory_id, 1990 + c_nationkey AS year_from, 2000 + c_nationkey + c_custkey % 5 AS year_to, c_mktsegment || ' & <' || c_name || '>' AS name FROM customer")
def registry_workbooks(spark, sf_dir):
    head = ("territory_id", "year_from", "year_to", "name")

    def made(frame):
        rows = [(k, 1990 + n, 2000 + n + k % 5, f"{m} & <{c}>") for k, n, m, c in frame[["c_custkey", "c_nationkey", "c_mktsegment", "c_name"]].itertuples(index=False)]
        return {"content": _book([head, *[tuple(int(x) if not isinstance(x, str) else x for x in r) for r in rows]], "registry")}

    books = materialize(_packed(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"), "c_custkey", made), "books")
    return files.read_registry(books, list(head), "registry")


@query("""SELECT lpad((s_nationkey * 7)::VARCHAR, 5, '0') || '000' AS code8, count(*) AS n, round(sum(s_acctbal), 2) AS total, round(sum(s_suppkey % 3), 2) AS urban, min(s_name) AS first
FROM supplier WHERE s_suppkey % 5 > 1 GROUP BY 1""")
def population_workbooks(spark, sf_dir):
    def made(frame):
        rows = [("caption",)] * 7
        for k, n, balance, name in frame[["s_suppkey", "s_nationkey", "s_acctbal", "s_name"]].itertuples(index=False):
            code = f"{n * 7:05d}{'111' if k % 5 == 0 else '000'}12"
            rows.append((code, f" {name} ", "n/a" if k % 5 == 1 else float(balance), float(k % 3)))
        return {"content": _book(rows, "people")}

    books = _packed(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", "s_name"), "s_suppkey", made)
    each = files.read_population(books, "people").select("code8", F.explode("rows").alias("row"))
    return each.groupBy("code8").agg(F.count("*").alias("n"), F.round(F.sum("row.total"), 2).alias("total"), F.round(F.sum("row.urban"), 2).alias("urban"), F.min("row.name").alias("first"))


@query("""SELECT c_nationkey::VARCHAR AS oktmo, c_mktsegment AS key, count(*) AS n, count(*) FILTER (c_custkey % 6 = 0) AS without, round(sum(CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END), 2) AS total, min(c_name) AS first
FROM customer WHERE c_custkey % 4 < 3 GROUP BY ALL""")
def municipal_multimap(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    level = F.when(F.col("c_custkey") % 4 < 3, "top").otherwise("low")
    value = F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    path = _place(spark, "municipal")
    rows.select(F.col("c_nationkey").alias("oktmo"), level.alias("mun_level"), F.col("c_mktsegment").alias("part"), value.alias("indicator_value"), F.col("c_name").alias("municipality"), F.lit("as given").alias("comment")).write.csv(path, sep=";", header=True)
    each = files.read_municipal(spark, path, "part", "top").select("oktmo", "key", F.explode("rows").alias("row"))
    empty = F.count(F.when(F.col("row.value").isNull(), 1))
    return each.groupBy("oktmo", "key").agg(F.count("*").alias("n"), empty.alias("without"), F.round(F.sum("row.value"), 2).alias("total"), F.min("row.name").alias("first"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS territory FROM customer")
def territory_ids(spark, sf_dir):
    written = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", territory_id(written).alias("territory"))


@query("""SELECT 'nation' AS name, n_nationkey AS key, md5(concat_ws('|', n_name, n_regionkey)) AS row FROM nation
UNION ALL SELECT 'orders', o_orderkey, md5(concat_ws('|', o_orderpriority, o_custkey)) FROM orders UNION ALL SELECT 'listed', count(*), 'nation' FROM nation UNION ALL SELECT 'listed', count(*), 'orders' FROM orders""")
def published_tables(spark, sf_dir):
    root = _place(spark, "published")
    names = ("nation", "orders")
    sinks.publish(spark, root, {n: table(spark, sf_dir, n) for n in names}, {"run": 1})
    nation, orders = (spark.read.parquet(f"{root}/{n}") for n in names)
    row = lambda *c: F.md5(F.concat_ws("|", *c).cast("binary")).alias("row")
    out = nation.select(F.lit("nation").alias("name"), F.col("n_nationkey").cast("long").alias("key"), row("n_name", "n_regionkey"))
    out = out.unionByName(orders.select(F.lit("orders").alias("name"), F.col("o_orderkey").cast("long").alias("key"), row("o_orderpriority", "o_custkey")))
    listed = spark.read.json(f"{root}/{sinks.MANIFEST}", multiLine=True)
    for n in names:
        out = out.unionByName(listed.select(F.lit("listed").alias("name"), F.col(f"rows.{n}").cast("long").alias("key"), F.lit(n).alias("row")))
    return out
