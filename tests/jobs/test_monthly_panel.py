"""The monthly panel over growing input, replays and broken rows."""

import json

import pytest
from pyspark.sql import functions as F

from jobs import command, monthly_panel

SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def write(spark, rows, folder):
    made = spark.createDataFrame([(i, c, "O", v, None, p, d) for i, (c, p, d, v) in enumerate(rows)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, gone timestamp, o_orderpriority string, day string")
    made.withColumn("o_orderdate", F.to_timestamp("day")).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(folder)


def panel_of(spark, folder):
    rows = spark.read.parquet(folder).withColumn("period", F.col("period").cast("string")).collect()
    return {(r.period, r.entity, r.category): (r.value, r.n_orders, r.share, r.complete) for r in rows}


def stamps(spark, folder):
    return {r.period.isoformat(): r.f for r in spark.read.parquet(folder).select("period", F.input_file_name().alias("f")).distinct().collect()}


FIRST = [(1, "a", "2020-01-05", 10.0), (1, "a", "2020-01-31", 5.5), (1, "b", "2020-01-07", 4.5), (2, "a", "2020-02-01", 1.0), (None, "a", "2020-01-01", 1.0), (1, None, "2020-01-01", 1.0), (1, "a", None, 1.0), (1, "a", "2020-01-01", None), (3, "a", "2020-01-01", -2.0)]
SECOND = [(2, "b", "2020-02-29", 3.0), (2, "a", "2020-03-01", 2.0), (3, "a", "2020-02-02", 0.25)]


def test_growing_input(spark, tmp_path):
    orders, out, mark = (str(tmp_path / n) for n in ("orders", "panel", "mark"))
    write(spark, FIRST, orders)
    assert monthly_panel.run(spark, orders, out, mark, categories=2) == {"rows_read": 9, "batches": 1, "months_written": 2}
    assert panel_of(spark, out) == {("2020-01-01", 1, "a"): (15.5, 2, 0.775, True), ("2020-01-01", 1, "b"): (4.5, 1, 0.225, True), ("2020-02-01", 2, "a"): (1.0, 1, 1.0, False)}
    before = stamps(spark, out)
    write(spark, SECOND, orders)
    assert monthly_panel.run(spark, orders, out, mark, categories=2) == {"rows_read": 3, "batches": 1, "months_written": 2}
    grown = panel_of(spark, out)
    assert {k: v for k, v in grown.items() if k[0] > "2020-01-01"} == {
        ("2020-02-01", 2, "a"): (1.0, 1, 0.25, True),
        ("2020-02-01", 2, "b"): (3.0, 1, 0.75, True),
        ("2020-02-01", 3, "a"): (0.25, 1, 1.0, False),
        ("2020-03-01", 2, "a"): (2.0, 1, 1.0, False),
    }
    after = stamps(spark, out)
    assert after["2020-01-01"] == before["2020-01-01"] and after["2020-02-01"] != before["2020-02-01"]
    assert monthly_panel.run(spark, orders, out, mark, categories=2) == {"rows_read": 0, "batches": 0, "months_written": 0}
    assert panel_of(spark, out) == grown and stamps(spark, out) == after


def test_two_runs_equal_one_of_all_files(spark, tmp_path):
    orders = str(tmp_path / "orders")
    for rows in (FIRST, SECOND):
        write(spark, rows, orders)
        monthly_panel.run(spark, orders, str(tmp_path / "a"), str(tmp_path / "a-mark"))
    monthly_panel.run(spark, orders, str(tmp_path / "b"), str(tmp_path / "b-mark"))
    done = monthly_panel.run(spark, orders, str(tmp_path / "c"), str(tmp_path / "c-mark"), files_per_batch=1)
    assert done["rows_read"] == 12 and done["batches"] > 1
    assert panel_of(spark, str(tmp_path / "a")) == panel_of(spark, str(tmp_path / "b")) == panel_of(spark, str(tmp_path / "c"))


def test_batch_that_failed_after_its_sums_is_taken_again(spark, tmp_path, monkeypatch):
    orders, out, mark = (str(tmp_path / n) for n in ("orders", "panel", "mark"))
    write(spark, FIRST, orders)

    def broken(sums, categories):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(monthly_panel, "panel_rows", broken)
        with pytest.raises(Exception, match="lost"):
            monthly_panel.run(spark, orders, out, mark)
    assert monthly_panel.run(spark, orders, out, mark)["rows_read"] == 9
    assert {v[0] for v in panel_of(spark, out).values()} == {15.5, 4.5, 1.0}


def test_settings(tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"input": "i", "output": "o", "checkpoint": "c", "files_per_batch": 1, "categories": 5}))
    assert command.settings("x", monthly_panel.PATHS, ["--config", str(config), "--output", "p"]) == {"input": "i", "output": "p", "checkpoint": "c", "files_per_batch": 1, "categories": 5}
    for bad in ({"input": "i"}, {"inputs": "i", "input": "i", "output": "o", "checkpoint": "c", "files_per_batch": 1, "categories": 5}):
        config.write_text(json.dumps(bad))
        with pytest.raises(SystemExit):
            command.settings("x", monthly_panel.PATHS, ["--config", str(config)])


def test_empty_table(spark, tmp_path):
    orders = str(tmp_path / "orders")
    spark.createDataFrame([], SCHEMA).write.parquet(orders)
    assert monthly_panel.run(spark, orders, str(tmp_path / "out"), str(tmp_path / "mark"))["months_written"] == 0
