import gzip
import json

import pytest
from pyspark.sql import functions as F

from panelloom.sources import sinks


def test_json_and_labels(spark, tmp_path):
    path = str(tmp_path / "a.json")
    digest = sinks.write_once(spark, path, {"b": "я"})
    assert json.loads((tmp_path / "a.json").read_text()) == {"b": "я"} and len(digest) == 64
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(spark, path, {})
    sinks.write_json(spark, path, [1])
    assert (tmp_path / "a.json").read_bytes() == b"[\n  1\n]\n"
    with pytest.raises(ValueError):
        sinks.write_json(spark, path, float("nan"))
    same = [sinks.write_labels(spark, str(tmp_path / f"{k}.gz"), {"labels": [1, 2]}) for k in "xy"]
    assert same[0] == same[1] and json.loads(gzip.decompress((tmp_path / "x.gz").read_bytes())) == {"labels": [1, 2]}


def test_numbers_as_c_writes_them(spark):
    values = [0.0, 1.0, 100.0, 123456.0, 1234567.0, 0.0001234567, 0.00001234, -2.5, 1e100, 999999.7, 3.14159265, float("nan"), 1e-300]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks.general(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == ["%.6g" % v for v in values]


def test_csv(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.1 + 0.2, 'a "b"'), (2, None, None)], "k int, x double, t string").coalesce(1).orderBy("k")
    sinks.write_csv(table, str(tmp_path / "c"), digits=6)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    assert raw == b'k,x,t\r\n1,0.3,"a ""b"""\r\n2,,\r\n'


def test_publication_is_whole_or_absent(spark, tmp_path, monkeypatch):
    root, table = str(tmp_path / "root"), spark.range(3)
    sinks.publish(spark, root, {"a": table, "b": table}, {"run": 1})
    assert json.loads((tmp_path / "root/manifest.json").read_text()) == {"run": 1, "rows": {"a": 3, "b": 3}}
    real = sinks._move

    def broken(spark, a, b):
        if a.endswith("/b") and "stage" in a and "before" not in a:
            raise OSError("disk")
        real(spark, a, b)

    monkeypatch.setattr(sinks, "_move", broken)
    with pytest.raises(OSError, match="disk"):
        sinks.publish(spark, root, {"a": spark.range(9), "b": spark.range(9)}, {"run": 2})
    assert spark.read.parquet(f"{root}/a").count() == spark.read.parquet(f"{root}/b").count() == 3
    assert json.loads((tmp_path / "root/manifest.json").read_text())["run"] == 1
    assert not list((tmp_path / "root").glob(".stage*")) and not (tmp_path / "root/.publish.lock").exists()
    monkeypatch.setattr(sinks, "_move", real)
    sinks.publish(spark, root, {"a": spark.range(9)}, {"run": 3})
    assert spark.read.parquet(f"{root}/a").count() == 9


def test_one_publisher_at_a_time(spark, tmp_path):
    with sinks.stage(spark, str(tmp_path)), pytest.raises(FileExistsError), sinks.stage(spark, str(tmp_path)):
        pass
    with pytest.raises(ValueError), sinks.stage(spark, str(tmp_path)) as private:
        sinks.promote(spark, private, str(tmp_path), [])
