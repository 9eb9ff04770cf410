import hashlib
import io
import json
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from panelloom.sources import archives, files

HEAD = "mo;period;category_15;value;obs_status;unit_measure;unit_mult;freq\n"


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_export(spark, tmp_path):
    tail = ";A;руб.;0;Месяц\n"
    path = put(tmp_path / "e.csv", HEAD + "а;2022-12-31T21:00:00Z;x;1.5" + tail + "б;2023-01-31T21:00:00Z;x;2" + tail)
    rows = files.read_export(spark, path).orderBy("mo").collect()
    assert [(r.mo, r.period, r.value) for r in rows] == [("а", "2023-01-01", 1.5), ("б", "2023-02-01", 2.0)]
    for bad in ("а;2023-01-31;x;1" + tail, "а;2023-01-01;x;one" + tail, ";2023-01-01;x;1" + tail):
        with pytest.raises(Exception, match="start of a month|no number|key is missing"):
            files.read_export(spark, put(tmp_path / "bad.csv", HEAD + bad)).collect()
    with pytest.raises(ValueError, match="missing columns"):
        files.read_export(spark, put(tmp_path / "few.csv", "mo;period\na;b\n"))


def test_pins(spark, tmp_path):
    path, good = put(tmp_path / "a.bin", b"abc"), hashlib.sha256(b"abc").hexdigest()
    assert files.pinned(spark, path, good) == b"abc"
    assert files.file_digests(spark, path).first()["sha256"] == good
    for pin in (good.upper(), "0" * 64, good[:-1]):
        with pytest.raises(ValueError):
            files.pinned(spark, path, pin)
    put(tmp_path / "SHA256.json", json.dumps({"a.bin": good}))
    assert files.listed(spark, str(tmp_path), "a.bin") == b"abc"
    for name in ("../a.bin", "/a.bin", "b.bin"):
        with pytest.raises(ValueError):
            files.listed(spark, str(tmp_path), name)
    put(tmp_path / "SHA256.json", f'{{"a.bin": "{good}", "a.bin": "{good}"}}')
    with pytest.raises(ValueError, match="twice"):
        files.listed(spark, str(tmp_path), "a.bin")


@pytest.mark.parametrize("text, sound", [('a,b\n1,"x ""y"" z"\n', True), ('a,b\n1,"two\nlines"\n', True), ('a,b\n1,x"y\n', False), ('a,b\n1,"x"y\n', False), ('a,b\n1,"open\n', False), ("", True)])
def test_quotes(spark, text, sound):
    assert spark.createDataFrame([(text,)], "t string").select(files.quotes_are_sound(F.col("t"))).first()[0] is sound


def test_strict_panel(spark, tmp_path):
    head, good = "entity_id,territory_id,period,food,total\n", "tid_7,7,2023-01-01,1.5,2\n"
    path = put(tmp_path / "p.csv", head + good)
    rows = files.strict_panel(files.read_strict_csv(spark, path, hashlib.sha256((head + good).encode()).hexdigest()), ["food", "total"]).collect()
    assert [(r.entity_id, r.food, r.total) for r in rows] == [("tid_7", 1.5, 2.0)]
    for bad in ("tid_8,7,2023-01-01,1,2\n", "tid_07,07,2023-01-01,1,2\n", "tid_7,7,2023-13-01,1,2\n", "tid_7,7,2023-01-01,-1,2\n", "tid_7,7,2023-01-01,NaN,2\n", "tid_7,7,2023-01-01,,2\n", "tid_7,7,2023-01-01,1\n", "tid_7,7,2023-01-01,1,2,3\n"):
        with pytest.raises(Exception):  # noqa: B017
            files.strict_panel(files.read_strict_csv(spark, put(tmp_path / "q.csv", head + bad)), ["food", "total"]).collect()
    with pytest.raises(ValueError, match="unique"):
        files.read_strict_csv(spark, put(tmp_path / "r.csv", "a,a\n1,2\n"))


def roads(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, "territory_id_x long, territory_id_y long, type string, distance double, other string").write.parquet(str(tmp_path / name))
    return files.read_roads(spark, str(tmp_path / name), spark.createDataFrame([(1,), (2,), (3,)], "territory_id long"))


def test_roads(spark, tmp_path):
    got = roads(spark, tmp_path, [(2, 1, "highway", 5.0, "x"), (1, 3, "rail", 1.0, "x"), (1, 9, "highway", 1.0, "x")], "a")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 5.0)]
    plan = got._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(type,highway\)", plan) and "other" not in plan.split("ReadSchema")[1].split("\n")[0]
    for k, rows in enumerate(([(1, 1, "highway", 1.0, "")], [(1, 2, "highway", float("inf"), "")], [(1, 2, "highway", 1.0, ""), (2, 1, "highway", 1.0, "")])):
        with pytest.raises(Exception, match="road"):
            roads(spark, tmp_path, rows, f"b{k}").collect()


def test_municipal_multimap(spark, tmp_path):
    path = put(tmp_path / "m.csv", "oktmo;mun_level;vozr;indicator_value;municipality;comment\n1;top;all;2.5;A;\n1;top;all;;A;odd\n1;low;all;9;A;\n")
    rows = files.read_municipal(spark, path, "vozr", "top").collect()
    assert len(rows) == 1 and sorted((r.value is None, r.comment) for r in rows[0].rows) == [(False, None), (True, "odd")]


def test_annual_member(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/year2023_x.csv", "oktmo;indicator_code;year;indicator_period\n1;Y;2023;all\n1;Y;2023;all\n2;Y;2023;part\n3;Y;2023;all\n")
        z.writestr("d/year2022_x.csv", "")
    path = put(tmp_path / "z.zip", held.getvalue())
    rows = files.read_annual_member(archives.binary(spark, path), 2023, "Y", "all", ["oktmo"]).orderBy("source_row").collect()
    assert [(r.oktmo, r.source_row, r.conflicting_key) for r in rows] == [("1", 2, True), ("1", 3, True), ("3", 5, False)]
    with pytest.raises(Exception, match="exactly one"):
        files.read_annual_member(archives.binary(spark, path), 2021, "Y", "all", ["oktmo"]).collect()
    with pytest.raises(Exception, match="another indicator"):
        files.read_annual_member(archives.binary(spark, path), 2023, "N", "all", ["oktmo"]).collect()


def test_inflated_records(spark):
    raw = "\ufeffa;b\n1;2\n3;4\n".encode() + b"5;6\n" * 100_000
    engine = zlib.compressobj(wbits=-15)
    packed = engine.compress(raw) + engine.flush()

    def read(*streams):
        table = spark.createDataFrame([(f"s{i}", bytearray(c), n, k) for i, (c, n, k) in enumerate(streams)], "path string, content binary, length long, crc long")
        return archives.inflated_records(table.repartition(len(streams)), ("a",))

    good = (packed, len(raw), zlib.crc32(raw))
    rows = read(good, good)
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 200_004
    assert [(r.source_row, r.record) for r in rows.where("source_row < 4 and path = 's0'").collect()] == [(2, {"a": "1", "b": "2"}), (3, {"a": "3", "b": "4"})]
    for bad in ((packed[:-3], *good[1:]), (packed + b"x", *good[1:]), (packed, len(raw) + 1, good[2]), (packed, len(raw) - 1, good[2]), (packed, len(raw), 1)):
        with pytest.raises(Exception, match="stream|length or checksum"):
            read(good, bad).collect()


def test_records_of_many_archives(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x/data.csv", "\ufeffa;b\n" + "".join(f'{i};"q;""{n}"\n' for i in range(2500)))
            z.writestr("other.txt", "unread")
    rows = archives.member_records(archives.binary(spark, str(tmp_path / "*.zip")), r"\.csv$")
    assert rows.count() == 7500 and rows.where("record['b'] = 'q;\"1'").count() == 2500
    assert rows.agg({"source_row": "max"}).first()[0] == 2501
    for body in ("a;a\n1;2\n", "a;b\n1\n", 'a;b\n1;"2\n'):
        with zipfile.ZipFile(tmp_path / "bad", "w") as z:
            z.writestr("x.csv", body)
        with pytest.raises(Exception, match="unique|wider|unexpected end"):
            archives.member_records(archives.binary(spark, str(tmp_path / "bad")), "csv").collect()


def workbook(rows, name="S"):
    """A workbook of one sheet, with shared strings for texts."""
    texts = [x for r in rows for x in r if isinstance(x, str)]
    cell = lambda x, i, j: "" if x is None else f'<c r="{chr(65 + j)}{i}" t="s"><v>{texts.index(x)}</v></c>' if isinstance(x, str) else f'<c r="{chr(65 + j)}{i}"><v>{x}</v></c>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        body = "".join(f'<row r="{i}">' + "".join(cell(x, i, j) for j, x in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return held.getvalue()


def test_registry(spark, tmp_path):
    head = ["territory_id", "year_from", "year_to", "name"]
    path = put(tmp_path / "r.xlsx", workbook([head, [7, 2018, 2024, "old"], [7, 2024, 9999, None]]))
    rows = files.read_registry(archives.binary(spark, path), head).orderBy("year_from").collect()
    assert [(r.territory_id, r.year_from, r.year_to, r.name) for r in rows] == [("7", 2018, 2024, "old"), ("7", 2024, 9999, None)]
    with pytest.raises(ValueError, match="whole"):
        files.read_registry(archives.binary(spark, path), [*head, "oktmo"])
    for bad in ([7, 2024, 2018, "x"], [7, 2018.5, 2024, "x"], [-1, 2018, 2024, "x"]):
        with pytest.raises(Exception, match="intervals|territory"):
            files.read_registry(archives.binary(spark, put(tmp_path / "b.xlsx", workbook([head, bad]))), head).collect()


def test_population(spark, tmp_path):
    rows = [["h"]] * 7 + [["1234500012", "A", 10, 4], ["1234500012", "A", 11, None], ["1234512312", "B", 5, 1], ["12345000", "C", 5, 1], ["1234600000", "D", "n/a", 1]]
    got = files.read_population(archives.binary(spark, put(tmp_path / "p.xlsx", workbook(rows, "P"))), "P").collect()
    assert [(r.code8, [tuple(x) for x in r.rows]) for r in got] == [("12345000", [(10.0, 4.0, "A"), (11.0, 0.0, "A")])]
