import base64
import hashlib
import io
import json
import re
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from panelloom.sources import archives, remote

text = lambda s: "__string__" + base64.b64encode(s.encode()).decode()
ROWS = [[text(f"área {i}"), f"__number__{i}.5", "__null__"] for i in range(7)]


def archive():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", CSV)
        z.writestr("other.bin", b"x" * 100_000)
        z.writestr("long.csv", LONG)
        for name in ("packed1.csv", "packed2.csv"):
            z.writestr(name, LONG, zipfile.ZIP_DEFLATED)
    return held.getvalue()


CSV = "﻿k;v\n1;a\n2;b\n1;c\n".encode()
LONG = ("k;v\n" + "".join(f"{i};{'é' * (i % 9)}\n" for i in range(3000))).encode()
FILE = archive()


class Handler(BaseHTTPRequestHandler):
    broken, cut, other = False, 0, b""

    def log_message(self, *args):
        pass

    def _send(self, status, body, **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        limit, offset = map(int, re.search(r"limit=(\d+)&offset=(\d+)", base64.b64decode(asked["SOWA"]["route"]).decode()).groups())
        rows = ROWS[offset : offset + limit]
        if Handler.broken and offset:
            rows = rows[:-1]
        entry = lambda k, v, t=None: {"key": k, "value": v, "type": t}
        data = {"type": "object", "value": [entry("fields", [text("area"), text("v"), text("n")]), entry("data", rows), entry("pagination", {"type": "object", "value": [entry("total_records", f"__number__{len(ROWS)}")]})]}
        self._send(200, json.dumps({"SOWA": {"data": data}}).encode())

    def _file(self):
        return Handler.other if "other" in self.path else FILE

    def do_HEAD(self):
        self._send(200, self._file(), Accept_Ranges="none" if "plain" in self.path else "bytes")

    def do_GET(self):
        found = re.match(r"bytes=(\d+)-(\d+)", self.headers.get("Range") or "")
        if not found or "whole" in self.path:
            self._send(200, self._file())
            return
        piece = self._file()[int(found[1]) : int(found[2]) + 1]
        if Handler.cut:
            Handler.cut -= 1
            self.send_response(206)
            self.send_header("Content-Length", str(len(piece)))
            self.end_headers()
            self.wfile.write(piece[: len(piece) // 2])
            self.close_connection = True
            return
        self._send(206, piece)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_tags():
    entry = lambda k, v, t=None: {"key": k, "value": v, "type": t}
    assert remote.untagged({"type": "object", "value": [entry("a", "__boolean__true"), entry("b", ["__null__", 3, "plain"]), entry("c", "__string__7", "number")]}) == {"a": True, "b": [None, 3, "plain"], "c": 7.0}
    assert remote.untagged({"type": "object", "value": [{"type": "longstring", "value": [text("lo"), text("ng")]}]}) == "long"


def test_pages(spark, url):
    spark.dataSource.register(remote.PagedSource)
    table = spark.read.format("paged").options(url=url, dataset="d", limit="3").load()
    assert table.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, table.collect())) == [(f"área {i}", f"{i}.5", None) for i in range(7)]
    Handler.broken = True
    try:
        with pytest.raises(Exception, match="not whole"):
            table.collect()
    finally:
        Handler.broken = False


def ranged(spark, url, **options):
    spark.dataSource.register(remote.RangedZipSource)
    return spark.read.format("ranged_zip").options(url=url, **options).load()


def test_members_of_a_ranged_archive(spark, url):
    digest = hashlib.sha256(CSV).hexdigest()
    table = ranged(spark, f"{url}/z", member="^a.csv$", digests=json.dumps({"a.csv": digest}), wanted='{"k": ["1"]}')
    assert table.columns == ["k", "v"] and sorted(map(tuple, table.collect())) == [("1", "a"), ("1", "c")]
    with pytest.raises(Exception, match="pinned"):
        ranged(spark, f"{url}/z", member="^a.csv$", digests=json.dumps({"a.csv": "0" * 64})).collect()
    with pytest.raises(Exception, match="missing columns"):
        ranged(spark, f"{url}/z", member="^a.csv$", wanted='{"q": ["1"]}').collect()
    with pytest.raises(Exception, match="no such member"):
        ranged(spark, f"{url}/z", member="absent")
    with pytest.raises(Exception, match="no parts"):
        ranged(spark, f"{url}/plain", member="a.csv")
    with pytest.raises(ValueError, match="the whole of"):
        list(remote.part(f"{url}/whole", 0, 3))


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_stretches_of_a_stored_member_have_every_line_once(spark, url, stretch):
    if stretch == 1:
        reader = remote.RangedZipReader({"url": f"{url}/z", "member": "^a.csv$", "stretch": "1"}, ["k", "v"])
        parts = reader.partitions()
        assert len(parts) == len(CSV) and [r for p in parts for r in reader.read(p)] == [("1", "a"), ("2", "b"), ("1", "c")]
        return
    table = ranged(spark, f"{url}/z", member="^long.csv$", stretch=str(stretch * 100))
    assert table.rdd.getNumPartitions() == -(-len(LONG) // (stretch * 100))
    assert sorted(r.k for r in table.collect()) == sorted(str(i) for i in range(3000))


def test_deflated_members_are_tasks_of_their_own(spark, url):
    table = ranged(spark, f"{url}/z {url}/y", member="^packed")
    assert table.rdd.getNumPartitions() == 4
    assert table.count() == 4 * 3000 and table.where("k = '7'").count() == 4


def test_table_served_as_an_archive(spark, url, sf_dir):
    """Rows of a given table, served by members of nations, come back whole."""
    want = sorted((str(r.c_custkey), r.c_name) for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect())
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"part-{i}.csv", "id;name\n" + "".join(f"{k};{n}\n" for k, n in want[i::5]))
    Handler.other = held.getvalue()
    table = ranged(spark, f"{url}/other", member="part-")
    assert table.rdd.getNumPartitions() == 5 and sorted(map(tuple, table.collect())) == want


def test_broken_connections_are_taken_up_again(url):
    Handler.cut = 2
    assert b"".join(remote.part(f"{url}/z", 10, 5000)) == FILE[10:5000]
    Handler.cut = 9
    with pytest.raises(Exception):  # noqa: B017
        list(remote.part(f"{url}/z", 10, 5000))
    Handler.cut = 0


def test_fetched(spark, url):
    digest = hashlib.sha256(FILE).hexdigest()
    sources = spark.createDataFrame([(f"{url}/z", digest), (f"{url}/y", digest)], "url string, sha256 string").repartition(2)
    rows = remote.fetched(sources).collect()
    assert {r.path for r in rows} == {f"{url}/z", f"{url}/y"} and all(bytes(r.content) == FILE for r in rows)
    assert archives.member_records(remote.fetched(sources), "^a.csv$").count() == 6
    for bad, most, fault in (("0" * 64, 1 << 30, "pinned"), (digest, 10, "longer"), ("x", 1 << 30, "SHA-256")):
        with pytest.raises(Exception, match=fault):
            remote.fetched(spark.createDataFrame([(f"{url}/z", bad)], "url string, sha256 string"), most).collect()


def test_sheets(spark):
    rows = spark.createDataFrame([(1, "A", "100"), (2, "x", None), (3, "y", None), (4, "B", "200"), (5, "z", None)], "row int, name string, code string")
    found = remote.carried(rows, "row", {"head": F.when(F.col("code").isNotNull(), F.col("name")), "under": F.col("code")}).orderBy("row").collect()
    assert [(r.name, r.head, r.under) for r in found] == [("A", "A", "100"), ("x", "A", "100"), ("y", "A", "100"), ("B", "B", "200"), ("z", "B", "200")]
    codes = rows.where("code is not null").select("code", "name")
    assert remote.same_codes(codes, codes.select("code", F.lit(1).alias("v")), "code").count() == 2
    for bad in (codes.limit(1), codes.unionByName(codes)):
        with pytest.raises(ValueError, match="in_second"):
            remote.same_codes(codes, bad.select("code"), "code")
