"""Remote sources, all read by tasks: pages of a REST interface, members and stretches of archives, pinned files."""

from __future__ import annotations

import base64
import csv
import hashlib
import http.client
import io
import json
import re
import urllib.request
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelloom.operators.contracts import require
from panelloom.sources.files import DIGEST

TIMEOUT = 120
_TAG = re.compile(r"__([a-z]+)__(.*)", re.DOTALL)
#: Fixed values of the interface: what its tags mean.
TAGS = {"null": lambda raw: None, "number": float, "boolean": lambda raw: raw == "true", "string": lambda raw: base64.b64decode(raw).decode()}


def untagged(value, kind: str | None = None):
    """A value of the interface's typed objects, lists and tagged strings."""
    if isinstance(value, list):
        return [untagged(v, kind) for v in value]
    if isinstance(value, dict) and value.get("type") == "object":
        whole = [v for v in value["value"] if v.get("type") == "longstring"]
        if whole:
            return "".join(untagged(whole[0]["value"], None))
        return {v["key"]: untagged(v["value"], v.get("type")) for v in value["value"]}
    found = _TAG.fullmatch(value) if isinstance(value, str) else None
    if not found:
        return value
    return TAGS.get(kind if kind in TAGS else found[1], lambda raw: raw)(found[2])


def asked(route: str) -> bytes:
    """The body of a request for a route."""
    return json.dumps({"SOWA": {"method": "GET", "route": base64.b64encode(route.encode()).decode(), "data": {"type": "object", "value": []}}}).encode()


def page(url: str, route: str) -> dict:
    request = urllib.request.Request(url, asked(route), {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return untagged(json.loads(answer.read())["SOWA"]["data"])


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class PagedSource(DataSource):
    """``spark.read.format("paged")``: a dataset of an interface, a partition per page, all values as text.

    Options ``url``, ``dataset`` and ``limit`` (rows a page).  The first page
    names the columns and how many rows there are; a page that is shorter than
    it should be is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def _route(self, offset: int) -> str:
        return f"/dataset/v1/{self.options['dataset']}?limit={self.options.get('limit', '1000')}&offset={offset}"

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in page(self.options["url"], self._route(0))["fields"])

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self)


class PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource) -> None:
        self.url, self.route, self.limit = source.options["url"], source._route, int(source.options.get("limit", "1000"))

    def _total(self, found: dict) -> int:
        return int(found["pagination"]["total_records"])

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(0, self._total(page(self.url, self.route(0))), self.limit)]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = page(self.url, self.route(partition.offset))
        if len(found["data"]) != min(self.limit, self._total(found) - partition.offset):
            raise ValueError(f"the page at {partition.offset} is not whole")
        for row in found["data"]:
            yield tuple(None if v is None else str(v) for v in row)


# --- archives that are read by parts ------------------------------------------------


def part(url: str, start: int, end: int, retries: int = 3) -> Iterator[bytes]:
    """The bytes [start, end) of a remote file in pieces.

    A connection that breaks is taken up where it broke, ``retries`` times; a
    server that sends the whole for a part is a ValueError.
    """
    while start < end:
        request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{end - 1}"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                if answer.status != 206:
                    raise ValueError(f"the whole of {url} came for a part")
                while start < end and (piece := answer.read(min(1 << 16, end - start))):
                    start += len(piece)
                    yield piece
            if start < end:
                raise ConnectionError(f"{url} ended at {start} of {end}")
        except (OSError, http.client.HTTPException):
            retries -= 1
            if retries < 0:
                raise


def length(url: str) -> int:
    """How long a remote file is; a server that sends no parts is a ValueError."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
        if (answer.headers.get("Accept-Ranges") or "").lower() != "bytes":
            raise ValueError(f"no parts can be had of {url}")
        return int(answer.headers["Content-Length"])


@dataclass(frozen=True)
class Member:
    """What an archive's directory says of a member."""

    name: str
    header: int
    packed: int
    size: int
    crc: int
    stored: bool


def directory(url: str) -> list[Member]:
    """The members of a remote ZIP archive, of which only the end is fetched.

    The end is fetched again, twice as long, until it holds the directory.
    """
    whole, tail = length(url), 1 << 16
    while True:
        tail = min(tail, whole)
        held = io.BytesIO(b"".join(part(url, whole - tail, whole)))
        try:
            with zipfile.ZipFile(held) as archive:
                found = archive.infolist()
                # places count from the first byte that was fetched
                shift = whole - tail if min((m.header_offset for m in found), default=0) < 0 else 0
                return [Member(m.filename, m.header_offset + shift, m.compress_size, m.file_size, m.CRC, m.compress_type == zipfile.ZIP_STORED) for m in found]
        except zipfile.BadZipFile:
            if tail == whole:
                raise
            tail *= 2


def body(url: str, member: Member) -> int:
    """Where a member's bytes begin: behind its own header, whose length the directory does not tell."""
    head = b"".join(part(url, member.header, member.header + 30))
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {member.header} of {url}")
    return member.header + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def lines(pieces: Iterable[bytes]) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x + b"\n" for x in whole)
    if rest:
        yield rest


class Stretch(InputPartition):
    """Lines of a member: all, or those that begin at [start, end) of its bytes."""

    def __init__(self, url: str, member: Member, start: int, end: int) -> None:
        self.url, self.member, self.start, self.end = url, member, start, end


class RangedZipSource(DataSource):
    """``spark.read.format("ranged_zip")``: CSV members of remote archives, by ranged requests only.

    Options: ``url`` (several, by blanks), ``member`` (a pattern), ``sep``,
    ``wanted`` (JSON: column to its wanted values; the other rows are left
    out), ``digests`` (JSON: member to its pinned SHA-256) and ``stretch``
    (bytes).  A deflated or pinned member is a partition, as it can only be
    read from its start or must be seen whole; a stored one has a partition a
    stretch.  Columns are strings, those of the first member, and must be the
    same in all; fields hold no line ends.  Checksums and digests of members
    that are read whole must hold, or the task fails.
    """

    @classmethod
    def name(cls) -> str:
        return "ranged_zip"

    def schema(self) -> str:
        reader = RangedZipReader(self.options)
        first = next(iter(reader.members()), None)
        if first is None:
            raise ValueError("no such member")
        return ", ".join(f"`{n}` string" for n in reader.head(*first))

    def reader(self, schema) -> DataSourceReader:
        return RangedZipReader(self.options, schema.names)


class RangedZipReader(DataSourceReader):
    def __init__(self, options, names: list[str] | None = None) -> None:
        self.urls, self.pattern, self.sep = options["url"].split(), options.get("member", ""), options.get("sep", ";")
        self.wanted = {c: frozenset(v) for c, v in json.loads(options.get("wanted", "{}")).items()}
        self.digests, self.stretch = json.loads(options.get("digests", "{}")), int(options.get("stretch", 64 << 20))
        self.names = names

    def members(self) -> Iterator[tuple[str, Member]]:
        for url in self.urls:
            yield from ((url, m) for m in directory(url) if re.search(self.pattern, m.name))

    def pieces(self, url: str, member: Member) -> Iterator[bytes]:
        """A member's own bytes from its start."""
        start = body(url, member)
        packed = part(url, start, start + member.packed)
        if member.stored:
            yield from packed
            return
        engine = zlib.decompressobj(-zlib.MAX_WBITS)
        for piece in packed:
            while piece:
                yield engine.decompress(piece, 1 << 20)
                piece = engine.unconsumed_tail
        yield engine.flush()

    def fields(self, line: bytes, first: bool = False) -> list[str]:
        return next(csv.reader([line.decode("utf-8-sig" if first else "utf-8").rstrip("\r\n")], delimiter=self.sep, strict=True))

    def head(self, url: str, member: Member) -> list[str]:
        return self.fields(next(lines(self.pieces(url, member))), True)

    def partitions(self) -> list[Stretch]:
        out = []
        for url, m in self.members():
            step = self.stretch if m.stored and m.name not in self.digests else m.size
            out += [Stretch(url, m, i, min(i + step, m.size)) for i in range(0, m.size, step)]
        return out

    def _whole(self, at: Stretch) -> Iterator[bytes]:
        seen, check = hashlib.sha256(), 0
        for piece in self.pieces(at.url, at.member):
            seen.update(piece)
            check = zlib.crc32(piece, check)
            yield piece
        pin = self.digests.get(at.member.name)
        if check != at.member.crc or pin not in (None, seen.hexdigest()):
            raise ValueError(f"another member than the pinned one: {at.member.name}")

    def _begun(self, at: Stretch) -> Iterator[bytes]:
        """Whole lines of which the first byte lies in the stretch."""
        start = body(at.url, at.member)
        before = max(at.start - 1, 0)  # the byte before tells whether a line begins at the first
        place = before
        for line in lines(part(at.url, start + before, start + at.member.size)):
            if place >= at.end:
                break
            if place > before or at.start == 0:
                yield line
            place += len(line)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        whole = partition.start == 0 and partition.end == partition.member.size
        found = lines(self._whole(partition)) if whole else self._begun(partition)
        names = None
        if partition.start == 0:
            names = self.fields(next(found), True)
        if names is None:
            names = self.head(partition.url, partition.member)
        if names != list(self.names):
            raise ValueError(f"other columns in {partition.member.name}")
        if absent := set(self.wanted) - set(names):
            raise ValueError(f"missing columns: {sorted(absent)}")
        at = [(names.index(c), values) for c, values in self.wanted.items()]
        for line in found:
            row = self.fields(line)
            if len(row) != len(names):
                raise ValueError(f"a row of {partition.member.name} is wider or narrower than the header")
            if all(row[i] in values for i, values in at):
                yield tuple(row)


def fetched(sources: DataFrame, most: int = 1 << 30) -> DataFrame:
    """``path, sha256, content`` of pinned remote files (``url, sha256``), each fetched by a task.

    A file that is longer than ``most``, or another than the pinned one, fails
    the task, so that a table written of them has all or none.  The result
    is what the functions of :mod:`panelloom.sources.archives` read.
    """

    def one(url: str, digest: str) -> bytes:
        if not DIGEST.fullmatch(digest or ""):
            raise ValueError("a SHA-256 of 64 lower-case digits is wanted")
        held = io.BytesIO()
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
            while piece := answer.read(1 << 20):
                held.write(piece)
                if held.tell() > most:
                    raise ValueError(f"{url} is longer than allowed")
        if hashlib.sha256(held.getvalue()).hexdigest() != digest:
            raise ValueError(f"another file than the pinned one: {url}")
        return held.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([digest]), pa.array([one(url, digest)], pa.binary())], ["path", "sha256", "content"])

    return sources.select("url", "sha256").mapInArrow(run, "path string, sha256 string, content binary")


# --- sheets of regional workbooks ---------------------------------------------------


def carried(rows: DataFrame, order: str, heads: dict[str, Column], by: str | None = None) -> DataFrame:
    """The rows of a sheet with what its last heading row said, under the names in ``heads``.

    Each column of ``heads`` is null but in heading rows.  ``by`` parts sheets,
    each of which one task holds.
    """
    sheet = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.last(column, ignorenulls=True).over(sheet) for name, column in heads.items()})


def same_codes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The tables joined by code, which must occur once in each and be in both; else a ValueError."""
    count = lambda t, name: t.groupBy(key).agg(F.count("*").alias(name))
    both = count(a, "in_first").join(count(b, "in_second"), key, "full")
    wrong = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit(0)) != 1, 1)).alias(c)
    require(both.agg(wrong("in_first"), wrong("in_second")))
    return a.join(b, key)
