"""Records of archives, DEFLATE files and workbooks, read where they lie: a file a task row, nothing by the driver.

Files come as a table of ``path`` and ``content``: of ``binaryFile``, of
:func:`panelloom.sources.remote.fetched`, or of any query.  Their records leave
in batches, so that a task holds one file's bytes and a batch.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Records that leave a task at once.
BATCH = 2000
RECORDS = "path string, member string, source_row long, record map<string,string>"
CELL = "struct<text:string,number:double>"


def binary(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, content`` of files, folders or patterns, as many tasks as files where they are large."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def checked(lines: Iterable[str], sep: str, required: Iterable[str] = ()) -> Iterator[tuple[int, dict[str, str]]]:
    """Records of strict CSV lines and their numbers, the header being row one.

    Names must be unique and hold the required ones; a row that is wider or
    narrower than they are is a ValueError, and so is a broken quote.
    """
    reader = csv.reader(lines, delimiter=sep, strict=True)
    names = next(reader, [])
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise ValueError("column names must be unique and whole")
    for number, row in enumerate(reader, 2):
        if len(row) != len(names):
            raise ValueError(f"row {number} is wider or narrower than the header")
        yield number, dict(zip(names, row, strict=True))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


_RECORDS = pa.schema([("path", pa.string()), ("member", pa.string()), ("source_row", pa.int64()), ("record", pa.map_(pa.string(), pa.string()))])


def member_records(archives: DataFrame, wanted: str, *, sep: str = ";", one: bool = False) -> DataFrame:
    """``path, member, source_row, record`` of the CSV members of ZIP archives whose names match.

    With ``one`` an archive must have exactly one such member.  Members are
    inflated as they are read; their checksums must hold.
    """

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if re.search(wanted, n)]
            if one and len(names) != 1:
                raise ValueError(f"exactly one member is wanted in {path}, found {len(names)}")
            for name in names:
                with io.TextIOWrapper(archive.open(name), "utf-8-sig", newline="") as lines:
                    for number, record in checked(lines, sep):
                        yield path, name, number, list(record.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(rows(path, content), _RECORDS)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


def inflated(content: bytes, length: int, crc: int, step: int = 1 << 16) -> Iterator[bytes]:
    """The pieces of a raw DEFLATE stream; it must have the pinned length and checksum and nothing behind it."""
    engine, seen, check, rest = zlib.decompressobj(-zlib.MAX_WBITS), 0, 0, content
    while not engine.eof:
        piece = engine.decompress(rest, step)
        rest = engine.unconsumed_tail
        if not piece and not rest and not engine.eof:
            raise ValueError("the stream is cut short")
        seen, check = seen + len(piece), zlib.crc32(piece, check)
        if seen > length:
            raise ValueError("the stream is longer than pinned")
        yield piece
    if engine.unused_data:
        raise ValueError("bytes follow the stream")
    if (seen, check) != (length, crc):
        raise ValueError("another length or checksum than pinned")


def _lines(pieces: Iterable[bytes]) -> Iterator[str]:
    """Lines of UTF-8 pieces, a leading mark of order left out."""
    rest, first = b"", True
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield (line + b"\n").decode("utf-8-sig" if first else "utf-8")
            first = False
    if rest:
        yield rest.decode("utf-8-sig" if first else "utf-8")


def inflated_records(streams: DataFrame, required: tuple[str, ...] = (), *, sep: str = ";") -> DataFrame:
    """``path, member, source_row, record`` of raw DEFLATE streams of CSV (``path, content, length, crc``).

    ``length`` and ``crc`` pin what each must inflate to.  A stream can only
    be read from its start, so that each is one task's; a fault anywhere in it
    fails the task, and with it all that was read.
    """

    def rows(path: str, content: bytes, length: int, crc: int) -> Iterator[tuple]:
        for number, record in checked(_lines(inflated(content, length, crc)), sep, required):
            yield path, None, number, list(record.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(rows(*row), _RECORDS)

    return streams.select("path", "content", "length", "crc").mapInArrow(run, RECORDS)


# --- workbooks ----------------------------------------------------------------------

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The member of a sheet (the first, if none is named)."""
    named = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
    wanted = next((s for s in named if sheet in (None, s.get("name"))), None)
    if wanted is None:
        raise ValueError(f"no sheet {sheet}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[wanted.get(_RELATION)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _streamed(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name in turn, each emptied after it was seen."""
    for _, element in ElementTree.iterparse(stream):
        if element.tag == f"{_SHEET}{tag}":
            yield element
            element.clear()


def _written(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_SHEET}t"))


def workbook_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | float | bool | None]]:
    """Rows of a sheet of an XLSX workbook, without formulas' sources; rows and shared texts are streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        place, texts = _place(book, sheet), []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                texts = [_written(s) for s in _streamed(stream, "si")]
        with book.open(place) as stream:
            for row in _streamed(stream, "row"):
                out: list[str | float | bool | None] = []
                for cell in row.iter(f"{_SHEET}c"):
                    column = 0
                    for letter in re.match("[A-Z]*", cell.get("r", "")).group():
                        column = 26 * column + ord(letter) - 64
                    out += [None] * (column - 1 - len(out))
                    kind, value = cell.get("t", "n"), cell.find(f"{_SHEET}v")
                    if kind == "inlineStr":
                        out.append(_written(cell))
                    elif value is None or value.text is None:
                        out.append(None)
                    else:
                        out.append(texts[int(value.text)] if kind == "s" else value.text == "1" if kind == "b" else float(value.text) if kind == "n" else value.text)
                yield out


def cell_text(value) -> str | None:
    """A cell as text; whole numbers have no decimals."""
    if value is None:
        return None
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


_SHEETS = pa.schema([("path", pa.string()), ("source_row", pa.int64()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("number", pa.float64())])))])


def sheet_rows(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """``path, source_row, cells`` of a sheet of each workbook: every cell's text, and its number if it is one.

    ``source_row`` counts the rows that the sheet has, from one.
    """

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for number, row in enumerate(workbook_rows(content, sheet), 1):
            yield path, number, [{"text": cell_text(v), "number": v if isinstance(v, float) else None} for v in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(rows(path, content), _SHEETS)

    return books.select("path", "content").mapInArrow(run, f"path string, source_row long, cells array<{CELL}>")
