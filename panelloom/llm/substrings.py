"""Exact substring dedup by fixed-block anchors.

A run of ``window`` words holds a whole block of ``window // 2`` words at a
multiple of that length, wherever it starts.  So only these non-overlapping
blocks are indexed, and every rolling block of every document probes the index
(:func:`_anchored`).  Hits are extended: each window around an anchor is
compared with all windows of its kind, and the union of a document's equal
windows is its maximal exact repeats (:func:`_repeated`).

Hashes travel packed, by bucket of hashes.  A mapper sends on only what it
cannot settle itself: of one window one row, that of its least document, as
the others are later than that one; of a block in :data:`MANY` documents or
more one row likewise.  So a passage in very many documents costs one number
for each two million hashes, and the largest bucket stays near the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from panelloom.llm.store import bounded_batches, materialize
from panelloom.llm.text import Rolling, mix64, utf8

#: Text per bucket of hashes, which bounds what a task holds.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 8
#: Buckets that one level of dealing tells apart; beyond it a second level does.
FAN_OUT = 4096
#: Buckets' worth of hashes that a task of the second level deals again.
DEALT_AGAIN = 16
#: Hashes held before a mapper sends them on.
HELD = 2_000_000
#: A rolling block in so many documents at once is an anchor, indexed or not.
MANY = 16
LAST = np.iinfo(np.int64).max
PROBE, BLOCK, KNOWN = 0, 1, 2
PACKED = "bucket int, kind int, docs binary, counts binary, hashes binary"
FOUND = "part int, docs binary, counts binary, hashes binary"


class Form(NamedTuple):
    """How hashes are stored: so many numbers each, of so many bytes."""

    columns: int
    width: int

    def pack(self, hashes: np.ndarray) -> bytes:
        if self.width == 8:
            return hashes.tobytes()
        return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        narrow = np.frombuffer(raw, np.uint8).reshape(-1, self.width)
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, : self.width] = narrow
        return wide.view(np.uint64).reshape(self.columns, -1)

    def bucket(self, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """By a number of its own, told from the stored bytes alone."""
        return (mix64(hashes[-1] ^ np.uint64(buckets)) % np.uint64(buckets)).astype(np.int64)


#: Blocks need not be told apart for certain, as an anchor is only a candidate.
BLOCKS = Form(1, 6)
#: Windows are equal if 128 bits agree.
WINDOWS = Form(2, 8)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Two numbers of each word, in two rows."""
    return np.ascontiguousarray(np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2).T)


def _blocks(rolling: Rolling, words: np.ndarray, width: int) -> np.ndarray:
    """The rolling blocks, in the bits that are stored."""
    return rolling.runs(words[0], width) & np.uint64((1 << 8 * BLOCKS.width) - 1)


def _windows(rolling: Rolling, words: np.ndarray, window: int) -> np.ndarray:
    return np.stack([rolling.runs(row, window) for row in words])


def _alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where each kind begins in it."""
    order = np.argsort(hashes[0])
    new = hashes[:, order[1:]] != hashes[:, order[:-1]]
    if (~new[0] & new.any(0)).any():  # equal in the first number alone
        order = np.lexsort(hashes[::-1])
        new = hashes[:, order[1:]] != hashes[:, order[:-1]]
    return order, np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), new.any(0)])


def _best(docs: np.ndarray, order: np.ndarray, first: np.ndarray, choose: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Of each kind its least or greatest document, for every row in order, and one row that has it."""
    if not len(order):
        return docs, order
    ordered = docs[order]
    best = np.repeat(choose.reduceat(ordered, first), np.diff(first, append=len(order)))
    places = np.where(ordered == best, np.arange(len(order)), len(order))
    return best, order[np.minimum.reduceat(places, first)]


class _Held:
    """Hashes of documents until they are sent on."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.n = 0

    def add(self, doc: int, hashes: np.ndarray) -> None:
        if hashes.shape[1]:
            self.docs.append(doc)
            self.hashes.append(hashes)
            self.n += hashes.shape[1]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and hashes of all, which are no longer held."""
        docs = np.repeat(np.array(self.docs, np.int64), [h.shape[1] for h in self.hashes])
        hashes = np.concatenate(self.hashes, axis=1)
        self.__init__()
        return docs, hashes


def _packed(kind: int, docs: np.ndarray, hashes: np.ndarray, buckets: np.ndarray, form: Form) -> Iterator[pa.RecordBatch]:
    """One row per bucket: documents, how many hashes each has, and the hashes."""
    if not len(docs):
        return
    order = np.lexsort((docs, buckets))
    docs, hashes, buckets = docs[order], hashes[:, order], buckets[order]
    fresh = np.r_[True, buckets[1:] != buckets[:-1]]
    owner = np.flatnonzero(fresh | np.r_[True, docs[1:] != docs[:-1]])
    counts = np.diff(owner, append=len(docs)).astype("<i4")
    starts = np.flatnonzero(fresh)
    ends = [*starts[1:].tolist(), len(docs)]
    cuts = [*np.searchsorted(owner, starts).tolist(), len(owner)]
    ids = docs[owner]
    out = [(int(buckets[i]), kind, ids[a:b].tobytes(), counts[a:b].tobytes(), form.pack(hashes[:, i:j])) for i, j, a, b in zip(starts.tolist(), ends, cuts, cuts[1:], strict=False)]
    names = ["bucket", "kind", "docs", "counts", "hashes"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """As Spark's ``pmod(xxhash64(doc), parts)`` of a long."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = (np.uint64(42) + five + np.uint64(8)) ^ (_rotated(docs.view(np.uint64) * two, 31) * one)
    x = _rotated(x, 27) * one + four
    x = (x ^ (x >> np.uint64(33))) * two
    x = (x ^ (x >> np.uint64(29))) * three
    return (x ^ (x >> np.uint64(32))).view(np.int64) % parts


def _known(docs: np.ndarray, hashes: np.ndarray, levels: Levels, form: Form) -> Iterator[pa.RecordBatch]:
    """What needs no match: the buckets pass it on, each to the part of its own number."""
    yield from _packed(KNOWN, docs, hashes, levels.first(part_of(docs, levels.buckets)), form)


def _found(docs: np.ndarray, hashes: np.ndarray, levels: Levels, form: Form) -> Iterator[pa.RecordBatch]:
    """What a bucket found, one row per part of the documents."""
    for batch in _packed(KNOWN, docs, hashes, part_of(docs, levels.buckets), form):
        yield batch.drop_columns("kind").rename_columns(["part", "docs", "counts", "hashes"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _read(docs: bytes, counts: bytes, hashes: bytes, form: Form) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, "<i4")), form.unpack(hashes)


def _buckets(batches: Iterator[pa.RecordBatch], form: Form, match) -> Iterator[pa.RecordBatch]:
    """``match`` of the probes and blocks of each bucket; rows come sorted by bucket."""

    def whole(held, kind):
        part = [_read(*r, form) for k, r in held if k == kind]
        if not part:
            return np.empty(0, np.int64), np.empty((form.columns, 0), np.uint64)
        return np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part], axis=1)

    now, held = None, []
    for bucket, kind, *row in _rows(batches):
        if bucket != now and held:
            yield from match(whole(held, PROBE), whole(held, BLOCK))
            held = []
        now = bucket
        if kind == KNOWN:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in row]], ["part", "docs", "counts", "hashes"])
        else:
            held.append((kind, row))
    if held:
        yield from match(whole(held, PROBE), whole(held, BLOCK))


class Levels(NamedTuple):
    """How many buckets there are, and how many the mappers tell apart."""

    buckets: int
    fan_out: int

    @property
    def coarse(self) -> int:
        return -(-self.buckets // self.fan_out)

    def first(self, buckets: np.ndarray) -> np.ndarray:
        """The buckets that a mapper tells apart: groups of them, if there are too many."""
        return buckets if self.coarse == 1 else buckets // self.fan_out


def _dealt(packed: DataFrame, levels: Levels, form: Form) -> DataFrame:
    """Each bucket in one partition, whole and by itself, of not too many rows.

    Where there are more buckets than ``fan_out``, mappers pack hashes by
    group of buckets, and tasks that take a bounded part of one group each
    pack them anew by bucket, so that rows stay long at any size.
    """
    if levels.coarse == 1:
        return packed.repartitionById(levels.buckets, F.col("bucket")).sortWithinPartitions("bucket")
    parts = max(1, -(-levels.fan_out // DEALT_AGAIN))
    spread = F.col("bucket") * parts + F.pmod(F.xxhash64("docs"), F.lit(parts)).cast("int")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0

        def out():
            for kind, part in held.items():
                docs, hashes = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part], axis=1)
                if kind == KNOWN:
                    yield from _packed(KNOWN, docs, hashes, part_of(docs, levels.buckets), form)
                else:
                    yield from _packed(kind, docs, hashes, form.bucket(hashes, levels.buckets), form)
            held.clear()

        for _, kind, *row in _rows(batches):
            held.setdefault(kind, []).append(_read(*row, form))
            n += len(held[kind][-1][0])
            if n > HELD:
                yield from out()
                n = 0
        yield from out()

    fine = packed.repartitionById(levels.coarse * parts, spread).mapInArrow(again, PACKED)
    return fine.repartitionById(levels.buckets, F.col("bucket")).sortWithinPartitions("bucket")


def _anchored(source: DataFrame, width: int, levels: Levels) -> DataFrame:
    """Per document, hashes of its rolling blocks whose words are an indexed
    block of one document and a rolling block of a later one."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, probes, blocks = Rolling(), _Held(), _Held()

        def out():
            if not probes.n:
                return
            docs, hashes = probes.take()
            order, first = _alike(hashes)
            sizes = np.diff(first, append=len(order))
            _, latest = _best(docs, order, first, np.maximum)
            many = order[np.repeat(sizes >= MANY, sizes)]
            yield from _known(docs[many], hashes[:, many], levels, BLOCKS)
            rest = np.r_[order[np.repeat(sizes < MANY, sizes)], latest[sizes >= MANY]]
            yield from _packed(PROBE, docs[rest], hashes[:, rest], levels.first(BLOCKS.bucket(hashes[:, rest], levels.buckets)), BLOCKS)
            docs, hashes = blocks.take()
            _, least = _best(docs, *_alike(hashes), np.minimum)
            yield from _packed(BLOCK, docs[least], hashes[:, least], levels.first(BLOCKS.bucket(hashes[:, least], levels.buckets)), BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.split()
                if len(words) < 2 * width:
                    continue
                runs = _blocks(rolling, _word_hashes(words), width)
                probes.add(doc, np.unique(runs)[None])
                blocks.add(doc, np.unique(runs[::width])[None])
                if probes.n > HELD:
                    yield from out()
        yield from out()

    def match(probes, blocks) -> Iterator[pa.RecordBatch]:
        (docs, hashes), (of, indexed) = probes, blocks
        if not len(of):
            return
        order, first = _alike(indexed)
        values, least = indexed[0][order[first]], np.minimum.reduceat(of[order], first)
        at = np.minimum(np.searchsorted(values, hashes[0]), len(values) - 1)
        hit = np.flatnonzero(values[at] == hashes[0])
        most = np.full(len(values), -LAST)
        np.maximum.at(most, at[hit], docs[hit])
        hit = hit[(most > least)[at[hit]]]
        yield from _found(docs[hit], hashes[:, hit], levels, BLOCKS)

    dealt = _dealt(source.mapInArrow(probe, PACKED), levels, BLOCKS)
    return dealt.mapInArrow(lambda batches: _buckets(batches, BLOCKS, match), FOUND)


def _beside(source: DataFrame, found: DataFrame, levels: Levels) -> DataFrame:
    """Texts and found hashes by part of the documents, the hashes first."""
    none = lambda kind: F.lit(None).cast(kind)
    hashes = found.select("part", F.lit(0).alias("kind"), none("long").alias("doc"), none("string").alias("text"), "docs", "counts", "hashes", none("long").alias("doc_id"))
    part = F.pmod(F.xxhash64("doc"), F.lit(levels.buckets)).cast("int")
    texts = source.select(part.alias("part"), F.lit(1).alias("kind"), "doc", "text", *[none("binary").alias(c) for c in ("docs", "counts", "hashes")], "doc_id")
    return hashes.unionByName(texts).repartitionById(levels.buckets, F.col("part")).sortWithinPartitions("part", "kind")


def _texts_with(batches: Iterator[pa.RecordBatch], form: Form) -> Iterator[tuple[int, int | None, bytes, np.ndarray]]:
    """Document, id, text and found hashes of each text of :func:`_beside`."""
    now, held, docs, hashes = None, [], np.empty(0, np.int64), np.empty((form.columns, 0), np.uint64)
    for batch in batches:
        cols = [utf8(c) if i == 3 else c.to_pylist() for i, c in enumerate(batch.columns)]
        for part, kind, doc, text, *packed, doc_id in zip(*cols, strict=True):
            if part != now or kind == 0:
                held = held if part == now else []
                if kind == 0:
                    held.append(_read(*packed, form))
                now, docs = part, None
            if kind == 0:
                continue
            if docs is None:
                docs = np.concatenate([np.empty(0, np.int64), *[h[0] for h in held]])
                hashes = np.concatenate([np.empty((form.columns, 0), np.uint64), *[h[1] for h in held]], axis=1)
                order = np.argsort(docs, kind="stable")
                docs, hashes, held = docs[order], hashes[:, order], []
            i, j = np.searchsorted(docs, [doc, doc + 1] if doc < LAST else [doc, doc]).tolist()
            yield doc, doc_id, text, hashes[:, i : j if doc < LAST else len(docs)]


def _repeated(source: DataFrame, anchors: DataFrame, window: int, width: int, levels: Levels) -> DataFrame:
    """Per document, hashes of its windows that also start in an earlier one."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held = Rolling(), _Held()

        def out():
            if not held.n:
                return
            docs, hashes = held.take()
            order, first = _alike(hashes)
            least, one = _best(docs, order, first, np.minimum)
            later = order[docs[order] > least]
            yield from _known(docs[later], hashes[:, later], levels, WINDOWS)
            yield from _packed(PROBE, docs[one], hashes[:, one], levels.first(WINDOWS.bucket(hashes[:, one], levels.buckets)), WINDOWS)

        for doc, _, text, hot in _texts_with(batches, BLOCKS):
            if not hot.size:
                continue
            words = _word_hashes(text.split())
            n = words.shape[1] - window + 1
            if n <= 0:
                continue
            seen = np.r_[0, np.cumsum(np.isin(_blocks(rolling, words, width), hot[0]))]
            near = np.flatnonzero(seen[window - width + 1 : window - width + 1 + n] > seen[:n])
            if len(near):
                hashes = _windows(rolling, words, window)[:, near]
                order, first = _alike(hashes)
                held.add(doc, hashes[:, order[first]])
            if held.n > HELD:
                yield from out()
        yield from out()

    def match(probes, _) -> Iterator[pa.RecordBatch]:
        docs, hashes = probes
        order, first = _alike(hashes)
        least, _ = _best(docs, order, first, np.minimum)
        later = order[docs[order] > least]
        yield from _found(docs[later], hashes[:, later], levels, WINDOWS)

    dealt = _dealt(_beside(source, anchors, levels).mapInArrow(extend, PACKED), levels, WINDOWS)
    return dealt.mapInArrow(lambda batches: _buckets(batches, WINDOWS, match), FOUND)


def _among(windows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which windows, by place, are found ones."""
    maybe = np.flatnonzero(np.isin(windows[0], found[0]))
    both = np.concatenate([found, windows[:, maybe]], axis=1)
    order, first = _alike(both)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    n = found.shape[1]
    return maybe[np.isin(kind[n:], kind[:n])]


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each row of ``docs``.

    Words that lie in a run of ``window`` words (an even number) which also
    starts in a document of a smaller id are removed; the rest is joined by
    single spaces.  Windows are judged on the input.  Null and empty texts
    have no words.  Null ids count as one id that follows all others; rows of
    the same id never remove each other's words.  Repeated rows are kept, an
    empty table gives an empty one, other columns are ignored, whatever their
    names.  Windows are equal if 128 bits of hash are: 10**13 windows, some
    100 TB, hold an unequal pair of equal hashes with a chance of one in
    10**12.  ``bucket_bytes`` and ``fan_out`` say how the hashes are dealt and
    change no result.
    """
    width = window // 2
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = Levels(max(LEAST_BUCKETS, -(-total // bucket_bytes)), fan_out)
    anchors = materialize(_anchored(source, width, levels), "anchors")
    repeats = materialize(_repeated(source, anchors, window, width, levels), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])

        rows, size = [], 0
        for _, doc_id, text, found in _texts_with(batches, WINDOWS):
            words = kept = text.split()
            if found.size:
                starts = _among(_windows(rolling, _word_hashes(words), window), found)
                gone = covered(len(words), starts, window).tolist()
                kept = [w for w, g in zip(words, gone, strict=True) if not g]
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            size += len(text)
            if size > 8 << 20 or len(rows) >= 2000:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    return _beside(source, repeats, levels).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """:func:`remove_repeats` with a digest in place of each kept text."""
    return remove_repeats(docs, id_col=id_col, text_col=text_col, window=window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
