"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by spaces and one end byte.  Each byte
is eight binary decisions, and each decision (a node of the byte's tree) has a
context tree of its own, whose contexts are the last 0 to ``depth`` bytes.
Krichevsky-Trofimov estimates of all depths are mixed by the weights that the
training texts leave: P_w = P_e / 2 + (product of the children's P_w) / 2.  A
text is scored with these weights held fixed.  A context that training never
reached takes its parent's estimate, not one half.

Counts are taken by blocks of documents, so that an n-gram travels once per
block and not once per occurrence.  They meet in buckets by the last two
bytes, where all trees below depth two are whole; what lies above is dense
arrays of fixed size.  The n-grams' probabilities then go back to the blocks
that hold them, never to the driver, and in the order of a block's own
n-grams, which it takes from its texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma, log
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelloom.llm.store import bounded_batches, materialize
from panelloom.llm.text import LOWER, mix64, utf8

DEPTH = 7
END = b"\xff"
#: Text per block of documents and per bucket of n-grams.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 8
#: Bytes counted at a time.
HELD = 2 << 20
FOLDS, HELD_OUT = 7, 2
GRAMS, WORDS = 0, 1
PACKED = "lane int, bucket int, block int, codes binary, counts binary"
HALF = log(0.5)
_TABLE = np.array([[lgamma(n + 0.5), lgamma(n + 1.0)] for n in range(4096)]).T.copy()
#: By the bits in which two bytes differ, the first bit at which their paths have parted.
_FRESH = np.array([9 - x.bit_length() for x in range(256)], np.uint8)


def is_held_out(doc_id) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def normal(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.translate(LOWER).split()
    return words, b" ".join(words)


def gram_codes(text: bytes, depth: int) -> np.ndarray:
    """Each byte and the end with its context: last byte first, then earlier ones, then the byte."""
    raw = END * 7 + text + END
    n = len(text) + 1
    window = np.ndarray((n,), "<u8", raw, strides=(1,))  # seven bytes, the earliest lowest, and the byte itself
    code = (window << np.uint64(8)) | (window >> np.uint64(56))
    if depth == 7:
        return code
    return ((code >> np.uint64(8 * (7 - depth))) & ~np.uint64(255)) | (code & np.uint64(255))


def word_codes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, then that of the end."""
    return np.array([xxh64_intdigest(w, 7) for w in words] + [xxh64_intdigest(b"", 7)], np.uint64)


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values, at = np.unique(np.concatenate(codes), return_inverse=True)
    return values, np.bincount(at, np.concatenate(counts), len(values)).astype(np.int64)


def _zip(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return zstandard.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unzip(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _zip_sorted(codes: np.ndarray) -> bytes:
    return _zip(np.diff(codes, prepend=np.uint64(0)))


def _unzip_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unzip(raw, np.uint64), dtype=np.uint64)


def _stirling(x: np.ndarray) -> np.ndarray:
    """lgamma of a large x."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    half, whole = _TABLE
    last = len(half) - 1
    n = n0 + n1
    out = half[np.minimum(n0, last)] + half[np.minimum(n1, last)] - whole[np.minimum(n, last)]
    big = n > last
    if big.any():
        parts = [np.where(x > last, _stirling(np.maximum(x, 1) + 0.5), half[np.minimum(x, last)]) for x in (n0[big], n1[big])]
        out[big] = parts[0] + parts[1] - _stirling(n[big] + 1.0)
    return out - log(np.pi)


def _up(codes: np.ndarray) -> np.ndarray:
    """The codes without the earliest byte of each context."""
    return ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255))


class Level(NamedTuple):
    """The trees' nodes at one depth, for one bit of the byte."""

    first: np.ndarray  #: first entry of each node
    node: np.ndarray  #: each entry's node
    n: np.ndarray
    ones: np.ndarray
    log_w: np.ndarray
    stop: np.ndarray | None  #: weight of the node's own estimate; None at the deepest
    above: np.ndarray | None  #: the node one byte shorter; None at the shallowest


class Forest:
    """The trees from depth ``top`` to ``depth`` of some n-grams, a bit at a time."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, top: int = 2) -> None:
        self.codes, self.counts, self.fresh, self.up = [], [], [], []
        for d in range(depth, top - 1, -1):
            fresh = np.zeros(len(codes), np.uint8)  # the bit from which an entry parts from the one before
            differ = codes[1:] ^ codes[:-1]
            np.copyto(fresh[1:], _FRESH[(differ & np.uint64(255)).astype(np.uint8)], where=differ < 256)
            self.codes.append(codes)
            self.counts.append(counts)
            self.fresh.append(fresh)
            if d > top:
                above = _up(codes)
                order = np.argsort(above, kind="stable")  # nearly sorted
                above = above[order]
                begins = np.r_[True, above[1:] != above[:-1]]
                first = np.flatnonzero(begins)
                up = np.empty(len(codes), np.int32)
                up[order] = np.cumsum(begins, dtype=np.int32) - 1
                self.up.append(up)
                codes, counts = above[first], np.add.reduceat(counts[order], first)

    def bit(self, i: int) -> list[Level]:
        """The nodes of each depth, deepest first."""
        out: list[Level] = []
        for k, (codes, counts) in enumerate(zip(self.codes, self.counts, strict=True)):
            begins = self.fresh[k] <= i
            first, node = np.flatnonzero(begins), np.cumsum(begins, dtype=np.int32) - 1
            n = np.add.reduceat(counts, first)
            ones = np.add.reduceat(counts * ((codes >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64), first)
            log_e = log_kt(n - ones, ones)
            if not out:
                out.append(Level(first, node, n, ones, log_e, None, None))
                continue
            below = out[-1]
            out[-1] = below._replace(above=node[self.up[k - 1][below.first]])
            children = np.bincount(out[-1].above, below.log_w, len(first))
            gap = children - log_e
            small = np.exp(-np.abs(gap))
            log_w = HALF + np.maximum(children, log_e) + np.log(1 + small)
            out.append(Level(first, node, n, ones, log_w, np.where(gap > 0, small, 1.0) / (1 + small), None))
        return out


def _node(codes: np.ndarray, i: int) -> np.ndarray:
    """Number of the byte tree's node at bit i: 1 for the first bit, then 2, 3."""
    return ((1 << i) | ((codes & np.uint64(255)) >> np.uint64(8 - i)).astype(np.int64)).astype(np.int64)


def top_sums(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """By last byte: counts of the next byte, and the sums over contexts of two
    bytes of log P_w of each node."""
    next_counts, sums = np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for part in _pairs(codes, depth):
        forest = Forest(codes[part], counts[part], depth)
        top = forest.codes[-1]
        np.add.at(next_counts, ((top >> np.uint64(16)).astype(np.int64), (top & np.uint64(255)).astype(np.int64)), forest.counts[-1])
        for i in range(8):
            level = forest.bit(i)[-1]
            at = top[level.first]
            np.add.at(sums, ((at >> np.uint64(16)).astype(np.int64), _node(at, i)), level.log_w)
    return next_counts, sums


def _pairs(codes: np.ndarray, depth: int, rows: int = 100_000) -> Iterator[slice]:
    """Runs of about ``rows`` sorted n-grams that end where a pair of last bytes does."""
    if not len(codes):
        return
    pair = codes >> np.uint64(8 * (depth - 1))
    ends = [*np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(codes)]
    start = 0
    for here, after in zip(ends, [*ends[1:], None], strict=True):
        if after is None or after - start > rows:
            yield slice(start, int(here))
            start = int(here)


class Crown:
    """Depths nought and one, dense: estimates and the weight of stopping there."""

    def __init__(self, next_counts: np.ndarray, sums: np.ndarray) -> None:
        self.kt, self.stop = [], []
        for i in range(8):
            n = next_counts.reshape(256, 1 << i, 2, -1).sum(-1)
            log_e = log_kt(n[..., 0], n[..., 1])
            log_w = np.logaddexp(HALF + log_e, HALF + sums[:, 1 << i : 2 << i])
            n_root = n.sum(0)
            root_e = log_kt(n_root[:, 0], n_root[:, 1])
            root_w = np.logaddexp(HALF + root_e, HALF + log_w.sum(0))
            self.kt.append(((n + 0.5) / (n.sum(-1, keepdims=True) + 1), (n_root + 0.5) / (n_root.sum(-1, keepdims=True) + 1), n.sum(-1)))
            self.stop.append((np.exp(HALF + log_e - log_w), np.exp(HALF + root_e - root_w)))


def log10_probabilities(codes: np.ndarray, counts: np.ndarray, depth: int, crown: Crown) -> np.ndarray:
    """log10 of the mixed probability of each n-gram's byte in its context.

    Down from the root: ``settled`` is the part of a node's mixture that its
    shallower contexts give, ``left`` the weight that remains for it and the
    deeper ones, and ``p`` the probability of a one if it is the last reached.
    """
    out = np.empty(len(codes))
    for part in _pairs(codes, depth):
        forest = Forest(codes[part], counts[part], depth)
        here, top = codes[part], forest.codes[-1]
        product = np.ones(len(here))
        for i in range(8):
            levels = forest.bit(i)
            at = top[levels[-1].first]
            last, inner = (at >> np.uint64(16)).astype(np.int64), _node(at, i) - (1 << i)
            one, root, n_one = crown.kt[i]
            stop_one, stop_root = crown.stop[i]
            stop = np.where(n_one[last, inner] > 0, stop_root[inner], 1.0)
            settled, left = stop * root[inner, 1], 1 - stop
            kt, stop = one[last, inner, 1], stop_one[last, inner]
            p = settled + left * kt
            settled, left = settled + left * stop * kt, left * (1 - stop)
            for k in range(len(levels) - 1, -1, -1):
                level = levels[k]
                kt = (level.ones + 0.5) / (level.n + 1)
                settled = np.where(level.n > 0, settled, p)
                left = np.where(level.n > 0, left, 0.0)
                p = settled + left * kt
                if k:
                    above = levels[k - 1].above
                    settled, left, p = (settled + left * level.stop * kt)[above], (left * (1 - level.stop))[above], p[above]
            bit = (here >> np.uint64(7 - i)) & np.uint64(1) == 1
            x = p[levels[0].node]
            product *= np.where(bit, x, 1 - x)
        out[part] = np.log10(product)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first ``keys`` values, which come together."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != now:
                yield now, rows
                rows = []
            now = row[:keys]
            rows.append(row)
    if rows:
        yield now, rows


def _portions(joined: bytes, depth: int) -> Iterator[np.ndarray]:
    """The n-grams of a text, some millions at a time."""
    for i in range(0, len(joined) + 1, HELD):
        piece = joined[max(0, i - depth) : i + HELD]
        codes = gram_codes(piece, depth)
        skip = min(i, depth)  # these bytes are context here
        yield codes[skip:] if i + HELD > len(joined) else codes[skip:-1]


def _count(source: DataFrame, depth: int, blocks: int) -> DataFrame:
    """Distinct n-grams and words of each block, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0
        kept: list[list[list[np.ndarray]]] = [[[], []], [[], []]]  # by lane, of held-out and of training texts
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def fold():
            for lane in (GRAMS, WORDS):
                for learn, codes in enumerate(kept[lane]):
                    if codes:
                        values, counts = np.unique(np.concatenate(codes), return_counts=True)
                        found[lane].append((values, counts * learn))
                        codes.clear()
                if len(found[lane]) > 8:
                    found[lane][:] = [_merge(*map(list, zip(*found[lane], strict=True)))]

        def out():
            fold()
            for lane in (GRAMS, WORDS):
                codes, counts = _merge(*map(list, zip(*found[lane], strict=True)))
                found[lane].clear()
                rows = []
                for b, mine in _by_bucket(codes, lane, depth, blocks):
                    rows.append((lane, b, now, _zip_sorted(codes[mine]), _zip(counts[mine])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lane", "bucket", "block", "codes", "counts"])

        for batch in batches:
            for block, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                if block != now:
                    if now is not None:
                        yield from out()
                    now, size = block, 0
                words, joined = normal(text)
                learn = 0 if is_held_out(doc_id) else 1
                kept[WORDS][learn].append(word_codes(words))
                for codes in _portions(joined, depth):
                    kept[GRAMS][learn].append(codes)
                    size += len(codes)
                    if size > HELD:
                        fold()
                        size = 0
        if now is not None:
            yield from out()

    return source.select("block", "doc_id", "text").mapInArrow(run, PACKED)


def _by_bucket(codes: np.ndarray, lane: int, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets in order, each with the places of its codes in theirs."""
    key = codes >> np.uint64(8 * (depth - 1)) if lane == GRAMS else codes
    bucket = (mix64(key) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[i]), order[i:j]


def _gathered(dealt: DataFrame) -> DataFrame:
    """One row per lane and bucket: all its codes with their counts, and for
    each block which of them it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lane, bucket), rows in _groups(batches, 2):
            parts = [_unzip_sorted(r[3]) for r in rows]
            codes, counts = _merge(parts, [_unzip(r[4], np.int64) for r in rows])
            members = [_zip(np.diff(np.searchsorted(codes, p), prepend=0).astype(np.uint32)) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_zip_sorted(codes)], pa.binary()), pa.array([_zip(counts)], pa.binary()), pa.array([[r[2] for r in rows]], pa.list_(pa.int32())), pa.array([members], pa.list_(pa.binary()))], ["lane", "bucket", "codes", "counts", "blocks", "members"])

    return dealt.mapInArrow(run, "lane int, bucket int, codes binary, counts binary, blocks array<int>, members array<binary>")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _summaries(gathered: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """What :class:`Crown` takes, and tokens and distinct tokens of the training texts."""
    schema = "place int, a binary, b binary"
    names = ["place", "a", "b"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, codes, counts in _each(batches):
            codes, counts = _unzip_sorted(codes), _unzip(counts, np.int64)
            if lane == WORDS:
                made = [(256, np.array([counts.sum()]).tobytes(), np.array([float((counts > 0).sum())]).tobytes())]
            else:
                next_counts, log_w = top_sums(codes, counts, depth)
                made = [(x, next_counts[x].tobytes(), log_w[x].tobytes()) for x in range(256) if next_counts[x].any() or log_w[x].any()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for place, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = held.setdefault(place, [0, 0])
                pair[0] = pair[0] + np.frombuffer(a, np.int64)
                pair[1] = pair[1] + np.frombuffer(b, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p[0].tobytes() for p in held.values()], pa.binary()), pa.array([p[1].tobytes() for p in held.values()], pa.binary())], names)

    next_counts, log_w, tokens, distinct = np.zeros((256, 256), np.int64), np.zeros((256, 256)), 0, 0
    parts = gathered.select("lane", "codes", "counts").mapInArrow(sums, schema)
    for r in parts.repartition("place").mapInArrow(add, schema).collect():  # 257 rows at most
        if r["place"] == 256:
            tokens, distinct = int(np.frombuffer(r["a"], np.int64)[0]), int(np.frombuffer(r["b"], np.float64)[0])
        else:
            next_counts[r["place"]], log_w[r["place"]] = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.float64)
    return next_counts, log_w, tokens, distinct


def _short(values: np.ndarray) -> np.ndarray:
    """float32 with 20 bits of precision, which compress better."""
    bits = values.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(8)) & np.uint32(0xFFFFFFF0)).view(np.float32)


def _priced(gathered: DataFrame, depth: int, crown) -> DataFrame:
    """For each block and bucket, in the order of the block's own codes: log10
    probabilities of n-grams, counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed = Crown(*crown.value)
        for lane, bucket, codes, counts, blocks, members in _each(batches):
            codes, counts = _unzip_sorted(codes), _unzip(counts, np.int64)
            values = counts if lane == WORDS else _short(log10_probabilities(codes, counts, depth, mixed))
            prices = [_zip(values[np.cumsum(_unzip(m, np.uint32), dtype=np.int64)]) for m in members]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([lane] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(prices, pa.binary())], ["block", "lane", "bucket", "prices"])

    return gathered.mapInArrow(run, "block int, lane int, bucket int, prices binary")


class _Numbered:
    """Codes that come in portions, and each one's place among the distinct ones."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, codes: list[np.ndarray]) -> None:
        values, places = np.unique(np.concatenate(codes), return_inverse=True)
        self.values.append(values)
        self.places.append(places.astype(np.int32))

    def whole(self) -> tuple[np.ndarray, Callable[[], Iterator[np.ndarray]]]:
        """The sorted distinct codes, and the places in them of each portion."""
        ends = np.cumsum([len(v) for v in self.values])
        every = np.concatenate(self.values)
        self.values.clear()
        values, places = np.unique(every, return_inverse=True)
        parts = np.split(places.astype(np.int32), ends[:-1])
        return values, lambda: (part[p] for part, p in zip(parts, self.places, strict=True))


def _scored(texts: list[tuple], prices: dict[tuple[int, int], bytes], depth: int, buckets: int, tokens: int, floor: float) -> Iterator[tuple]:
    """Rows of the texts of one block."""
    numbered, held, sizes = (_Numbered(), _Numbered()), ([], []), [0, 0]
    lengths: tuple[list[int], list[int]] = ([], [])
    for _, text in texts:
        words, joined = normal(text)
        for lane, parts in ((GRAMS, _portions(joined, depth)), (WORDS, (word_codes(words),))):
            n = 0
            for codes in parts:
                held[lane].append(codes)
                n += len(codes)
                sizes[lane] += len(codes)
                if sizes[lane] > HELD:
                    numbered[lane].add(held[lane])
                    held[lane].clear()
                    sizes[lane] = 0
            lengths[lane].append(n)
    told = []
    for lane, dtype in ((GRAMS, np.float32), (WORDS, np.int64)):
        if held[lane]:
            numbered[lane].add(held[lane])
            held[lane].clear()
        codes, portions = numbered[lane].whole()
        price = np.empty(len(codes), dtype)
        for b, mine in _by_bucket(codes, lane, depth, buckets):
            price[mine] = _unzip(prices[lane, b], dtype)
        ends = np.cumsum(lengths[lane])
        if lane == GRAMS:
            told.append(_sums(price.astype(np.float64), portions(), ends))
        else:
            told += [_sums(np.log10(price + 1.0) - floor, portions(), ends), _sums((price > 0).astype(np.float64), portions(), ends)]
    model, base, n_known = told
    for k, (doc_id, _) in enumerate(texts):
        yield doc_id, is_held_out(doc_id), lengths[WORDS][k], int(n_known[k]), tokens, float(base[k]), float(model[k]), float(-model[k] / np.log10(2) / lengths[GRAMS][k])


def _sums(values: np.ndarray, portions: Iterator[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Sums of runs, which end at ``ends``, of the values at places that come in portions."""
    out, at = np.zeros(len(ends)), 0
    for places in portions:
        upto = np.concatenate(([0.0], np.cumsum(values[places])))
        out += np.diff(upto[np.clip(ends - at, 0, len(places))], prepend=0.0)
        at += len(places)
    return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: its fold, token counts, base and model score.

    ``score`` is the model's log10 probability of the text, ``bits_per_byte``
    its code length over the bytes coded (the end among them); ``base_score``
    that of add-one smoothed counts of words, log10((c + 1) / (N + V + 1)).  Null and empty texts are an end alone.
    A null id counts as the empty text for the fold.  Repeated rows are scored,
    and learned from, each time; without training texts every bit costs one.
    An empty table gives an empty one; other columns are ignored.  ``depth``
    is 3 to 7.  N-gram probabilities travel with 20 bits of precision.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    together = source.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")
    dealt = _count(together, depth, blocks).repartitionById(2 * blocks, F.col("lane") * blocks + F.col("bucket")).sortWithinPartitions("lane", "bucket")
    gathered = materialize(_gathered(dealt), "grams")
    next_counts, log_w, tokens, distinct = _summaries(gathered, depth)
    prices = _priced(gathered, depth, spark.sparkContext.broadcast((next_counts, log_w)))
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, texts = None, {}, []
        floor = float(np.log10(tokens + distinct + 1))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

        def out(kind):
            kinds = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            rows = list(_scored(texts, table, depth, blocks, tokens, floor))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for block, lane, bucket, doc_id, text, price in zip(*(batch.column(i).to_pylist() for i in range(4)), utf8(batch.column(4)), batch.column(5).to_pylist(), strict=True):
                if block != now:
                    if texts:
                        yield out(batch.schema.field(3).type)
                    now, table, texts = block, {}, []
                if lane < 2:
                    table[lane, bucket] = price
                else:
                    texts.append((doc_id, text))
        if texts:
            yield out(batch.schema.field(3).type)

    none = lambda t: F.lit(None).cast(t)
    asked = source.select("block", F.lit(2).alias("lane"), F.lit(0).alias("bucket"), "doc_id", "text", none("binary").alias("prices"))
    told = prices.select("block", "lane", "bucket", none(kind).alias("doc_id"), none("string").alias("text"), "prices")
    both = told.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "lane")
    return both.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
