"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within d bits agree on at least one of d + 1 blocks of bits, so
each block's value names a trie over the other bits.  A trie is joined with
itself by walking pairs of nodes together: a pair is dropped once the bits in
which its paths differ exceed the budget.  The walk covers all tries of a
chunk of rows at once, a level at a time, in NumPy.

:func:`near_duplicates` links fingerprints of 64 bits by their distance alone.
:func:`keep_one_each` wants texts of which 0.8 of the five-word shingles are
shared, which 64 bits cannot tell: it takes ``WIDE`` times 64 bits, joins each
run of 32 of them in tries of its own, and takes pairs that are near in all as
proposals.  What decides is the exact similarity of the two sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelloom.llm.components import connected_components
from panelloom.llm.store import bounded_batches, discard, free_name, materialize
from panelloom.llm.text import mix64, utf8

SEED = 42
#: A trie of more fingerprints is split into tries that agree on more bits.
TRIE_ROWS = 50_000
#: Words of 64 bits in a wide fingerprint, each of two halves that are joined.
WIDE = 5
#: Bits in which two halves may differ to be compared in full: at a similarity
#: of 0.8 one of ten halves does not exceed it in 998 of 1000 pairs.
HALF_BUDGET = 4
#: Bits in which wide fingerprints may differ to be proposed.  Texts of a
#: similarity of 0.8 differ in 49 of 320 in the mean, with a deviation of 6.4.
WIDE_BUDGET = 68
#: Equal halves of more fingerprints are linked to leaders, not to each other.
CROWD = 8
#: Texts are near copies from this share of common shingles on.
ALIKE = 0.8
#: Partners of one text that a task compares with it.
SPOKES = 1000
#: Pairs that are compared at once.
PAIRS = 1_000_000
#: Rows of a block of a group of near fingerprints, of which all pairs of blocks are compared.
BLOCK = 1024
#: Hubs that all rows of a group of more than a block are compared with first.
HUBS = 3
#: Words of 64 parities that tell in how many shingles two sets differ at least.
PARITIES = 32


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the lower-cased word shingles of a text, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    return np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, shingle: int = 3) -> int:
    """Majority of the XXH64 bits of lower-cased word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def wide_simhash(hashes: np.ndarray) -> list[int]:
    """Majorities of ``WIDE`` independent hashes of the distinct shingles."""
    return [majority(mix64(hashes + np.uint64(k + 1))) if len(hashes) else 0 for k in range(WIDE)]


def _row_keys(id_col: str, text_col: str) -> list:
    """Two hashes that tell a row's id and text, nulls among them, from any other."""
    return [F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.col(id_col).isNull(), id_col, F.lit(SEED))]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([simhash(x, shingle) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


WORDS = [f"w{k}" for k in range(WIDE)]


def wide_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, w0, w1, ..., size, set_a, set_b, key_a, key_b`` of every row.

    ``size`` counts its set of shingles, ``set_a`` and ``set_b`` are hashes of it, ``key_a`` and
    ``key_b`` of its id and text.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in utf8(batch.column(1))]
            rows = [[*wide_simhash(h), len(h), xxh64_intdigest(h, 1), xxh64_intdigest(h, 2)] for h in sets]
            bits = np.array(rows, np.uint64).reshape(-1, WIDE + 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in bits.T), *batch.columns[2:]], names)

    names = ["doc_id", *WORDS, "size", "set_a", "set_b", "key_a", "key_b"]
    marks = [k.alias(n) for k, n in zip(_row_keys(id_col, text_col), names[-2:], strict=True)]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *marks)
    return source.mapInArrow(run, ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names[1:])]))


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """``node`` and ``hashes``, the sorted distinct shingle hashes of its ``text`` as bytes."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)).tobytes() for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def alike(pairs: DataFrame, sets: DataFrame, least: float = ALIKE) -> DataFrame:
    """The pairs ``a, b`` (of distinct nodes) whose sets have a Jaccard similarity of at least ``least``.

    Of a pair the node with more partners is the hub.  Its set goes once to
    each task that has some ``SPOKES`` of its partners, which come there with
    theirs, so that no node with many partners is sent with each of them.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    degree = lambda name: ends.select(F.col("node").alias(name), F.struct("degree", "node").alias(f"{name}_degree"))
    met = pairs.join(degree("a"), "a").join(degree("b"), "b")
    hub = F.greatest("a_degree", "b_degree")
    met = met.select(hub["node"].alias("hub"), F.least("a_degree", "b_degree")["node"].alias("spoke"), F.ceil(hub["degree"] / SPOKES).cast("int").alias("parts"))
    spokes = met.withColumn("part", F.pmod(F.xxhash64("spoke"), F.col("parts")).cast("int"))
    hubs = met.select("hub", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = hubs.select("hub", "part", F.lit(None).cast("long").alias("spoke"), F.col("hub").alias("node"))
    rows = held.unionByName(spokes.select("hub", "part", "spoke", F.col("spoke").alias("node"))).join(sets, "node").drop("node")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("spoke"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for hub, spoke, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if spoke is None:
                    own = other
                elif min(len(own), len(other)) >= least * max(len(own), len(other)):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= least * (len(own) + len(other) - both):
                        found.append((min(hub, spoke), max(hub, spoke)))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("hub", "part", "spoke", "hashes").mapInArrow(run, "a long, b long")


class Balls:
    """Wide fingerprints, and the crowds among them that leaders stand for."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        self.radius = np.zeros(len(words), np.int64)
        self.members: dict[int, np.ndarray] = {}

    def far(self, a, b) -> np.ndarray:
        return np.bitwise_count(self.words[a] ^ self.words[b]).sum(axis=-1)

    def able(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of sets that are so equal in size that they may be alike."""
        a, b = self.sizes[a], self.sizes[b]
        return np.minimum(a, b) >= ALIKE * np.maximum(a, b)

    def middle(self, rows: np.ndarray) -> int:
        """The row nearest to the majority of the rows' bits."""
        ones = np.zeros(64 * self.words.shape[1], np.int64)
        for k in range(0, len(rows), 1 << 14):
            ones += np.unpackbits(np.ascontiguousarray(self.words[rows[k : k + (1 << 14)]]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        centre = np.packbits(2 * ones > len(rows)).view(np.uint64)
        return int(rows[np.bitwise_count(self.words[rows] ^ centre).sum(axis=1).argmin()])

    def lead(self, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Proposals within a crowd, and the rows that stand for it.

        The middle row leads all rows near it, then the middle one of their
        farther half leads those again, and so on; what is near no leader is
        led by its own middle row.  Proposals number twice the crowd at most.
        """
        a, b, stay = [], [], []
        while len(crowd):
            leader = self.middle(crowd)
            gap = self.far(crowd, leader)
            ball = crowd[gap <= WIDE_BUDGET]
            self.members[leader], self.radius[leader] = ball, gap[gap <= WIDE_BUDGET].max()
            crowd, rows, gap = crowd[gap > WIDE_BUDGET], ball, gap[gap <= WIDE_BUDGET]
            while True:
                stay.append(leader)
                near = rows[(gap <= WIDE_BUDGET) & (rows != leader)]
                a.append(near)
                b.append(np.full(len(near), leader))
                rows = rows[gap > np.median(gap)]
                if len(rows) <= CROWD:
                    break
                leader = self.middle(rows)
                gap = self.far(rows, leader)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b]), stay

    def judge(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proposals of pairs whose halves are near: themselves, or members of their balls.

        By the triangle inequality a ball can hold a row near another one only
        if its leader is no further than the budget and the radii.  Rows beyond
        the budget of a leader are compared with all its members.
        """
        gap = self.far(i, j)
        direct = gap <= WIDE_BUDGET
        out_a, out_b = [i[direct]], [j[direct]]
        for x, y in zip(*((v[~direct & (gap <= WIDE_BUDGET + self.radius[i] + self.radius[j])]).tolist() for v in (i, j)), strict=True):
            ours, theirs = self.members.get(x, np.array([x])), self.members.get(y, np.array([y]))
            ours = ours[self.far(ours, y) <= WIDE_BUDGET + self.radius[y]]
            theirs = theirs[self.far(theirs, x) <= WIDE_BUDGET + self.radius[x]]
            if len(ours) > len(theirs):
                ours, theirs = theirs, ours
            for row in ours.tolist():  # one link of each is enough to connect
                fit = theirs[self.able(theirs, np.full(len(theirs), row))]
                gaps = self.far(fit, row)
                if len(gaps) and gaps.min() <= WIDE_BUDGET:
                    out_a.append(np.array([row]))
                    out_b.append(fit[gaps.argmin()][None])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        able = self.able(a, b)
        return a[able], b[able]


def _pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, top: int = 63, judge: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints; each [start, end) is one sorted trie.

    Paths run from bit ``top`` down.  Pairs within the budget are handed to
    ``judge``, if given, which says what is linked.
    """
    out_a, out_b = [], []
    a0, a1, b0, b1 = starts, ends, starts, ends
    diff = np.zeros(len(starts), np.int64)

    def leaves(x0, y0, nx, ny):
        reps = nx * ny
        cut = np.flatnonzero(np.diff(np.cumsum(reps) // PAIRS)) + 1  # so many pairs at a time
        for x0, y0, ny, reps in zip(*(np.split(v, cut) for v in (x0, y0, ny, reps)), strict=True):
            which = np.repeat(np.arange(len(reps)), reps)
            k = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
            i, j = x0[which] + k // ny[which], y0[which] + k % ny[which]
            keep = i < j
            i, j = i[keep], j[keep]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            i, j = i[near], j[near]
            if judge is not None:
                i, j = judge(i, j)
            out_a.append(i)
            out_b.append(j)

    for bit in range(top, -2, -1):
        small = (a1 - a0) * (b1 - b0) <= 16 if bit >= 0 else np.ones(len(a0), bool)
        if small.any():  # leaves: compare the few left directly
            leaves(a0[small], b0[small], (a1 - a0)[small], (b1 - b0)[small])
            a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        cross = tuple(v[~same] for v in (am, a1, b0, bm, diff + 1))
        a0, a1, b0, b1, diff = (np.concatenate([p[n] for p in parts] + [cross[n]]) for n in range(5))
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = (v[live] for v in (a0, a1, b0, b1, diff))
    return np.concatenate([*out_a, np.empty(0, np.int64)]), np.concatenate([*out_b, np.empty(0, np.int64)])


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position with the least position that it reaches, if another."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _join_tries(keys: np.ndarray, fps: np.ndarray, budget: int, wide: np.ndarray | None = None, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys, as rows: a spanning set, or of ``wide`` ones links that connect all that are near."""
    edge = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) else np.empty(0, np.int64)
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
    group = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((fps, group))
    fps = fps[order]
    if wide is None:
        many = ends - starts > 1
        a, b = _pairs(fps, starts[many], ends[many], budget)
        moved, root = _spanning(len(fps), a, b)
        return order[moved], order[root]
    balls = Balls(wide[order], np.ones(len(order)) if sizes is None else sizes[order])
    stays, a, b = _without_crowds(group, fps, balls)
    before = np.concatenate(([0], np.cumsum(stays)))
    starts, ends = before[starts], before[ends]
    many = ends - starts > 1
    place = np.flatnonzero(stays)

    def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found.append(balls.judge(place[i], place[j]))
        if sum(len(x) for x, _ in found) > 4 * PAIRS:
            found[:] = [_spanning(len(order), *(np.concatenate(v) for v in zip(*found, strict=True)))]
        return none, none

    none = np.empty(0, np.int64)
    found = [(none, none)]
    _pairs(fps[place], starts[many], ends[many], budget, 31, judge)
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return order[np.concatenate((a, x))], order[np.concatenate((b, y))]


def _without_crowds(group: np.ndarray, fps: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows go on into the tries, leaders for their crowds, and proposals within crowds."""
    stays, a, b = np.ones(len(fps), bool), [], []
    edge = np.flatnonzero((fps[1:] != fps[:-1]) | (group[1:] != group[:-1])) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fps)]))
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        if j - i > CROWD:
            x, y, leaders = balls.lead(np.arange(i, j))
            stays[i:j] = False
            stays[leaders] = True
            a.append(x)
            b.append(y)
    none = np.empty(0, np.int64)
    return stays, np.concatenate([none, *a]), np.concatenate([none, *b])


def _masks(blocks: list[int], bits: int, parts: int) -> list[list[int]]:
    """The given bit positions dealt into ``parts`` runs."""
    return [blocks[i * bits // parts : (i + 1) * bits // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def near_links(distinct: DataFrame, budget: int = 2, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within ``budget`` bits.

    ``distinct`` has each ``fp`` once.  Within a trie only a spanning set of
    links is kept, so that there are fewer than ``budget + 1`` a fingerprint.
    A trie of more than ``trie_rows`` fingerprints is dealt into smaller ones
    by blocks of its other bits, again and again while bits last.
    """
    return _linked(_in_tries(distinct, list(range(64)), 0, budget, trie_rows), budget, [])


def wide_links(classes: DataFrame, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links ``a, b``, with repeats, that connect the numbers (``node``) of all near wide fingerprints.

    Two are compared in full if any of their halves differ in ``HALF_BUDGET``
    bits or fewer, and near if all their words differ in ``WIDE_BUDGET`` or
    fewer, unless their sets differ too much in ``size`` to be alike.  Of a
    trie each row is linked to the least that it reaches there, so that links
    grow with the rows and none that is near is left out.
    """
    halves = [F.col(w).bitwiseAND(0xFFFFFFFF) if low else F.shiftrightunsigned(w, 32) for w in WORDS for low in (True, False)]
    lanes = F.array(*[h.bitwiseOR(F.lit(k << 32)) for k, h in enumerate(halves)])
    rows = classes.select("node", *WORDS, "size", F.explode(lanes).alias("fp"))
    lane_bits = sum(1 << b for b in range(32, 32 + (2 * WIDE - 1).bit_length()))
    return _linked(_in_tries(rows, list(range(32)), lane_bits, HALF_BUDGET, trie_rows), HALF_BUDGET, [*WORDS, "size"])


def _in_tries(rows: DataFrame, bits: list[int], always: int, budget: int, trie_rows: int) -> DataFrame:
    """``rows`` with the ``mask`` and ``value`` of each trie that they lie in.

    Masks take some of ``bits`` and those of ``always``.
    """
    columns = rows.columns
    mask_of = lambda m: _mask(m) | always if always else _mask(m)
    chosen: list[list[int]] = _masks(bits, len(bits), budget + 1)
    keyed = rows.withColumn("mask", F.explode(F.array(*[F.lit(mask_of(m)) for m in chosen])))
    keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    for _ in range(3):
        big = keyed.groupBy("mask", "value").count().where(F.col("count") > trie_rows).select("mask", "value")
        if big.isEmpty():
            break
        big = materialize(big, "tries")
        rest = keyed.join(big, ["mask", "value"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        deeper, nexts = [], []
        for m in chosen:
            free = [b for b in bits if b not in m]
            for more in _masks(free, len(free), budget + 1):
                nexts.append(m + more)
                deeper.append((mask_of(m), mask_of(m + more)))
        chosen = nexts
        table = F.create_map(*[x for m in dict.fromkeys(d[0] for d in deeper) for x in (F.lit(m), F.array(*[F.lit(n) for k, n in deeper if k == m]))])
        keyed = keyed.join(big, ["mask", "value"], "left_semi").select(*columns, F.explode(table[F.col("mask")]).alias("mask"))
        keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    return keyed if done is None else done.unionByName(keyed)


def _linked(keyed: DataFrame, budget: int, words: list[str]) -> DataFrame:
    """Links within tries: between fingerprints, or nodes if there are wide ``words``."""
    at_once = 20_000 if words else 200_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            wide = np.ascontiguousarray(rows[:, 4:-1]).view(np.uint64) if words else None
            a, b = _join_tries(rows[:, 1:3], np.ascontiguousarray(rows[:, 0]).view(np.uint64) & low, budget, wide, rows[:, -1] if words else None)
            names = rows[:, 3 if words else 0]
            if words:
                names, at = np.unique(names, return_inverse=True)
                a, b = _spanning(len(names), at[a], at[b])
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

        low = np.uint64(0xFFFFFFFF if words else 0xFFFFFFFFFFFFFFFF)
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            count += len(held[-1])
            if count < at_once:
                continue
            rows = np.concatenate(held)
            whole = np.flatnonzero(np.any(rows[:, 1:3] != rows[-1, 1:3], axis=1))
            cut = whole[-1] + 1 if len(whole) else 0  # the last trie may go on
            if cut:
                yield links(rows[:cut])
            held, count = [rows[cut:]], len(rows) - cut
        if count:
            yield links(np.concatenate(held))

    dealt = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.select("fp", "mask", "value", *(["node", *words] if words else [])).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the least id that is reached by links between
    fingerprints of at most ``budget`` differing bits.  Null and empty texts
    have fingerprint zero, and link like any other.  Null ids never become a
    component's id unless all its ids are null.  Rows with one id and several
    texts are fingerprinted each; repeated rows are kept.
    """
    table = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = materialize(connected_components(near_links(classes.select("fp"), budget)), "roots")
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return table.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of ``64 * PARITIES`` bits each the parity of the hashes that fall on it.

    Those of two sets differ in no more bits than the sets in members.
    """
    counts = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def _alike_in(kinds: np.ndarray, nodes: np.ndarray, labels: np.ndarray, raws: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links that join all labels of which sets are alike, of one pair of blocks (see :func:`alike_within`)."""
    sets = [np.frombuffer(r, np.uint64) for r in raws]
    marks, sizes = np.array([parities(x) for x in sets]), np.array([len(x) for x in sets])
    label = np.unique(labels, return_inverse=True)[1]
    links = []
    for i in np.flatnonzero(kinds <= ASKS_ALL).tolist():
        fit = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
        fit &= (kinds == MAIN) | ((kinds == (MATE if kinds[i] == ASKS else ASKS_ALL)) & (nodes > nodes[i]))
        other = np.flatnonzero(fit)
        # of sets that are alike at most this share of both is in one of them only
        apart = np.bitwise_count(marks[other] ^ marks[i]).sum(axis=1)
        for j in other[apart <= (sizes[other] + sizes[i]) * (1 - least) / (1 + least) + 1e-6].tolist():
            if label[i] != label[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (sizes[i] + sizes[j] - common):
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    label[label == label[j]] = label[i]
    return links


#: What a row of a pair of blocks does there: asks those of the other block, or all of the only block; is asked, as one
#: of the most common label; is asked as one that asks elsewhere too.
ASKS, ASKS_ALL, MAIN, MATE = 0, 1, 2, 3


def alike_within(members: DataFrame, sets: DataFrame, least: float = ALIKE) -> DataFrame:
    """Links ``a, b`` that, with equal labels, connect all pairs of a group whose sets are alike.

    ``members`` is node, group, label.  Rows that have not their group's most
    common label ask all rows, a block a block in a task, and are compared
    with each of another label; a pair is dropped unseen only where sizes or
    parities rule it out.  Rows are sent as often as there are blocks.
    """
    counts = members.groupBy("group", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = members.join(most, "group").select("node", "group", "label", (F.col("label") != F.col("main")).alias("asks"), blocks(F.col("n") - F.col("n_main")).alias("asking"), blocks(F.col("n")).alias("asked"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["node", "group", "label"]
    ask = rows.where("asks").select(*names, F.when(F.col("asked") > 1, ASKS).otherwise(ASKS_ALL).alias("kind"), own("asking").alias("i"), every("asked").alias("j"))
    meet = rows.where("not asks or asked > 1").select(*names, F.when(F.col("asks"), MATE).otherwise(MAIN).alias("kind"), every("asking").alias("i"), own("asked").alias("j"))
    dealt = ask.unionByName(meet).join(sets, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            numbers = np.array([h[0] for h in held], np.int64)
            found = _alike_in(numbers[:, 0], numbers[:, 1], numbers[:, 2], [h[1] for h in held], least)
            return pa.RecordBatch.from_arrays([pa.array([int(x[n]) for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])

        held, key = [], None
        for batch in batches:
            group, i, j, kind, node, label, raw = (c.to_pylist() for c in batch.columns)
            for *k, row, h in zip(group, i, j, zip(kind, node, label, strict=True), raw, strict=True):
                if k != key:
                    if held:
                        yield links()
                    held, key = [], k
                held.append((row, h))
        if held:
            yield links()

    return dealt.select("group", "i", "j", "kind", "node", "label", "hashes").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, key_a, key_b, root`` of every row: its component of near copies.

    Texts are near if the sets of their ``shingle``-word runs have a Jaccard
    similarity of ``ALIKE`` or more; ``root`` is a number that means nothing
    but the component.  Texts that :func:`wide_links` connects are a group.
    Within a group all pairs are compared, exactly: in groups of more than a
    block each row with a few hubs first, so that only rows that no hub
    connects with most of the group have to ask all others.  Texts without
    words are one another's copies, null ones too.
    """
    table = materialize(wide_fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    sample = F.min(F.struct("key_a", "key_b")).alias("sample")
    classes = table.groupBy("set_a", "set_b").agg(*[F.min(w).alias(w) for w in (*WORDS, "size")], sample).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    groups = materialize(connected_components(wide_links(classes)), "groups").withColumnRenamed("root", "group")
    wanted = classes.join(groups, "node").select("node", F.col("sample.key_a").alias("_key_a"), F.col("sample.key_b").alias("_key_b"))
    key_a, key_b = _row_keys(id_col, text_col)
    texts = docs.select(key_a.alias("_key_a"), key_b.alias("_key_b"), F.col(text_col).alias("text")).join(wanted, ["_key_a", "_key_b"]).dropDuplicates(["node"])
    sets = materialize(shingle_sets(texts, shingle), "sets")
    large = groups.groupBy("group").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("node", F.lit(h)), "node"))["node"].alias(f"hub{h}") for h in range(HUBS)]).where(F.col("n") > BLOCK)
    hubs = groups.join(F.broadcast(large), "group").select("node", F.explode(F.array(*[f"hub{h}" for h in range(HUBS)])).alias("hub")).where("node <> hub")
    hubs = materialize(hubs, "hubs")
    links = materialize(alike(hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), sets), "links")
    # the least hub that a row is linked to, itself if it is one: rows of one label are connected
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = ends.join(hubs.distinct(), (F.col("a") == F.col("node")) & (F.col("b") == F.col("hub"))).groupBy("node").agg(F.min("hub").alias("label"))
    known = known.join(hubs.select(F.col("hub").alias("node")).distinct().withColumn("is_hub", F.lit(True)), "node", "left").select("node", F.when(F.col("is_hub"), F.least("label", "node")).otherwise(F.col("label")).alias("label"))
    members = materialize(groups.join(known, "node", "left").select("node", "group", F.coalesce("label", "node").alias("label")), "members")
    more = materialize(alike_within(members, sets), "links")
    found = materialize(connected_components(links.unionByName(more)), "roots").withColumnRenamed("node", "linked")
    for used in (sets, hubs, links, members, more):
        discard(used)
    named = classes.join(found, classes.node == found.linked, "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root"))
    return table.join(named, ["set_a", "set_b"]).select("doc_id", "key_a", "key_b", "root")


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs``, columns unchanged, with exactly one row of each component.

    See :func:`near_components`.  The row kept is that of the least id, null
    ids last; of rows that share it the one of the least hash of id and text.
    Of rows alike in id and text any one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b")
    best = near_components(docs, id_col=id_col, text_col=text_col, shingle=shingle).groupBy("root").agg(F.min(order).alias("least"))
    a, b = free_name(docs, "_key_a"), free_name(docs, "_key_b")
    keep = best.select(F.col("least.key_a").alias(a), F.col("least.key_b").alias(b))
    key_a, key_b = _row_keys(id_col, text_col)
    marked = docs.withColumns({a: key_a, b: key_b})
    return marked.join(keep, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
