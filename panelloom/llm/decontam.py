"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the word.  Every pattern of a matcher has the same number of
words; a table maps each block of up to three words to the distance by which
the search may advance, and a block that ends patterns to a bucket of them,
each compared word for word.

Words are numbered by a vocabulary of the benchmark, and patterns are places
in its text, so that a matcher takes some 200 bytes a word.  It is plain data:
workers need not import this package to read it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.store import bounded_batches, discard, free_name, materialize
from panelloom.llm.text import ALNUM, utf8

#: Text of the benchmark that is compiled at once; the matchers of so much
#: take some 150 MB on the driver and in each worker.
BLOCK_BYTES = 4 << 20
#: Bits of a word's number in the key of a block of words: but for some 65 000,
#: different words take three bytes or more, so that a block has fewer.
WORD_BITS = 21


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Matcher(NamedTuple):
    """All patterns of one length."""

    length: int
    block: int
    #: By key of a block: the shift if it is positive, else minus one less the
    #: number of a bucket.
    table: dict[int, int]
    #: Of each pattern in a bucket: where its words start, and its set of items.
    buckets: list[list[tuple[int, int]]]


class Patterns(NamedTuple):
    """The matchers of some items, in plain values."""

    vocabulary: dict[bytes, int]
    text: bytes  #: numbers of all items' words, four bytes each
    items: list[tuple[str, ...]]  #: sets of items, by number
    matchers: list[tuple]


def _keys(numbers: np.ndarray, block: int) -> list[int]:
    """The key of the block that starts at each word; negative if a word is unknown."""
    n = len(numbers) - block + 1
    if n <= 0:
        return []
    wide = numbers.astype(np.int64)
    keys = np.zeros(n, np.int64)
    known = np.ones(n, bool)
    for k in range(block):
        keys = (keys << WORD_BITS) | (wide[k : k + n] & ((1 << WORD_BITS) - 1))
        known &= wide[k : k + n] >= 0
    return np.where(known, keys, -1).tolist()


def compile_patterns(items: Iterable[tuple[str, bytes]], window: int) -> Patterns:
    vocabulary: dict[bytes, int] = {}
    numbers: list[int] = []
    places: dict[int, list[tuple[int, int, str]]] = {}  # by length: first and last start, item
    for item, text in items:
        w = words(text)
        if w:
            size = min(window, len(w))
            places.setdefault(size, []).append((len(numbers), len(numbers) + len(w) - size, item))
            numbers += [vocabulary.setdefault(x, len(vocabulary)) for x in w]
    coded = np.array(numbers, np.int32)
    text = coded.tobytes()
    sets: dict[tuple[str, ...], int] = {}
    matchers = []
    for size, found in sorted(places.items()):
        block = min(3, size)
        keys = _keys(coded, block)
        holders: dict[bytes, tuple[int, set[str]]] = {}
        for first, last, item in found:
            for i in range(first, last + 1):
                holders.setdefault(text[4 * i : 4 * (i + size)], (i, set()))[1].add(item)
        table: dict[int, int] = {}
        buckets: list[list[tuple[int, int]]] = []
        for i, who in holders.values():
            for end in range(i + block, i + size):
                key, shift = keys[end - block], i + size - end
                table[key] = min(table.get(key, shift), shift)
            key = keys[i + size - block]
            if table.get(key, 1) > 0:
                table[key] = -1 - len(buckets)
                buckets.append([])
            buckets[-1 - table[key]].append((i, sets.setdefault(tuple(sorted(who)), len(sets))))
        matchers.append(tuple(Matcher(size, block, table, buckets)))
    return Patterns(vocabulary, text, list(sets), matchers)


def occurrences(matcher: Matcher, keys: list[int], here: bytes, patterns: bytes) -> Iterator[tuple[int, int]]:
    """The first word of each occurrence, with the set of items that hold it.

    ``keys`` and ``here`` are the keys and the numbers of a text's words.
    """
    size, block, table, buckets = matcher
    farthest = size - block + 1
    end, n = size, len(here) // 4
    get = table.get
    while end <= n:
        far = get(keys[end - block], farthest)
        if far > 0:
            end += far
            continue
        start = end - size
        words_here = here[4 * start : 4 * end]
        for at, who in buckets[-1 - far]:
            if patterns[4 * at : 4 * (at + size)] == words_here:
                yield start, who
        end += 1


def _marks(patterns: Patterns, text: bytes) -> tuple[int, list[int], set[str]]:
    """Number of words; starts and ends, in turn, of covered runs; items found."""
    w = words(text)
    number = patterns.vocabulary.get
    coded = np.array([number(x, -1) for x in w], np.int32)
    here = coded.tobytes()
    keys = {block: _keys(coded, block) for block in {m[1] for m in patterns.matchers}}
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    for m in patterns.matchers:
        for start, who in occurrences(Matcher(*m), keys[m[1]], here, patterns.text):
            spans.append((start, start + m[0]))
            found.add(who)
    return len(w), _merged(spans), {item for who in found for item in patterns.items[who]}


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(df: DataFrame, text_col: str, patterns: Patterns, state: tuple[str, str, str]) -> DataFrame:
    """``df`` with its running state brought forward by one block of patterns."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(patterns))
    schema = df.schema
    runs_col, items_col, words_col = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Patterns(*shared.value)
        for batch in batches:
            runs, found, count = [], [], []
            at = batch.schema.names.index
            old = zip(batch.column(at(runs_col)).to_pylist(), batch.column(at(items_col)).to_pylist(), strict=True)
            for text, (had, items) in zip(utf8(batch.column(at(text_col))), old, strict=True):
                n, new, seen = _marks(compiled, text)
                both = [*zip(had[::2], had[1::2], strict=True), *zip(new[::2], new[1::2], strict=True)] if had else None
                runs.append(_merged(both) if both else new)
                found.append(sorted({*items, *seen}))
                count.append(n)
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            columns |= {runs_col: pa.array(runs, pa.list_(pa.int32())), items_col: pa.array(found, pa.list_(pa.string())), words_col: pa.array(count, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


STATE = ("_hit_runs", "_hit_items", "_n_words")


def _pieces(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, most: int) -> DataFrame:
    """``item, text`` of the benchmark, each once, items of more than ``most`` bytes in parts that share a window less a word.

    Parts are long enough to hold whole windows only, all of which lie in one.
    """
    text = F.coalesce(F.col(item_text_col), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text.alias("text")).distinct()
    long = F.octet_length("text") > most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, whole in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                w, start = words(whole), 0
                while start == 0 or start + window <= len(w):
                    end, size = start, 0
                    while end < len(w) and (size < most or end < start + window):
                        size += len(w[end]) + 1
                        end += 1
                    part = b" ".join(w[start:end]).decode(errors="surrogateescape")
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([part])], ["item", "text"])
                    if end == len(w):
                        break
                    start = end - window + 1

    return items.where(~long).unionByName(items.where(long).mapInArrow(cut, "item string, text string"))


def _blocks(pieces: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``pieces`` dealt into blocks of at most ``most`` bytes (or one piece), and the number of blocks.

    Blocks are halved until the largest fits.
    """
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if total <= most else 2 * -(-total // most)
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        size = F.sum(F.octet_length("text")).alias("size")
        if blocks == 1 or dealt.groupBy("block").agg(size, F.count("*").alias("n")).where((F.col("size") > most) & (F.col("n") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, state: tuple[str, str, str] = STATE) -> DataFrame:
    """``docs`` with the benchmark windows found in each text.

    Added, under the names in ``state``: runs of hit words (starts and ends,
    in turn, end exclusive), the sorted ids of the items found and the number
    of words; columns of these names in ``docs`` are replaced.  An item of
    fewer words than ``window`` is one window; an item without words has none.
    Null texts have no words; a null item id counts as the empty string.  Rows
    are neither dropped nor merged, so that repeated rows stay and an empty
    table gives an empty one.

    The benchmark, its repeated rows once, reaches the workers in blocks of at
    most ``block_bytes`` of text (one, nearly always), into which a longer item
    goes in parts; each is searched in a pass of its own over the documents,
    which are not shuffled.  Between two passes rows and state are written to
    the shared folder, so that driver and workers never hold more than a block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = materialize(_pieces(benchmark, item_col, item_text_col, window, block_bytes // 4), "benchmark")
    dealt, blocks = _blocks(pieces, block_bytes)
    runs_col, items_col, words_col = state
    out = docs.drop(*state).withColumns({runs_col: F.array().cast("array<int>"), items_col: F.array().cast("array<string>"), words_col: F.lit(None).cast("long")})
    for k in range(blocks):
        before, part = out, dealt.where(F.col("block") == k)
        out = _scan(out, text_col, compile_patterns(((r.item, r.text.encode(errors="surrogateescape")) for r in part.toLocalIterator()), window), state)
        if k < blocks - 1:
            out = materialize(out, "scanned")
            discard(before)
    discard(pieces)
    return out


def _n_hit(runs: str = "_hit_runs"):
    """Words covered by the runs: ends less starts."""
    return F.coalesce(F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, least_share: int = 20) -> DataFrame:
    """One row per row of ``docs``: words, hit words, items and the verdict.

    A text is contaminated if at least one in ``least_share`` of its words is
    hit.  See :func:`find_contamination` for nulls, empty texts and ties.
    """
    found = find_contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window=window)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        "_hit_runs",
    ).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.col("_hit_runs").alias("hit_runs"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, least_share: int = 20) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text is not contaminated.

    Rows are judged one by one: repeated rows stay or go together, null and
    empty texts stay, ids are not looked at, and an empty table or benchmark
    drops nothing.  Columns may have any names.
    """
    state = tuple(free_name(docs, x) for x in STATE)
    found = find_contamination(docs, benchmark, window=window, state=state)
    hit = _n_hit(state[0])
    return found.where(~((hit > 0) & (least_share * hit >= F.col(state[2])))).select(*docs.columns)
