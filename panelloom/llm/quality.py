"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed n-grams are fitted, one to the target (texts
labelled good), one to all raw text; a document's importance is the ratio of
its likelihoods, and a sample is drawn without replacement by Gumbel top-k.

N-grams are runs of five bytes, once of the text with its white space evened
out and once of its lower-cased words alone; a document's n-grams count once.
A bucket's ratio is taken only where the two models differ by more than a
factor of ``EFFECT``, beyond ``Z`` standard errors, else it is one: so rare
n-grams add little noise, ratios near one do not add up over a long text, and
with more text ever more buckets take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.store import bounded_batches, free_name, materialize
from panelloom.llm.text import ALNUM, Rolling, mix64, utf8

GRAM = 5
BUCKET_BITS = 20
#: The summed counts travel in this many ranges of buckets.
RANGES = 64
#: A ratio counts if it is beyond a factor of ``EFFECT`` by ``Z`` standard errors
#: and so many documents are expected to have the n-gram.
Z, EFFECT, FEWEST = 2.0, 2.0, 5
#: Labelled rows used to fit and calibrate, at most; chosen by a hash of the id.
MAX_LABELLED = 200_000
#: One in so many labelled rows calibrates the cut instead of fitting.
HELD_OUT = 5
#: Share of good calibration rows that the cut may lose.
MAX_LOSS = 0.005
SEED = 20_240_607
TARGET, GOOD, BAD = 1, 2, 3
#: What a fitted model depends on beside the rows.
SETTINGS = (GRAM, BUCKET_BITS, Z, EFFECT, FEWEST, MAX_LABELLED, HELD_OUT, MAX_LOSS, SEED)


class Grams:
    """Buckets of a text's n-grams."""

    def __init__(self) -> None:
        self.rolling = Rolling()
        self.letters = [mix64(np.arange(1 + 256 * s, 257 + 256 * s, dtype=np.uint64)) for s in range(2)]

    def __call__(self, text: bytes) -> np.ndarray:
        parts = []
        for letters, words in zip(self.letters, (text.split(), text.translate(ALNUM).split()), strict=True):
            if words:
                codes = letters[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)]
                for i in range(0, len(codes), 1 << 18):  # bounded memory for very long texts
                    parts.append((self.rolling.runs(codes[i : i + (1 << 18) + GRAM - 1], GRAM) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def _roles(labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and roles of the labelled rows in use.

    Repeated labels of one id count as bad if any is; rows with a null are
    not used.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    one = known.groupBy("doc_id").agg((F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0))).alias("good"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0)
    role = F.when(F.col("held") & (F.col("good") == 1), GOOD).when(F.col("held"), BAD).when(F.col("good") == 1, TARGET)
    table = rows.select("doc_id", role.cast("int").alias("role")).where("role is not null").toArrow()
    ids, roles = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(ids)
    return ids[order], roles[order]


def _role_of(ids: np.ndarray, roles: np.ndarray, column: pa.Array) -> np.ndarray:
    values = column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.zeros(len(values), np.int32)
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    return np.where(ids[at] == values, roles[at], 0)


def _counts(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Documents per bucket, of all text and of the target."""
    width = (1 << BUCKET_BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, both = Grams(), np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            roles = _role_of(*shared.value, batch.column(0))
            for text, role in zip(utf8(batch.column(1)), roles.tolist(), strict=True):
                found = grams(text)
                both[0, found] += 1
                if role == TARGET:
                    both[1, found] += 1
        blocks = both.reshape(2, RANGES, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([blocks[:, r].tobytes() for r in range(RANGES)], pa.binary())], ["range", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[r] = sums.get(r, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["range", "counts"])

    schema = "range int, counts binary"
    summed = docs.mapInArrow(count, schema).repartition(RANGES, "range").mapInArrow(add, schema)
    out = np.zeros((2, RANGES, width), np.int64)
    for r in summed.collect():  # 16 bytes a bucket, whatever the corpus
        out[:, r["range"]] = np.frombuffer(r["counts"], np.int64).reshape(2, width)
    return out.reshape(2, -1)[0], out.reshape(2, -1)[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, z: float = Z, effect: float = EFFECT) -> np.ndarray:
    """The log ratio of target to raw of each bucket, 0 where it may be within a factor of ``effect``.

    Most n-grams are a little more frequent in good texts than in all; summed
    over a long text, such ratios would outweigh the few n-grams that tell.
    """
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    share = target.sum() / raw.sum()
    expected = raw * share
    least, most = expected / effect, expected * effect
    told = (target < least - z * np.sqrt(least * (1 - share))) | (target > most + z * np.sqrt(most * (1 - share)))
    return np.where(told & (expected >= FEWEST), np.log((target + 1) / (expected + 1)), 0).astype(np.float32)


def cut_between(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The score that best parts bad from good, losing few good ones.

    Of cuts that lose at most ``max_loss`` of the good it takes the one with
    the greatest excess of bad over good shares below it, the least if
    several, and moves it to the middle of the gap.  Without bad rows none is
    cut.
    """
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate((good, bad)))
    lost = np.searchsorted(np.sort(good), values, "right") / len(good)
    caught = np.searchsorted(np.sort(bad), values, "right") / len(bad)
    gain = np.where(lost <= max_loss, caught - lost, -1)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("-inf")
    return float(values[best] + values[min(best + 1, len(values) - 1)]) / 2


def _gumbel(hashes: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise of 64-bit hashes."""
    u = ((hashes.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles."""
    bits = keys.astype(np.float64).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def _kth_largest(table: DataFrame, k: int) -> int:
    """The k-th largest ``place``, by counts of 16 bits at a time."""
    part, prefix = table.select("place"), None
    for shift in (48, 32, 16, 0):
        here = part if prefix is None else part.where(F.shiftright("place", shift + 16) == prefix)
        counts = sorted(((r["top"], r["count"]) for r in here.groupBy(F.shiftright("place", shift).alias("top")).count().collect()), reverse=True)
        for top, n in counts:  # 65 536 at most
            if k <= n:
                prefix = top
                break
            k -= n
    return prefix


class Model:
    """Fitted ratios, cut and the place of the last row of the sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> None:
        bounded_batches(docs.sparkSession)
        self.context = docs.sparkSession.sparkContext
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(SEED)).alias("noise"))
        ids, roles = _roles(labels, max_labelled)
        shared = self.context.broadcast((ids, roles))
        self.ratios = self.context.broadcast(log_ratios(*_counts(source, shared)))
        self.scores = materialize(self._scored(source, shared), "scores")
        held = self.scores.where(F.col("role") >= GOOD).select("role", "log_weight").toArrow()
        role, weight = held.column(0).to_numpy(), held.column(1).to_numpy()
        self.cut = cut_between(weight[role == GOOD], weight[role == BAD])
        self.k = self.scores.where(F.col("log_weight") >= self.cut).count()
        self.last = _kth_largest(self.scores, self.k) if self.k else None

    def _scored(self, source: DataFrame, shared) -> DataFrame:
        ratios = self.ratios

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, table = Grams(), ratios.value
            for batch in batches:
                weight = np.array([float(table[grams(x)].sum(dtype=np.float64)) for x in utf8(batch.column(1))], np.float64)
                key = weight + _gumbel(batch.column(2).to_numpy())
                role = _role_of(*shared.value, batch.column(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(_ordered(key)), pa.array(role)], ["doc_id", "log_weight", "gumbel_key", "place", "role"])

        kind = source.schema["doc_id"].dataType.simpleString()
        return source.mapInArrow(score, f"doc_id {kind}, log_weight double, gumbel_key double, place long, role int")

    def classified(self) -> DataFrame:
        keep = F.lit(False) if self.last is None else F.col("place") >= F.lit(self.last)
        return self.scores.select("doc_id", "log_weight", "gumbel_key", keep.alias("keep"))

    def kept(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs``, columns unchanged, without the rows that are not sampled.

        Weights are computed again rather than joined, so texts do not move
        and rows need no unique id: each is judged by its own text and id.
        """
        ratios, last, text_at, noise = self.ratios, self.last, docs.columns.index(text_col), free_name(docs, "_noise")
        if last is None:
            return docs.limit(0)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, table = Grams(), ratios.value
            for batch in batches:
                weight = np.array([float(table[grams(x)].sum(dtype=np.float64)) for x in utf8(batch.column(text_at))], np.float64)
                place = _ordered(weight + _gumbel(batch.column(batch.num_columns - 1).to_numpy()))
                yield batch.filter(pa.array(place >= last))

        with_noise = docs.withColumn(noise, F.xxhash64(id_col, F.lit(SEED)))
        return with_noise.mapInArrow(keep, with_noise.schema).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, log_weight, gumbel_key, keep``.

    ``k``, the size of the sample, is the number of rows whose log weight
    reaches a cut set on held-out labelled rows; the k rows of the greatest
    log weight plus Gumbel noise are kept.  The noise comes from a hash of
    the id, so a rerun draws the same sample, and rows that tie with the
    k-th are kept.  Null and empty texts have no n-grams and weight 0; null
    ids share one noise.  Without good or bad labels everything is kept; an
    empty table gives an empty one.  Labels (doc_id, quality, toxic): see
    ``MAX_LABELLED`` for the bound; counts cover all documents.
    """
    return Model(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled).classified()


def keep_sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, columns unchanged.

    Repeated rows stay or go together; null and empty texts have weight 0 like
    any other of that weight; an empty table stays empty, and columns may have
    any names.
    """
    return Model(docs, labels).kept(docs)
