"""Document fingerprints: every shingle hash below a fixed fraction of the hashes' range.

The fraction is one of a text of up to ``FULL`` distinct shingles, and half as
much for each doubling of that, down to ``SHARE``; so fractions are nested, and
any two sketches are compared, or merged, below the lesser fraction, where
both are complete.  The part of one that lies in another estimates containment
however unequal the documents are, and is exact between texts of up to
``FULL`` shingles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelloom.llm.store import bounded_batches
from panelloom.llm.text import Rolling

SHINGLE = 5
SHARE = 1 / 8
#: Distinct shingles of which all hashes are kept.
FULL = 512
#: Text per bucket of ids, and the least number of buckets.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 8
#: Stands for a null id, so that it comes last in descending order.
NO_ID = -(1 << 63)


#: A sketch: sorted hashes, and how often the range was halved.
Sketch = tuple[np.ndarray, int]


def fraction(shingles: int, share: float = SHARE) -> int:
    """How often the range is halved for a text of so many distinct shingles."""
    halvings = 0
    while shingles > FULL << halvings and 2.0**-halvings > share:
        halvings += 1
    return halvings


def _below(hashes: np.ndarray, halvings: int) -> np.ndarray:
    """The sorted hashes below the fraction."""
    return hashes[: np.searchsorted(hashes, np.uint64((1 << 64 >> halvings) - 1), "right")]


def sketch(text: bytes, rolling: Rolling, shingle: int = SHINGLE, share: float = SHARE) -> Sketch:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64), 0
    hashes = np.unique(rolling.runs(np.array([xxh64_intdigest(w) for w in words], np.uint64), min(shingle, len(words))))
    halvings = fraction(len(hashes), share)
    return _below(hashes, halvings), halvings


def written(found: Sketch) -> str:
    """A sketch as text: the halvings, a colon and the hashes; that of a text without words is empty."""
    return f"{found[1]}:{base64.b64encode(found[0].astype('>u8').tobytes()).decode()}" if len(found[0]) or found[1] else ""


def parsed(fingerprint: str) -> Sketch:
    halvings, _, hashes = (fingerprint or "0:").partition(":")
    return np.frombuffer(base64.b64decode(hashes), ">u8").astype(np.uint64), int(halvings)


def merged(a: str, b: str) -> str:
    """The fingerprint of both documents' shingles together, below the lesser of their fractions."""
    (x, n), (y, m) = parsed(a), parsed(b)
    halvings = max(n, m)
    return written((np.union1d(_below(x, halvings), _below(y, halvings)), halvings))


def likeness(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimates of the share of a's shingles in b, and of Jaccard's index.

    Two empty sketches are alike (1.0); an empty one is like no other (0.0),
    as is one of which nothing lies below the other's fraction.
    """
    if not len(a[0]) or not len(b[0]):
        both = float(len(a[0]) == len(b[0]))
        return both, both
    halvings = max(a[1], b[1])
    x, y = _below(a[0], halvings), _below(b[0], halvings)
    if not len(x) or not len(y):
        return 0.0, 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / len(x), common / (len(x) + len(y) - common)


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) in buckets of descending ids, each with a guest.

    The guest is the row after the bucket's last, that is the first of the
    next bucket or, at the end, of all.  Bounds are quantiles of the ids, so
    the driver holds no more than two numbers a bucket.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    cuts = np.unique(np.array(cuts if cuts is not None else [], np.int64))
    shared_cuts = spark.sparkContext.broadcast(cuts)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            values = batch.column(0).to_numpy()
            for v, b in zip(values.tolist(), np.searchsorted(shared_cuts.value, values).tolist(), strict=True):
                if v > best.get(b, NO_ID - 1):
                    best[b] = v
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["bucket", "top"])

    top = {r.bucket: r.top for r in ids.mapInArrow(tops, "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(top)  # a row's guest bucket is the next higher one; the highest is the guest of the lowest
    guest_of = {top[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    shared = spark.sparkContext.broadcast((cuts, guest_of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, guests = shared.value
        for batch in batches:
            values = batch.column(0).to_numpy()
            bucket = np.searchsorted(bounds, values)
            again = [i for i, v in enumerate(values.tolist()) if v in guests]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bucket.astype(np.int64)), pa.array(np.zeros(len(values), np.int8))], ["doc_id", "text", "bucket", "guest"])
            if again:
                take = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array([guests[values[i]] for i in again], pa.int64()), pa.array(np.ones(len(again), np.int8))], ["doc_id", "text", "bucket", "guest"])

    dealt = docs.mapInArrow(deal, "doc_id long, text string, bucket long, guest byte")
    return dealt.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.desc("doc_id"), F.xxhash64("text"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """Each text's fingerprint, and its likeness to an edited and to the next text.

    The next document follows in descending id (null ids last, repeated ids by
    a hash of the text), the first after the last; a single row follows
    itself.  ``near_edited`` and ``near_next`` estimate the share of this
    text's shingles in the other; ``jaccard_*`` estimate Jaccard's index.
    Null texts are empty; every row has one result; other columns are left
    out.  Texts move in one shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        bucket, last = None, None
        for batch in batches:
            out: list[tuple] = []
            for doc, text, at, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != bucket:
                    bucket, last = at, None
                elif last is None:  # a further row with the guest's id
                    continue
                own = sketch(text.encode(), rolling, shingle, share)
                if last is not None:
                    n = len(last[1])
                    edited = (last[1][: n - n // 2] + text[: n // 2]).encode()
                    other = sketch(edited, rolling, shingle, share)
                    near, near_j = likeness(last[2], other)
                    ahead, ahead_j = likeness(last[2], own)
                    out.append((last[0], n, sha256(edited).hexdigest(), written(last[2]), written(other), near, ahead, near_j, ahead_j))
                last = None if guest else (doc, text, own)
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    made = _dealt(source, parts).mapInArrow(run, schema)
    return made.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
