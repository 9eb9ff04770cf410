"""Whitening of embeddings by a tall-skinny QR, without a covariance matrix.

Entries become whole numbers, so that their sums are exact and rows are centred
without rounding.  Each partition folds its centred rows into one triangular
factor R; factors are stacked and factored again, eight at a time, until one is
left.  Its right singular vectors whiten, as the covariance is R'R / n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.store import bounded_batches, discard, materialize

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: No whole number of 64 bits stands for entries from here on.
LARGEST = 2.0**52
#: Factors merged by one task.
FAN = 8


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that hold ``width`` finite numbers, and these as whole ones."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(column.is_valid()) & (lengths == width)
    with np.errstate(invalid="ignore"):
        good[row[~(np.abs(values) < LARGEST)]] = False
    places = np.flatnonzero(good)
    whole = np.floor(values[good[row]] * SCALE).astype(np.int64) + SHIFT
    return places, whole.reshape(len(places), width)


def _exact(whole: np.ndarray, times: int) -> np.ndarray:
    """``whole``, as Python's numbers if ``times`` as much could be beyond 64 bits."""
    return whole.astype(object) if int(np.abs(whole).max(initial=0)) * times >= 1 << 61 else whole


def _off(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n`` times the distance to the mean, exact."""
    many = _exact(whole, 2 * n) if max(map(abs, sums)) < 1 << 61 else whole.astype(object)
    return n * many - np.array(sums, many.dtype)


def _lengths_and_sums(source: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By number of entries: how many vectors have it, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for width in np.unique(np.diff(np.asarray(batch.column(0).offsets))):
                places, whole = _matrix(batch.column(0), int(width))
                n, sums = held.get(int(width), (0, np.zeros(width, object)))
                held[int(width)] = n + len(places), sums + _exact(whole, len(whole)).sum(axis=0)
        found = [(w, n, s) for w, (n, s) in held.items() if n and w]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _, _ in found], pa.int32()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([[str(x) for x in s] for _, _, s in found], pa.list_(pa.string()))],
            ["width", "n", "sums"],
        )

    parts = source.select("embedding").mapInArrow(run, "width int, n long, sums array<string>")
    spread = parts.select("width", "n", F.posexplode("sums").alias("dim", "part"))
    rows = spread.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # a row per dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.width, r.dim)):
        out.setdefault(r.width, (r.n, []))[1].append(int(r.total))
    return out


def _factors(source: DataFrame, width: int, n: int, sums: list[int]) -> DataFrame:
    """A triangular factor per partition that has rows: ``part`` and ``factor``, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, width))
        for batch in batches:
            _, whole = _matrix(batch.column(0), width)
            if len(whole):
                factor = np.linalg.qr(np.vstack([factor, _off(whole, n, sums).astype(float) / n]), mode="r")
        if len(factor):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([factor.ravel()], pa.list_(pa.float64()))], ["part", "factor"])

    return source.select("embedding").mapInArrow(run, "part long, factor array<double>")


def _merged(parts: DataFrame, width: int) -> np.ndarray:
    """The one factor that the rows of all partitions have."""

    def merge(frame):
        stacked = np.vstack([np.asarray(f).reshape(-1, width) for f in frame["factor"]])
        return frame.iloc[:1].assign(part=frame["part"].iloc[0] // FAN, factor=[np.linalg.qr(stacked, mode="r").ravel()])

    parts = materialize(parts, "factors")
    written, last = parts, parts.agg(F.max("part")).first()[0]
    while last:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInPandas(merge, "part long, factor array<double>")
        last //= FAN
    factor = np.asarray(parts.first().factor).reshape(-1, width)  # at most width by width
    discard(written)
    return factor


def _components(factor: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Whitening columns, shares of the variance, by component, for eigenvalues above rounding."""
    _, singular, right = np.linalg.svd(factor, full_matrices=False)
    values, trace = singular**2 / n, float((factor**2).sum() / n)
    rank = int((singular > singular[:1].sum() * max(factor.shape) * np.finfo(float).eps).sum())
    count = min(most, rank)
    axes = right[:count]
    signs = np.sign(axes[np.arange(count), np.abs(axes).argmax(axis=1)]) if count else np.ones(0)
    return (axes * signs[:, None]).T / np.sqrt(values[:count]), values[:count] / trace if trace else values[:count], trace


#: What :func:`whiten` returns beside the id.
RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """A row per vector and component: the id as ``vec_id``, and :data:`RESULT`.

    Vectors that are null, empty, or hold a null or non-finite entry (or one of
    4.5e15 or more, which no long stands for) are left out; so are those of another length than the most common one (of equally
    common ones the longest).  Directions without variance have no component:
    fewer come back where vectors are few or dimensions constant, none if all
    vectors are equal.  Repeated rows and ids count and come back each; other
    columns are left out, whatever their names; an empty table gives an empty one.

    Memory: a task holds one batch and a square of the dimension, the driver
    one sum a dimension and one factor.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=10_000)
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = source.schema["vec_id"].dataType.simpleString()
    lengths = _lengths_and_sums(source)
    if not lengths:
        return spark.createDataFrame([], f"vec_id {kind}, {RESULT}")
    width = max(lengths, key=lambda w: (lengths[w][0], w))
    n, sums = lengths[width]
    axes, explained, _ = _components(_merged(_factors(source, width, n, sums), width), n, components)
    count = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, whole = _matrix(batch.column(1), width)
            off = _off(whole, n, sums)
            most = int(np.abs(off).max(initial=0))
            exact = _exact(off, most * width)
            deviation = (exact * exact).sum(axis=1)
            flat = ((off.astype(float) / n) @ axes).ravel()
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * count, pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places)), pa.array([str(x) for x in deviation], pa.string()), rows],
                ["vec_id", "deviation", "whitened"],
            )

    made = materialize(source.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>"), "whitened")
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    covariances = made.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first() if pairs else []
    error = max((abs(c - (i == j)) for (i, j), c in zip(pairs, covariances, strict=True)), default=0.0)
    shares = F.array(*[F.lit(float(x)) for x in explained]) if count else F.array().cast("array<double>")
    return made.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        shares[F.col("place")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


def report(vectors: DataFrame) -> DataFrame:
    """:func:`whiten` with eight components, ``deviation`` as long (null where it is beyond one)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
