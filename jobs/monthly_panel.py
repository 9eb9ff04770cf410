"""Keeps a monthly spending panel up to date from a growing table of orders.

A file stream takes each file of orders once.  Its sums by month, entity and
category are added to those of earlier files, and only the months that the new
files touch are written again: value, number of orders, share of the entity's
month, root-share coordinate, and whether the entity has every category then.
Each batch's sums make a folder of their own for each of its months, all of
which are listed when a month is summed again.

    python -m jobs.monthly_panel --config jobs/monthly_panel.json

Output: Parquet in ``output``, partitioned by ``period`` (the month's first
day).  ``checkpoint`` keeps the stream's own checkpoint and the sums of each
micro-batch; delete both folders together, or neither.  A batch that is
replayed after a failure overwrites its own sums and the same months, so that a
rerun, whole or broken off, ends with the same rows.

Rows that lack an entity, category, time or value are counted and left out.
Values are rounded to hundredths.  A file that changes after it was taken is
not taken again.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import settings, start
from panelloom.operators import panel

LOG = logging.getLogger("jobs.monthly_panel")

PATHS = {
    "input": "Parquet file or folder of orders",
    "output": "folder of the panel",
    "checkpoint": "folder of the stream's checkpoint and sums",
    "files_per_batch": "files that one micro-batch takes at most",
    "categories": "categories that a complete entity has in a month",
}
#: The column of the orders that each column of the panel comes from.
COLUMNS = {"entity": "o_custkey", "category": "o_orderpriority", "at": "o_orderdate", "value": "o_totalprice"}


def _month(at: Column) -> Column:
    return F.date_format(F.trunc(at, "month"), "yyyy-MM-dd")


def _as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def batch_sums(orders: DataFrame) -> DataFrame:
    """``entity, category, period, cents, n_orders`` of the orders that are whole."""
    rows = orders.select(*[F.col(c).alias(n) for n, c in COLUMNS.items()]).dropna()
    cents = F.round(F.col("value").cast("double") * 100).cast("long")
    return rows.groupBy("entity", "category", _month(F.col("at")).alias("period")).agg(F.sum(cents).alias("cents"), F.count("*").alias("n_orders"))


def panel_rows(sums: DataFrame, categories: int) -> DataFrame:
    """The panel's rows from the sums of any number of batches; cells of no or negative value are left out.

    Cents are whole numbers, so that sums do not depend on the order of rows.
    """
    cells = sums.groupBy("entity", "category", "period").agg(F.sum("cents").alias("cents"), F.sum("n_orders").alias("n_orders")).where("cents > 0")
    coordinates = panel.hellinger(cells.select("entity", "period", "category", F.col("cents").cast("double").alias("value"))).where("category <> 'residual'")
    whole = cells.groupBy("entity", "period").agg((F.count("*") == categories).alias("complete"), F.sum("cents").alias("total"))
    return (
        cells.join(coordinates.select("entity", "period", "category", "coordinate"), ["entity", "period", "category"])
        .join(whole, ["entity", "period"])
        .select(
            "entity",
            "category",
            (F.col("cents") / 100).alias("value"),
            "n_orders",
            F.round(F.col("cents") / F.col("total"), 9).alias("share"),
            F.round("coordinate", 9).alias("coordinate"),
            "complete",
            "period",
        )
    )


def run(spark: SparkSession, input: str, output: str, checkpoint: str, files_per_batch: int | str = 1000, categories: int | str = 5) -> dict:
    """Take what is new in ``input``; returns how many rows and batches were read and months written.

    Touched months are found by a semi-join on the batch's own months, which is
    broadcast as it has a row a month; older sums are read by partition.
    """
    place = f"{checkpoint.rstrip('/')}/sums"
    done = {"rows_read": 0, "batches": 0, "months_written": 0}

    def take(orders: DataFrame, batch: int) -> None:
        inner = orders.sparkSession
        sums = batch_sums(orders).withColumn("batch", F.lit(batch))
        sums.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "period").parquet(place)
        every = inner.read.schema(f"{sums.schema['entity'].simpleString().replace(':', ' ')}, category string, cents long, n_orders long, batch long, period string").parquet(place)
        new = every.where(F.col("batch") == batch).select("period").distinct()
        months = new.count()
        if months:
            rows = panel_rows(every.join(F.broadcast(new), "period", "left_semi"), int(categories))
            rows.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(output)
        done["months_written"] += months
        LOG.info("batch %d of %s: %d months written to %s", batch, input, months, output)

    schema = spark.read.parquet(input).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(_as_pattern(input))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    done["batches"], done["rows_read"] = len(taken), sum(p["sources"][0]["numInputRows"] for p in taken)
    LOG.info("read %(rows_read)d new rows in %(batches)d batches, wrote %(months_written)d months", done)
    return done


def main(argv: list[str] | None = None) -> dict:
    return start("monthly-panel", run, settings(__doc__.splitlines()[0], PATHS, argv))


if __name__ == "__main__":
    main(sys.argv[1:])
