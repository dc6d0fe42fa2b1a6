"""Clock cells of an event stream: fixed-width counts for each worker, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clock_cells(events: DataFrame, worker: str, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(worker, cell_start, n): append-only once the watermark has passed a cell; also right on a static table."""
    stamped = events.select(F.col(worker).alias("worker"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    return stamped.groupBy("worker", F.window("at", width)).agg(F.count("*").alias("n")).select("worker", F.col("window.start").alias("cell_start"), "n")
