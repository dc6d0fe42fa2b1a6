"""Timers, worker clocks and FLOP reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = 10_000  # of a span of time, on average

def timer_elapsed(events: DataFrame, name: str, ts: str, tie: str) -> DataFrame:
    """(name, n, elapsed_us): from a name's first event to each later one.

    Time is cut in spans, so many that one holds some ten thousand events on average. Events are numbered within the
    spans of a name; what comes before a span is a running sum of counts, so no task sorts all events of a name.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = events.select(F.col(name), us.alias("us"), tie)
    n, lo, hi = x.agg(F.count("*"), F.min("us"), F.max("us")).first()
    spans = max(1, n // EVENTS)
    span = F.floor((F.col("us") - F.lit(lo or 0)) / max(1, -(-((hi or 0) - (lo or 0) + 1) // spans)))
    x = x.withColumn("span", F.coalesce(span, F.lit(-1)).cast("long"))
    counts = x.groupBy(name, "span").agg(F.count("*").alias("events"), F.min("us").alias("us"))
    before = Window.partitionBy(name).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(name, "span", F.coalesce(F.sum("events").over(before), F.lit(0)).alias("before"), F.min("us").over(Window.partitionBy(name)).alias("first_us"))
    inside = Window.partitionBy(name, "span").orderBy("us", tie)
    x = x.withColumn("place", F.row_number().over(inside) - 1).join(counts, [name, "span"]).withColumn("n", F.col("before") + F.col("place"))
    return x.where("n > 0").select(F.col(name).alias("name"), F.col("n").cast("long").alias("n"), (F.col("us") - F.col("first_us")).alias("elapsed_us"))


def clock_cells(clocks: DataFrame, worker: str, tick: Column, kind: Column, block: int) -> DataFrame:
    """(worker, cell, kind, n): ticks of each worker in cells `block` wide from its first tick."""
    x = clocks.select(F.col(worker).alias("worker"), tick.cast("long").alias("tick"), kind.alias("kind"))
    first = x.groupBy("worker").agg(F.min("tick").alias("t0"))
    cell = F.floor((F.col("tick") - F.col("t0")) / block).cast("long")
    return x.join(first, "worker").groupBy("worker", cell.alias("cell"), "kind").agg(F.count("*").cast("long").alias("n"))


def clock_strip(cells: DataFrame, row_blocks: int) -> DataFrame:
    """(worker, row, strip): the kind that fills most of each cell, as initials, wrapped at row_blocks cells."""
    most = cells.groupBy("worker", "cell").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    strip = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "kind"))), lambda c: F.substring(c["kind"], 1, 1)), "")
    return most.groupBy("worker", F.floor(F.col("cell") / row_blocks).cast("long").alias("row")).agg(strip.alias("strip"))


def total_ticks(clocks: DataFrame, worker: str, tick: Column) -> DataFrame:
    return clocks.groupBy(F.col(worker).alias("worker")).agg((F.max(tick) - F.min(tick)).cast("long").alias("ticks"))


def dense_lu_flops(n: Column) -> Column:
    return 2.0 * n * n * n / 3.0


def scaled_unit(x: Column) -> tuple[Column, Column]:
    """A number below 1000 and its unit: "", K, M, G or T."""
    step = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(x, F.lit(1.0))) / 3).cast("int")))
    return x / F.pow(F.lit(1000.0), step), F.element_at(F.array(*[F.lit(u) for u in ("", "K", "M", "G", "T")]), step + 1)


def flop_report(df: DataFrame, flops: str, dense: str, ms: str) -> DataFrame:
    """df with ratio_percent (of dense), rate (FLOP/s) and the dense rate that it amounts to."""
    ratio = 100.0 * F.col(flops) / F.col(dense)
    rate = 1e3 * F.col(flops) / F.col(ms)
    return df.withColumns({"ratio_percent": ratio, "rate": rate, "dense_rate": rate * 100.0 / ratio})
