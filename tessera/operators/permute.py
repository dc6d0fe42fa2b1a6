"""Permutations and reductions of coordinate matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def swap_rows(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("i", F.when(F.col("i") == a, b).when(F.col("i") == b, a).otherwise(F.col("i")).cast("long"))


def swap_columns(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("j", F.when(F.col("j") == a, b).when(F.col("j") == b, a).otherwise(F.col("j")).cast("long"))


def reset_pivot(spark: SparkSession, n: int) -> DataFrame:
    """(row, target) of the identity."""
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("target"))


def apply_pivot(m: DataFrame, pivot: DataFrame, recover: bool = False) -> DataFrame:
    """Row r of the result is row target(r) of M; recover undoes that."""
    here, there = ("row", "target") if recover else ("target", "row")
    moves = pivot.select(F.col(here).cast("long").alias("i"), F.col(there).cast("long").alias("moved"))
    return m.join(moves, "i").select(F.col("moved").alias("i"), "j", "v")


def argmax_abs(m: DataFrame, by: str, within: str | None = None) -> DataFrame:
    """Index of the largest absolute value, the least of equals; index 0 where all are 0."""
    best = F.max(F.struct(F.abs("v").alias("a"), (-F.col(by)).alias("n")))
    groups = m.groupBy(within) if within else m.groupBy()
    out = groups.agg(best.alias("best"))
    index = F.when(F.col("best.a") > 0, -F.col("best.n")).otherwise(0).cast("long").alias("index")
    return out.select(*[within] * bool(within), index)


def sum_to_all(df: DataFrame, column: str, out: str = "total") -> DataFrame:
    """The sum of a column beside every row: an aggregate that is joined back, not a window of one partition."""
    total = df.agg(F.sum(column).cast("long").alias(out))
    return df.join(F.broadcast(total))  # a single row


def read_rank(m: DataFrame, eps: float) -> DataFrame:
    """Number of columns whose squared norm reaches eps."""
    norms = m.groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("n2"))
    return norms.where(F.col("n2") >= eps).agg(F.count("*").alias("rank"))


