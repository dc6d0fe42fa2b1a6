"""Matrices drawn from the given tables, as DataFrames and as DuckDB SQL of the same cells.

month x priority and the like are sparse sources: every row of the table counts towards a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.matrices import cells, from_vectors, identity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_by_line(spark, d) -> DataFrame:
    """P, 25 by 7: quantity by the supplier's nation and the line number, in units of 997, so that no sum lies between two decimals."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return cells(l.join(s, l["l_suppkey"] == s["s_suppkey"]), F.col("s_nationkey"), F.col("l_linenumber") - 1, F.col("l_quantity") / 997)


def line_by_month(spark, d) -> DataFrame:
    """R, 7 by 12: quantity by line number and month of shipping, in units of 997, so that no sum lies between two decimals."""
    return cells(table(spark, d, "lineitem"), F.col("l_linenumber") - 1, F.month("l_shipdate") - 1, F.col("l_quantity") / 997)


def month_by_priority(spark, d) -> DataFrame:
    """T, 12 by 5: 997s of orders by month and priority."""
    return cells(table(spark, d, "orders"), F.month("o_orderdate") - 1, F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(1 / 997))


def priority_by_nation(spark, d) -> DataFrame:
    """U, 5 by 25: 997s of orders by priority and the customer's nation."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return cells(o.join(c, o["o_custkey"] == c["c_custkey"]), F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.col("c_nationkey"), F.lit(1 / 997))


def line_by_flag(spark, d) -> DataFrame:
    """D, 7 by 3: 997s of lines by number and return flag."""
    flag = F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1
    return cells(table(spark, d, "lineitem"), F.col("l_linenumber") - 1, flag, F.lit(1 / 997))


def month_by_flag(spark, d) -> DataFrame:
    """V2, 12 by 3: 997s of lines by month and return flag."""
    flag = F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1
    return cells(table(spark, d, "lineitem"), F.month("l_shipdate") - 1, flag, F.lit(1 / 997))


def embeddings(spark, d) -> DataFrame:
    """A: a row of components for each vector."""
    return from_vectors(table(spark, d, "embeddings"), F.col("vec_id"), F.col("embedding"))


def boosted(m: DataFrame, n: int, by: float) -> DataFrame:
    """M + by * I, so that LU needs no pivoting."""
    return m.unionByName(identity(m.sparkSession, n, by)).groupBy("i", "j").agg(F.sum("v").alias("v"))


SHAPES = {"p": (25, 7), "r": (7, 12), "t": (12, 5), "u": (5, 25), "d": (7, 3), "w": (12, 3)}
FRAMES = {"p": nation_by_line, "r": line_by_month, "t": month_by_priority, "u": priority_by_nation, "d": line_by_flag, "w": month_by_flag, "a": embeddings}
SQL = {
    "p": "SELECT CAST(s_nationkey AS BIGINT) AS i, CAST(l_linenumber - 1 AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "r": "SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(month(l_shipdate) - 1 AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem GROUP BY 1, 2",
    "t": "SELECT CAST(month(o_orderdate) - 1 AS BIGINT) AS i, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS j, count(*) * (CAST(1 AS DOUBLE) / 997) AS v FROM orders GROUP BY 1, 2",
    "u": "SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS i, CAST(c_nationkey AS BIGINT) AS j, count(*) * (CAST(1 AS DOUBLE) / 997) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "d": "SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(instr('ANR', l_returnflag) - 1 AS BIGINT) AS j, count(*) * (CAST(1 AS DOUBLE) / 997) AS v FROM lineitem GROUP BY 1, 2",
    "w": "SELECT CAST(month(l_shipdate) - 1 AS BIGINT) AS i, CAST(instr('ANR', l_returnflag) - 1 AS BIGINT) AS j, count(*) * (CAST(1 AS DOUBLE) / 997) AS v FROM lineitem GROUP BY 1, 2",
    "a": "SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(k)",
}


def dense_sql(m: str, ny: int, nx: int) -> str:
    return f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM ({m}) UNION ALL SELECT a.k AS i, b.k AS j, CAST(0 AS DOUBLE) AS v FROM range(0, {ny}) a(k), range(0, {nx}) b(k)) GROUP BY i, j"


def boosted_sql(m: str, n: int, by: float, shape: tuple[int, int] | None = None) -> str:
    ny, nx = shape or (n, n)
    return dense_sql(f"SELECT i, j, v FROM ({m}) UNION ALL SELECT k AS i, k AS j, CAST({by} AS DOUBLE) AS v FROM range(0, {n}) q(k)", ny, nx)
