"""Matrices as DataFrames.

A coordinate matrix has a row (i long, j long, v double) for each cell; an absent cell is 0. A tiled matrix has a
row (bi, bj, ny, nx, data array<double>) for each tile, row by row. Rows are always i, columns j; ny counts rows
and nx columns.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the folder of spark.checkpoint.dir and return it as read back; lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables whose every reader has been stored, so that no lost task needs them again; others stay."""
    for t in tables:
        if hasattr(t, "_stored_at"):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cells(df: DataFrame, i: Column, j: Column, v: Column) -> DataFrame:
    """Coordinates summed by cell, as sparse sources may hold a cell more than once."""
    return df.groupBy(i.cast("long").alias("i"), j.cast("long").alias("j")).agg(F.sum(v.cast("double")).alias("v"))


def from_vectors(df: DataFrame, row: Column, vector: Column) -> DataFrame:
    """A dense matrix from a row of components for each i."""
    return df.select(row.cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def zeros(spark: SparkSession, m: int, n: int) -> DataFrame:
    """All cells of an m by n matrix, 0."""
    return spark.range(m * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"), F.lit(0.0).alias("v"))


def identity(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v"))


def to_tiles(coo: DataFrame, m: int, n: int, size: int) -> DataFrame:
    """Tiles of `size` rows and columns; those at the lower and right edge may be smaller."""
    keyed = coo.select(F.expr(f"cast(i div {size} as int)").alias("bi"), F.expr(f"cast(j div {size} as int)").alias("bj"), (F.col("i") % size).alias("r"), (F.col("j") % size).alias("c"), "v")
    grid = coo.sparkSession.range(-(-m // size) * -(-n // size)).select(F.expr(f"cast(id div {-(-n // size)} as int)").alias("bi"), F.expr(f"cast(id % {-(-n // size)} as int)").alias("bj"))
    grid = grid.withColumn("ny", F.least(F.lit(size), F.lit(m) - F.col("bi") * size)).withColumn("nx", F.least(F.lit(size), F.lit(n) - F.col("bj") * size))
    held = keyed.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * size + F.col("c")).alias("k"), "v"))).alias("cells"))
    data = F.transform(F.sequence(F.lit(0), F.col("ny") * F.col("nx") - 1), lambda p: F.coalesce(F.element_at("cells", (F.floor(p / F.col("nx")) * size + p % F.col("nx")).cast("long")), F.lit(0.0)))
    return grid.join(held, ["bi", "bj"], "left").withColumn("cells", F.coalesce("cells", F.expr("cast(map() as map<bigint,double>)"))).select("bi", "bj", "ny", "nx", data.alias("data"))


def from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    x = tiles.select("bi", "bj", "nx", F.posexplode("data").alias("p", "v"))
    return x.select(F.expr(f"cast(bi * {size} + p div nx as bigint)").alias("i"), F.expr(f"cast(bj * {size} + p % nx as bigint)").alias("j"), "v")


def to_block(coo: DataFrame, m: int, n: int, name: str = "m") -> DataFrame:
    """One row with the whole matrix as array<array<double>>; for matrices that fit one."""
    rows = coo.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("r"))
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("rows"))
    cell = lambda i, j: F.coalesce(F.element_at(F.element_at("rows", i.cast("long")), j.cast("long")), F.lit(0.0))
    return one.select(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(i, j))).alias(name))


def to_keyed_blocks(cells_: DataFrame, key: str, m: int, n: int, name: str = "m") -> DataFrame:
    """A row (key, m by n block as array<array<double>>) for each key of cells (key, i, j, v); absent cells are 0."""
    held = cells_.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * n + F.col("j")).cast("long").alias("p"), "v"))).alias("cells"))
    cell = lambda i, j: F.coalesce(F.element_at("cells", (i * n + j).cast("long")), F.lit(0.0))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(i, j))).alias(name))


def from_keyed_blocks(df: DataFrame, key: str, block: Column) -> DataFrame:
    """(key, i, j, v) of every row's block."""
    x = df.select(key, F.posexplode(block).alias("i", "row")).select(key, "i", F.posexplode("row").alias("j", "v"))
    return x.select(key, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


def from_block(df: DataFrame, block: Column) -> DataFrame:
    x = df.select(F.posexplode(block).alias("i", "row")).select("i", F.posexplode("row").alias("j", "v"))
    return x.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


def print_rows(coo: DataFrame) -> DataFrame:
    """(i, line): the rows of a matrix as text, cells in %e form, rounded as the binary number is.

    The JVM's %e rounds the shortest decimal form, so that 9812.4975 would go up although the number lies below it.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def line(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: " ".join(f"{v:e}" for v in row))

    held = coo.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))
    return held.select("i", line("row").alias("line")).orderBy("i")
