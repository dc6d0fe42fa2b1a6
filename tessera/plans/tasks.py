"""Task graphs of tiled LU: tasks in program order, their operands as regions, edges, levels, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import deps
from tessera.sources.matrices import stored

LEVELS = 4  # of a graph, found in one job
#: Weight of each operation in units of tile**3 / 3. Fixed values.
WEIGHTS = {"getrf": 2, "trsml": 3, "trsmr": 3, "gemm": 6}


def lu_tasks(spark: SparkSession, t: int) -> DataFrame:
    """(inst, op, k, i, j, flops) of LU on a t by t grid of tiles, numbered in program order.

    For each k: getrf(k, k); trsml(k, j) and then trsmr(i, k), ascending; gemm(i, j) row by row. The number follows
    from a closed form of the tasks before step k, so no global sort is needed.
    """
    steps = spark.range(t).select(F.col("id").cast("int").alias("k")).withColumn("n", F.lit(t - 1) - F.col("k"))
    left = F.lit(t) - F.col("k")  # sizes t .. left + 1 are done, s * s tasks each
    before = (F.expr(f"{t} * ({t} + 1) * (2 * {t} + 1) div 6") - left * (left + 1) * (2 * left + 1) / 6).cast("long")
    steps = steps.withColumn("before", before)
    cells = steps.withColumn("i", F.explode(F.expr(f"sequence(k, {t} - 1)"))).withColumn("j", F.explode(F.expr(f"sequence(k, {t} - 1)")))
    on_row, on_col = F.col("i") == F.col("k"), F.col("j") == F.col("k")
    op = F.when(on_row & on_col, "getrf").when(on_row, "trsml").when(on_col, "trsmr").otherwise("gemm")
    r, c, n = F.col("i") - F.col("k"), F.col("j") - F.col("k"), F.col("n")
    place = F.when(on_row & on_col, 0).when(on_row, c).when(on_col, n + r).otherwise(2 * n + 1 + (r - 1) * n + (c - 1))
    flops = F.element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("op")).cast("long")
    return cells.withColumn("op", op).select((F.col("before") + place).cast("long").alias("inst"), "op", "k", "i", "j").withColumn("flops", flops)


def operands(tasks: DataFrame, t: int, tile: int = 4) -> DataFrame:
    """(inst, is_read, i, j, ptr, pitch, width, height): the tile that a task updates is written, others are read."""
    tile_of = lambda i, j, read: F.struct(F.lit(read).alias("is_read"), i.alias("i"), j.alias("j"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    own = tile_of(i, j, False)
    reads = (
        F.when(F.col("op") == "getrf", F.array(own))
        .when(F.col("op") == "trsml", F.array(own, tile_of(k, k, True)))
        .when(F.col("op") == "trsmr", F.array(own, tile_of(k, k, True)))
        .otherwise(F.array(own, tile_of(i, k, True), tile_of(k, j, True)))
    )
    x = tasks.select("inst", F.explode(reads).alias("o")).select("inst", "o.*")
    n = t * tile
    region = {"ptr": (F.col("i") * tile * n + F.col("j") * tile).cast("long"), "pitch": F.lit(n).cast("long"), "width": F.lit(tile).cast("long"), "height": F.lit(tile).cast("long")}
    return x.select("inst", "is_read", "i", "j", *[v.alias(c) for c, v in region.items()])


def dag_edges(spark: SparkSession, t: int, tile: int = 4) -> DataFrame:
    return deps.classify(operands(lu_tasks(spark, t), t, tile))


def density(edges: DataFrame, n: int) -> DataFrame:
    """Edges over the pairs that program order allows."""
    return edges.agg((F.count("*") / (n * (n - 1) / 2)).alias("density"))


def levels(edges: DataFrame, insts: DataFrame) -> DataFrame:
    """(inst, level): the longest chain of dependencies before each instruction.

    Each level keeps the instructions that have a predecessor in the one before; a job takes LEVELS of them.
    """
    edges = stored(edges.select("inst_from", "inst_to"), "edges")
    frontier, level, found = insts.select("inst"), 0, None
    while True:
        steps = [frontier.select("inst", F.lit(level).alias("level"))]
        for n in range(1, LEVELS):
            after = edges.join(steps[-1].select(F.col("inst").alias("inst_from")), "inst_from", "left_semi").select(F.col("inst_to").alias("inst")).distinct()
            steps.append(after.withColumn("level", F.lit(level + n)))
        here = stored(reduce(DataFrame.union, steps), "level")
        found, level = here if found is None else found.union(here), level + LEVELS
        last = here.where(F.col("level") == level - 1)
        if last.isEmpty():
            break
        frontier = edges.join(last.select(F.col("inst").alias("inst_from")), "inst_from", "left_semi").select(F.col("inst_to").alias("inst")).distinct()
    return found.groupBy("inst").agg(F.max("level").cast("long").alias("level")) if found is not None else insts.select("inst", F.lit(0).cast("long").alias("level"))


def batch_slices(insts: DataFrame, kernel_size: int) -> DataFrame:
    """(inst, slice, start): windows of kernel_size instructions; one window if that is not positive."""
    s = F.floor(F.col("inst") / kernel_size).cast("long") if kernel_size > 0 else F.lit(0).cast("long")
    return insts.select("inst", s.alias("slice")).withColumn("start", F.col("slice") * max(kernel_size, 0))
