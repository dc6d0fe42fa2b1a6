"""The operations on tiles, and a task graph run on a tiled matrix: a job for each level of the graph.

A level's tasks do not depend on each other. Each joins the tiles it reads and writes one tile. What a level writes
is a written table, so a lost executor repeats one level at most; the whole matrix is written every eighth level, so
that plans stay short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lowrank import recompress
from tessera.sources.matrices import stored

TILE = "bi int, bj int, ny int, nx int, data array<double>"


class ZeroPivot(ArithmeticError):
    """LU without pivoting met a pivot of 0."""


def _pivot(m: np.ndarray, k: int) -> float:
    if m[k, k] == 0:
        raise ZeroPivot(f"pivot {k} is 0")
    return m[k, k]


def lu(m: np.ndarray) -> np.ndarray:
    m = m.copy()
    for k in range(min(m.shape[0] - 1, m.shape[1])):
        m[k + 1 :, k] /= _pivot(m, k)
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return m


def solve_lower(b: np.ndarray, l: np.ndarray) -> np.ndarray:
    b = b.copy()
    for k in range(len(b)):
        b[k + 1 :] -= np.outer(l[k + 1 : len(b), k], b[k])
    return b


def solve_upper(b: np.ndarray, u: np.ndarray) -> np.ndarray:
    b = b.copy()
    for k in range(b.shape[1]):
        b[:, k] /= _pivot(u, k)
        b[:, k + 1 :] -= np.outer(b[:, k], u[k, k + 1 : b.shape[1]])
    return b


#: How the products of three and four factors are grouped, by control.
GROUPS = {3: {0: (0, (1, 2)), 1: ((0, 1), 2)}, 4: {0: (((0, 1), 2), 3), 1: ((0, (1, 2)), 3), 2: (0, ((1, 2), 3)), 3: (0, (1, (2, 3))), 4: ((0, 1), (2, 3))}}


def product(read, flags=(), control: int | None = None) -> np.ndarray:
    """The product of the factors, transposed where flagged, grouped as control says (None: as costs least)."""
    m = [x.T if t else x for x, t in zip(read, [*flags, *[False] * len(read)], strict=False)]
    if len(m) < 3 or control is None:
        return np.linalg.multi_dot(m) if len(m) > 1 else m[0]
    control = int(control != 0) if len(m) == 3 else control
    if control not in GROUPS[len(m)]:
        raise ValueError(f"unknown control {control}")
    group = lambda g: m[g] if isinstance(g, int) else group(g[0]) @ group(g[1])
    return group(GROUPS[len(m)][control])


def execute(op: str, own: np.ndarray | None = None, *read: np.ndarray, flags=(), control: int | None = None):
    """What an operation writes: a matrix, or U and V of accum. read: its other operands in order."""
    if op == "nop":
        return own if own is not None else ()
    if op == "getrf":
        return lu(own)
    if op == "trsml":
        if any(flags):
            raise ValueError("trsml takes no transposed B")
        return solve_lower(own, read[0])
    if op == "trsmr":
        return solve_upper(own.T, read[0]).T if any(flags) else solve_upper(own, read[0])
    if op in ("gemm", "gemm_3x", "gemm_4x"):
        return own - product(read, flags, control)
    if op == "gemm_plus":
        return own + product(read, flags, control)
    if op == "accum":
        return recompress(own, *read)
    raise ValueError(f"unknown operation {op}")


def replaced(tiles: DataFrame, new: DataFrame, level: int) -> DataFrame:
    """tiles with those of new in their places. Untouched tiles are written again only every eighth level."""
    tiles = tiles.join(new.select("bi", "bj"), ["bi", "bj"], "left_anti").select(*new.columns).union(new)
    return stored(tiles, "tiles") if level % 8 == 7 else tiles


def run_levels(tiles: DataFrame, tasks: DataFrame, levels: DataFrame) -> DataFrame:
    """tiles after all tasks. tasks: (inst, op, i, j, reads array<struct<i,j>>, perhaps flags array<boolean>); levels: (inst, level)."""
    if "flags" not in tasks.columns:
        tasks = tasks.withColumn("flags", F.expr("cast(array() as array<boolean>)"))
    planned = stored(tasks.join(levels, "inst"), "planned")
    last = planned.agg(F.max("level")).first()[0]
    tiles = stored(tiles, "tiles")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values("role").to_dict("records")
        m = [np.asarray(p["data"], np.float64).reshape(int(p["ny"]), int(p["nx"])) for p in parts]
        out = execute(parts[0]["op"], *m, flags=list(parts[0]["flags"]))
        return pd.DataFrame({"bi": [parts[0]["i"]], "bj": [parts[0]["j"]], "ny": [out.shape[0]], "nx": [out.shape[1]], "data": [out.ravel().tolist()]})

    for level in range(0 if last is None else last + 1):
        now = planned.where(F.col("level") == level)
        roles = F.concat(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j"))), F.col("reads"))
        wanted = now.select("inst", "op", "flags", "i", "j", F.posexplode(roles).alias("role", "t"))
        fetched = wanted.join(tiles, (F.col("t.i") == F.col("bi")) & (F.col("t.j") == F.col("bj"))).select("inst", "op", "flags", "role", "i", "j", "ny", "nx", "data")
        new = stored(fetched.groupBy("inst").applyInPandas(work, TILE), "written")
        tiles = replaced(tiles, new, level)
    return tiles


def lu_reads(tasks: DataFrame) -> DataFrame:
    """Tasks of tiled LU with the tiles that each reads beside its own."""
    t = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    reads = F.when(F.col("op") == "getrf", F.expr("cast(array() as array<struct<i:int,j:int>>)")).when(F.col("op").isin("trsml", "trsmr"), F.array(t("k", "k"))).otherwise(F.array(t("i", "k"), t("k", "j")))
    return tasks.select("inst", "op", "i", "j", reads.alias("reads"))
