"""One-sided Jacobi SVD across tasks: column blocks meet in a round-robin tournament.

A matrix is cut into column blocks, a row each. In a round every block meets one other, and one task makes the columns of
both orthogonal to each other; after as many rounds as there are other blocks all pairs of columns have met, which is
a sweep. A round is one shuffle of the blocks by pair. Sweeps end when no two columns of any pair met at a cosine over
the bound, whatever their size. Many matrices, told apart by a key, take part side by side.

The rows of a block are those of the matrix, so tall matrices are first reduced to R (`tall.tall_qr`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lowrank import COSINE, NOTHING, jacobi_sweep
from tessera.sources.matrices import dropped, stored

_BLOCK = "block int, width int, us binary, v binary, norm double, met double"


def column_blocks(cells: DataFrame, key: str, m: int, n: int, width: int) -> DataFrame:
    """(key, block, width, us, v, norm, met): blocks of columns, with their rows of the identity and the matrix's norm."""
    kind = dict(cells.dtypes)[key]
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    held = cells.groupBy(key, F.expr(f"cast(j div {width} as int)").alias("block")).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("x"))

    def dense(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                first = row["block"] * width
                w = min(width, n - first)
                us, v = np.zeros((m, w)), np.zeros((n, w))
                us[np.asarray(row["i"], int), np.asarray(row["j"], int) - first] = row["x"]
                v[first + np.arange(w), np.arange(w)] = 1
                out.append((row[key], row["block"], w, us.tobytes(), v.tobytes(), row["norm"], 0.0))
            yield pd.DataFrame(out, columns=[key, "block", "width", "us", "v", "norm", "met"])

    return held.join(norms, key).mapInPandas(dense, f"`{key}` {kind}, {_BLOCK}")


def partners(blocks: int, turn: int) -> list[int]:
    """For each of an even number of blocks, the lesser of it and the one that it meets in a round of the circle."""
    odd, out = blocks - 1, [0] * blocks
    for x in range(odd):
        y = (turn - x) % odd
        out[x] = min(x, y if y != x else odd)
        if y == x:
            out[odd] = x
    return out


def _meet(key: str, m: int, n: int, tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        us, v = (np.hstack([np.frombuffer(x, np.float64).reshape(rows, -1) for x in pdf[c]]) for c, rows in (("us", m), ("v", n)))
        floor, met = NOTHING * pdf["norm"].iloc[0], pdf["met"].max()
        for _ in range(30):
            now = jacobi_sweep(us, v, tol, floor)
            met = max(met, now)
            if now <= tol:
                break
        cuts = np.cumsum(pdf["width"])[:-1]
        out = pdf[[key, "block", "width", "norm"]].copy()
        out["us"], out["v"], out["met"] = [x.tobytes() for x in np.split(us, cuts, axis=1)], [x.tobytes() for x in np.split(v, cuts, axis=1)], met
        return out[[key, "block", "width", "us", "v", "norm", "met"]]

    return run


def orthogonal_columns(cells: DataFrame, key: str, m: int, n: int, width: int = 64, tol: float = COSINE, most_sweeps: int = 40) -> DataFrame:
    """Blocks (key, block, width, us, v, ...) of m by n matrices: A = US Vᵀ, the columns of US orthogonal. Raises if sweeps don't suffice."""
    kind, blocks = dict(cells.dtypes)[key], max(2, -(-n // width) + -(-n // width) % 2)
    now = stored(column_blocks(cells, key, m, n, width), "jacobi")
    meet = _meet(key, m, n, tol)
    for _ in range(most_sweeps):
        before, now = now, now.withColumn("met", F.lit(0.0))
        for turn in range(blocks - 1):
            pair = F.element_at(F.array(*map(F.lit, partners(blocks, turn))), F.col("block") + 1)
            now = now.withColumn("pair", pair).groupBy(key, "pair").applyInPandas(meet, f"`{key}` {kind}, {_BLOCK}")
        now = stored(now, "jacobi")
        dropped(before)
        if (now.agg(F.max("met")).first()[0] or 0.0) <= tol:
            return now
    raise ArithmeticError(f"cosines of columns are over {tol} after {most_sweeps} sweeps")


def singular_values(cells: DataFrame, key: str, m: int, n: int, width: int = 64) -> DataFrame:
    """(key, i = 0, j, v): the min(m, n) singular values of each matrix, largest first."""
    kind = dict(cells.dtypes)[key]

    def norms(frames):
        for pdf in frames:
            us = [np.linalg.norm(np.frombuffer(x, np.float64).reshape(m, -1), axis=0) for x in pdf["us"]]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), list(map(len, us))), "v": np.concatenate([*us, np.zeros(0)])})

    out = orthogonal_columns(cells, key, m, n, width).mapInPandas(norms, f"`{key}` {kind}, v double")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("v"))) - 1
    return out.select(key, F.lit(0).cast("long").alias("i"), place.cast("long").alias("j"), "v").where(F.col("j") < min(m, n))
