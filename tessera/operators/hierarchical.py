"""Hierarchical matrices: a flat table of leaves, dense or low-rank, and LU on them.

A leaf has a path of quadrants from the root, its place and size, and either its cells or factors U (ny by k) and
V (nx by k) of U Vᵀ. A tile off the diagonal is low-rank if that takes less room than its cells; nothing ever expands
a low-rank leaf whose partner in an operation is low-rank too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.interpreter import TILE, lu, solve_lower, solve_upper
from tessera.sources.matrices import dropped, stored

LEAF = "bi int, bj int, ny int, nx int, kind string, rank int, data array<double>, u array<double>, v array<double>"


class Part:
    """A leaf in memory: cells, or U and V."""

    def __init__(self, data=None, u=None, v=None):
        self.data, self.u, self.v = data, u, v

    def dense(self) -> np.ndarray:
        return self.data if self.data is not None else self.u @ self.v.T

    def row(self, bi: int, bj: int) -> dict:
        if self.data is not None:
            ny, nx = self.data.shape
            return {"bi": bi, "bj": bj, "ny": ny, "nx": nx, "kind": "dense", "rank": min(ny, nx), "data": self.data.ravel().tolist(), "u": None, "v": None}
        return {"bi": bi, "bj": bj, "ny": len(self.u), "nx": len(self.v), "kind": "lowrank", "rank": self.u.shape[1], "data": None, "u": self.u.ravel().tolist(), "v": self.v.ravel().tolist()}

    @staticmethod
    def of(row) -> Part:
        ny, nx, k = int(row["ny"]), int(row["nx"]), int(row["rank"])
        if row["kind"] == "dense":
            return Part(np.asarray(row["data"], np.float64).reshape(ny, nx))
        return Part(u=np.asarray(row["u"], np.float64).reshape(ny, k), v=np.asarray(row["v"], np.float64).reshape(nx, k))


def compressed(m: np.ndarray, eps: float) -> Part:
    """Low-rank to a relative eps if that takes less room than the cells."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    k = max(1, int((s > eps * max(s[0], 1e-300)).sum()))
    return Part(u=u[:, :k] * s[:k], v=vt[:k].T) if k * sum(m.shape) < m.size else Part(m)


def added(c: Part, u: np.ndarray, v: np.ndarray, eps: float) -> Part:
    """c + u vᵀ: factors side by side, truncated through the QR of each."""
    if c.data is not None:
        return Part(c.data + u @ v.T)
    (qu, ru), (qv, rv) = np.linalg.qr(np.hstack([c.u, u])), np.linalg.qr(np.hstack([c.v, v]))
    x, s, yt = np.linalg.svd(ru @ rv.T)
    k = max(1, int((s > eps * max(s[0], 1e-300)).sum()))
    return Part(u=qu @ (x[:, :k] * s[:k]), v=qv @ yt[:k].T)


def operate(op: str, own: Part, read: list[Part], eps: float) -> Part:
    low = own.data is None
    if op == "getrf":
        return Part(lu(own.dense()))
    if op == "trsml":
        return Part(u=solve_lower(own.u, read[0].dense()), v=own.v) if low else Part(solve_lower(own.data, read[0].dense()))
    if op == "trsmr":
        return Part(u=own.u, v=solve_upper(own.v.T, read[0].dense()).T) if low else Part(solve_upper(own.data, read[0].dense()))
    a, b = read
    if a.data is None:
        return added(own, -a.u, (b.data.T @ a.v) if b.data is not None else b.v @ (b.u.T @ a.v), eps)
    if b.data is None:
        return added(own, -(a.data @ b.u), b.v, eps)
    return Part(own.dense() - a.data @ b.data)


def leaves(tiles: DataFrame, eps: float = 1e-10) -> DataFrame:
    """LEAF rows of a tiled matrix."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.asarray(r["data"], np.float64).reshape(int(r["ny"]), int(r["nx"]))
                rows.append((Part(m) if r["bi"] == r["bj"] else compressed(m, eps)).row(r["bi"], r["bj"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAF.split(", ")])

    return tiles.mapInPandas(run, LEAF)


def leaf_table(leaf: DataFrame, size: int, depth: int) -> DataFrame:
    """leaf with its path of quadrants (0 to 3, from the root), level and first row and column."""
    quadrant = lambda k: (F.expr(f"(bi div {1 << k}) % 2 * 2 + (bj div {1 << k}) % 2")).cast("int")
    return leaf.select(F.array(*[quadrant(k) for k in range(depth - 1, -1, -1)]).alias("path"), F.lit(depth).alias("level"), (F.col("bi") * size).cast("long").alias("i0"), (F.col("bj") * size).cast("long").alias("j0"), "ny", "nx", "kind", "rank")


def expand(leaf: DataFrame) -> DataFrame:
    """The tiles of leaves."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([{"bi": r["bi"], "bj": r["bj"], "ny": r["ny"], "nx": r["nx"], "data": Part.of(r).dense().ravel().tolist()} for r in pdf.to_dict("records")], columns=["bi", "bj", "ny", "nx", "data"])

    return leaf.mapInPandas(run, TILE)


def _in_columns(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LEAF.split(", ")])


def _updated(eps: float):
    """Of a stream sorted by target, step and side: each target leaf less the products of its pairs of leaves."""

    def run(frames):
        at, acc, left = None, None, None
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                part = Part.of(r)
                if at != (r["ti"], r["tj"]):
                    if at is not None:
                        out.append(acc.row(*at))
                    at, acc = (r["ti"], r["tj"]), part
                elif r["side"] == 0:
                    left = part
                else:
                    acc = operate("gemm", acc, [left, part], eps)
            if out:
                yield _in_columns(out)
        if at is not None:
            yield _in_columns([acc.row(*at)])

    return run


def _factored(k: int, eps: float):
    """Of a step's leaves, each beside the cells of the one on the diagonal: that one's LU, and the solves of the others."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                n = int(round(len(r["corner"]) ** 0.5))
                corner = lu(np.asarray(r["corner"], np.float64).reshape(n, n))
                part = Part(corner) if r["bi"] == r["bj"] else operate("trsml" if r["bi"] == k else "trsmr", Part.of(r), [Part(corner)], eps)
                out.append(part.row(r["bi"], r["bj"]))
            yield _in_columns(out)

    return run


def hlu(leaf: DataFrame, t: int, eps: float = 1e-10) -> DataFrame:
    """LU of a t by t grid of leaves, two jobs for each leaf on the diagonal, which must be square and dense.

    A step works on one row and column of leaves; each of these meets the pairs of earlier leaves that change it in one
    sorted stream, so a task holds three leaves at a time. Only a step's own leaves are written.
    """
    leaf, done = stored(leaf, "h-leaves"), None
    cell = lambda i, j: F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"))
    for k in range(t):
        here = F.lit(k)
        own = leaf.where(((F.col("bi") == k) & (F.col("bj") >= k)) | ((F.col("bj") == k) & (F.col("bi") > k)))
        if done is not None:
            stream = own.select("*", F.col("bi").alias("ti"), F.col("bj").alias("tj"), F.lit(-1).alias("l"), F.lit(0).alias("side"))
            to_row = F.transform(F.sequence(here, F.lit(t - 1)), lambda j: cell(here, j))
            to_column = F.transform(F.sequence(here, F.lit(t - 1)), lambda i: cell(i, here))
            left = done.where(f"bi >= {k} and bj < {k}").select("*", F.inline(F.when(F.col("bi") == k, to_row).otherwise(F.array(cell(F.col("bi"), here)))), F.col("bj").alias("l"), F.lit(0).alias("side"))
            up = done.where(f"bi < {k} and bj >= {k}").select("*", F.inline(F.when(F.col("bj") == k, to_column).otherwise(F.array(cell(here, F.col("bj"))))), F.col("bi").alias("l"), F.lit(1).alias("side"))
            stream = stream.union(left).union(up).repartition("ti", "tj").sortWithinPartitions("ti", "tj", "l", "side")
            own = stream.mapInPandas(_updated(eps), LEAF)
        own = stored(own, "h-step")
        corner = own.where(f"bi = {k} and bj = {k}").select(F.col("data").alias("corner"))
        step = stored(own.crossJoin(F.broadcast(corner)).mapInPandas(_factored(k, eps), LEAF), "h-written")  # one leaf
        dropped(own)
        done = step if done is None else done.union(step)
    dropped(leaf)
    return done
