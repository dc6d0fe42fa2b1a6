"""LU and triangular solves of tiled matrices, a step for each block on the diagonal.

A step works on one block row and column of what is not factored yet. A tile of it takes its own cells and the products
of what earlier steps have written, as one sorted stream of pairs that is summed as it is read, so a task holds three
tiles at a time however many blocks there are. Then the diagonal tile is factored and the others are solved with it.
Only a step's own tiles are written, none twice, and all tiles of a step are spread over tasks. What a task broadcasts
is a single tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.interpreter import TILE, lu, solve_lower, solve_upper
from tessera.sources.matrices import dropped, stored


def _tile(data, ny, nx) -> np.ndarray:
    return np.asarray(data, np.float64).reshape(int(ny), int(nx))


def _rows(out: list) -> pd.DataFrame:
    return pd.DataFrame([(i, j, x.shape[0], x.shape[1], x.ravel().tolist()) for i, j, x in out], columns=["bi", "bj", "ny", "nx", "data"])


def _remainders(own: DataFrame, pairs: DataFrame, flip: bool = False) -> DataFrame:
    """own tiles less the products of their pairs (bi, bj, l, any, anx, a, bny, bnx, b); flip: a is transposed."""
    none = lambda kind: F.lit(None).cast(kind)
    first = own.select("bi", "bj", F.lit(-1).alias("l"), F.col("ny").alias("any"), F.col("nx").alias("anx"), F.col("data").alias("a"), none("int").alias("bny"), none("int").alias("bnx"), none("array<double>").alias("b"))
    stream = first.union(pairs.select(*first.columns)).repartition("bi", "bj").sortWithinPartitions("bi", "bj", "l")

    def run(frames):
        at, acc = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if at != (r.bi, r.bj):
                    if at is not None:
                        out.append((*at, acc))
                    at, acc = (r.bi, r.bj), _tile(r.a, r.any, r.anx).copy()
                else:
                    a = _tile(r.a, r.any, r.anx)
                    acc -= (a.T if flip else a) @ _tile(r.b, r.bny, r.bnx)
            if out:
                yield _rows(out)
        if at is not None:
            yield _rows([(*at, acc)])

    return stream.mapInPandas(run, TILE)


def _side(tiles: DataFrame, of: str, l: str, keep: str) -> DataFrame:
    """Tiles as one factor of pairs: the contracted block index as l, the other one by its own name."""
    return tiles.select(F.col(l).alias("l"), F.col(keep), F.col("ny").alias(f"{of}ny"), F.col("nx").alias(f"{of}nx"), F.col("data").alias(of))


def _with_one(tiles: DataFrame, one: DataFrame, solve) -> DataFrame:
    """solve(tile, diagonal tile, bi, bj) of every tile."""
    d = one.select(F.col("ny").alias("dny"), F.col("nx").alias("dnx"), F.col("data").alias("d"))

    def run(frames):
        for pdf in frames:
            yield _rows([(r.bi, r.bj, solve(_tile(r.data, r.ny, r.nx), _tile(r.d, r.dny, r.dnx), r.bi, r.bj)) for r in pdf.itertuples(index=False)])

    return tiles.crossJoin(F.broadcast(d)).mapInPandas(run, TILE)  # a single tile


def tiled_lu(tiles: DataFrame, rows: int, cols: int | None = None) -> DataFrame:
    """LU without pivoting of a grid of tiles: L below the diagonal, its unit diagonal implied, U on and above it."""
    cols = rows if cols is None else cols
    tiles, done = stored(tiles.select("bi", "bj", "ny", "nx", "data"), "tiles"), None
    for k in range(min(rows, cols)):
        own = tiles.where((F.col("bi") == k) & (F.col("bj") >= k) | (F.col("bj") == k) & (F.col("bi") > k))
        if done is not None:
            left, up = done.where(f"bi >= {k} and bj < {k}"), done.where(f"bj >= {k} and bi < {k}")
            column = _side(left, "a", "bj", "bi").join(_side(up.where(f"bj = {k}"), "b", "bi", "bj"), "l")
            row = _side(left.where(f"bi = {k}"), "a", "bj", "bi").join(_side(up.where(f"bj > {k}"), "b", "bi", "bj"), "l")
            own = _remainders(own, column.union(row))
        own = stored(own, "lu-step")
        corner = own.where(f"bi = {k} and bj = {k}")

        def solve(x, d, i, j, k=k):
            if i == j == k:
                return lu(x)
            return solve_lower(x, lu(d)) if i == k else solve_upper(x, lu(d))

        step = stored(_with_one(own, corner, solve), "lu")
        dropped(own)
        done = step if done is None else done.union(step)
    dropped(tiles)
    return done


def tiled_solve(tiles: DataFrame, factor: DataFrame, rows: int, cols: int, side: str, transposed: bool = False) -> DataFrame:
    """X of L X = B (side "l") or X U = B (side "r") for tiles of B (rows by cols) and of the factor.

    transposed: B and X of X U = B are stored transposed, so their tiles are cols by rows of the unknown's.
    """
    if transposed and side != "r":
        raise ValueError("only X U = B has a transposed form")
    down = side == "l" or transposed  # the blocks that are solved one by one are rows
    mine, other = ("bi", "bj") if down else ("bj", "bi")
    tiles = stored(tiles.select("bi", "bj", "ny", "nx", "data"), "tiles")
    factor, done = stored(factor.select("bi", "bj", "ny", "nx", "data"), "factor"), None
    for k in range(rows if down else cols):
        own = tiles.where(F.col(mine) == k)
        if done is not None:
            if side == "l":
                pairs = _side(factor.where(f"bi = {k} and bj < {k}"), "a", "bj", "bi").join(_side(done, "b", "bi", "bj"), "l")
            elif transposed:
                part = factor.where(f"bj = {k} and bi < {k}").select(F.lit(k).alias("at"), "bi", "ny", "nx", "data")
                pairs = _side(part, "a", "bi", "at").withColumnRenamed("at", "bi").join(_side(done, "b", "bi", "bj"), "l")
            else:
                pairs = _side(done, "a", "bj", "bi").join(_side(factor.where(f"bj = {k} and bi < {k}"), "b", "bi", "bj"), "l")
            own = _remainders(own, pairs, flip=transposed)

        def solve(x, d, i, j):
            if side == "l":
                return solve_lower(x, d)
            return solve_upper(x.T, d).T if transposed else solve_upper(x, d)

        step = stored(_with_one(own, factor.where(f"bi = {k} and bj = {k}"), solve), "solve")
        done = step if done is None else done.union(step)
    dropped(tiles, factor)
    return done
