"""Nested hierarchical matrices and their LU.

A matrix is halved again and again. Of the quadrants off the diagonal each is one low-rank leaf U Vᵀ; those on it are
halved further, down to dense leaves of at most ``least`` rows. LU without pivoting goes down the tree: factor the first
quadrant, solve with its L and its U for the factors of the two off the diagonal, add their product to every leaf of the
last quadrant (a dense product into a dense leaf, an accumulation with recompression into a low-rank one), factor that.
Nothing expands a low-rank leaf, so the work grows as n log(n)² times the square of the rank.

One task factors one matrix, as its steps depend on each other; matrices are factored side by side. A matrix is a
row (key, n); its cells come from a function of row and column numbers, or from a table through `hierarchical`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.hierarchical import Part, added
from tessera.plans.interpreter import lu, solve_lower

Cells = Callable[[np.ndarray, np.ndarray], np.ndarray]
TASK = "seq int, op string, level int, bi int, bj int"


def low_rank(m: np.ndarray, rank: int, seed: int = 1) -> Part:
    """The best few columns of m's range that a random projection shows, and what m is in them."""
    k = min(rank + 8, *m.shape)
    q = np.linalg.qr(m @ np.random.default_rng(seed).standard_normal((m.shape[1], k)))[0]
    x, s, yt = np.linalg.svd(q.T @ m, full_matrices=False)
    k = max(1, int((s[:rank] > 1e-15 * max(s[0], 1e-300)).sum()))
    return Part(u=q @ (x[:, :k] * s[:k]), v=yt[:k].T)


class Nested:
    """Leaves by (level, block row, block column); diagonal ones are dense and on the last level."""

    def __init__(self, n: int, cells: Cells, least: int, rank: int):
        self.n, self.rank, self.depth, self.tasks = n, rank, 0, []
        while n > least << self.depth:
            self.depth += 1
        cut = lambda a, b: cells(np.arange(*self.span(*a))[:, None], np.arange(*self.span(*b))[None, :])
        self.leaves = {(self.depth, b, b): Part(cut((self.depth, b), (self.depth, b))) for b in range(1 << self.depth)}
        self.leaves |= {(l, b, b ^ 1): low_rank(cut((l, b), (l, b ^ 1)), rank) for l in range(1, self.depth + 1) for b in range(1 << l)}

    def span(self, level: int, block: int) -> tuple[int, int]:
        lo, hi = 0, self.n
        for bit in range(level - 1, -1, -1):
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if block >> bit & 1 else (lo, mid)
        return lo, hi

    def halves(self, level: int, block: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.span(level, block)
        cut = self.span(level + 1, 2 * block)[1] - lo
        assert len(x) == hi - lo
        return x[:cut], x[cut:]

    def below(self, level: int, block: int) -> Part:
        return self.leaves[level + 1, 2 * block + 1, 2 * block]

    def above(self, level: int, block: int) -> Part:
        return self.leaves[level + 1, 2 * block, 2 * block + 1]

    def factor(self, level: int = 0, block: int = 0) -> None:
        if level == self.depth:
            leaf = self.leaves[level, block, block]
            leaf.data = lu(leaf.data)
            self.tasks.append(("getrf", level, block, block))
            return
        a, b, down = 2 * block, 2 * block + 1, level + 1
        self.factor(down, a)
        up, low = self.above(level, block), self.below(level, block)
        up.u = self.forward(down, a, up.u)
        low.v = self.across(down, a, low.v)
        self.tasks += [("trsml", down, a, b), ("trsmr", down, b, a)]
        self.add(down, b, -low.u @ (low.v.T @ up.u), up.v)
        self.factor(down, b)

    def add(self, level: int, block: int, u: np.ndarray, v: np.ndarray) -> None:
        """Add u vᵀ to a diagonal block."""
        if level == self.depth:
            self.leaves[level, block, block].data += u @ v.T
            self.tasks.append(("gemm", level, block, block))
            return
        (u0, u1), (v0, v1) = self.halves(level, block, u), self.halves(level, block, v)
        a, b, down = 2 * block, 2 * block + 1, level + 1
        self.add(down, a, u0, v0)
        self.add(down, b, u1, v1)
        for at, x, y in (((down, a, b), u0, v1), ((down, b, a), u1, v0)):
            leaf = added(self.leaves[at], x, y, 1e-15)
            self.leaves[at] = Part(u=leaf.u[:, : self.rank], v=leaf.v[:, : self.rank])
            self.tasks.append(("accum", *at))

    def forward(self, level: int, block: int, x: np.ndarray) -> np.ndarray:
        """Y of L Y = x, L of a factored diagonal block."""
        if level == self.depth:
            return solve_lower(x, self.leaves[level, block, block].data)
        x0, x1 = self.halves(level, block, x)
        y0, low = self.forward(level + 1, 2 * block, x0), self.below(level, block)
        return np.vstack([y0, self.forward(level + 1, 2 * block + 1, x1 - low.u @ (low.v.T @ y0))])

    def across(self, level: int, block: int, x: np.ndarray) -> np.ndarray:
        """Y of Uᵀ Y = x, U of a factored diagonal block."""
        if level == self.depth:
            return np.linalg.solve(np.triu(self.leaves[level, block, block].data).T, x)
        x0, x1 = self.halves(level, block, x)
        y0, up = self.across(level + 1, 2 * block, x0), self.above(level, block)
        return np.vstack([y0, self.across(level + 1, 2 * block + 1, x1 - up.v @ (up.u.T @ y0))])

    def lower_times(self, x: np.ndarray, level: int = 0, block: int = 0) -> np.ndarray:
        if level == self.depth:
            return np.tril(self.leaves[level, block, block].data, -1) @ x + x
        x0, x1 = self.halves(level, block, x)
        low = self.below(level, block)
        return np.vstack([self.lower_times(x0, level + 1, 2 * block), self.lower_times(x1, level + 1, 2 * block + 1) + low.u @ (low.v.T @ x0)])

    def upper_times(self, x: np.ndarray, level: int = 0, block: int = 0) -> np.ndarray:
        if level == self.depth:
            return np.triu(self.leaves[level, block, block].data) @ x
        x0, x1 = self.halves(level, block, x)
        up = self.above(level, block)
        return np.vstack([self.upper_times(x0, level + 1, 2 * block) + up.u @ (up.v.T @ x1), self.upper_times(x1, level + 1, 2 * block + 1)])


def factored(matrices: DataFrame, cells: Cells, least: int, rank: int, result: Callable[[Nested], pd.DataFrame], schema: str) -> DataFrame:
    """result(factored matrix) with its key, for each row (key, n) of matrices. schema: of result."""

    def run(frames):
        for pdf in frames:
            for key, n in zip(pdf["key"].tolist(), pdf["n"].tolist(), strict=True):
                m = Nested(int(n), cells, least, rank)
                m.factor()
                out = result(m)
                out.insert(0, "key", key)
                yield out

    return matrices.select("key", "n").repartition(matrices.sparkSession.sparkContext.defaultParallelism, "key").mapInPandas(run, f"key long, {schema}")


def product(m: Nested) -> pd.DataFrame:
    """The cells of L U."""
    out = m.lower_times(m.upper_times(np.eye(m.n)))
    i, j = np.indices(out.shape)
    return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": out.ravel()})


def task_list(m: Nested) -> pd.DataFrame:
    """The tasks on leaves, in program order."""
    return pd.DataFrame([(n, *t) for n, t in enumerate(m.tasks)], columns=["seq", "op", "level", "bi", "bj"])
