"""Orthogonal and low-rank factorisations of blocks: Givens QR, one-sided Jacobi SVD, recompression.

Blocks are rows (key, ny, nx, data array<double>, row by row). Each block is factored by one task; many blocks are
factored side by side. A low-rank block is U (ny by k) times the transpose of V (nx by k).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import coo


def rotation_code(c: float, s: float) -> float:
    """A rotation in one number: s / 2 if |s| <= |c|, or else 2 / c; 0 is the identity, 1 a quarter turn."""
    if s == 0:
        return 0.0
    if c == 0:
        return 1.0 if s > 0 else -1.0
    sign = 1.0 if c > 0 else -1.0
    return sign * s / 2 if abs(s) <= abs(c) else (1.0 if s > 0 else -1.0) * 2 / c


def rotation_of(code: float) -> tuple[float, float]:
    """(c, s) of a code, up to the sign of both."""
    if code == 0:
        return 1.0, 0.0
    if abs(code) == 1:
        return 0.0, code
    if abs(code) < 1:
        s = 2 * code
        return float(np.sqrt(max(0.0, 1 - s * s))), s
    c = 2 / code
    return c, float(np.sqrt(max(0.0, 1 - c * c)))


def givens(a: np.ndarray) -> np.ndarray:
    """R on and above the diagonal, rotation codes below it; columns from the left, each from the bottom up."""
    a = a.copy()
    ny, nx = a.shape
    for j in range(min(ny, nx)):
        for i in range(ny - 1, j, -1):
            x, y = a[i - 1, j], a[i, j]
            r = np.hypot(x, y)
            c, s = (1.0, 0.0) if r == 0 else (x / r, y / r)
            c, s = rotation_of(code := rotation_code(c, s))
            a[[i - 1, i], j:] = np.array([[c, s], [-s, c]]) @ a[[i - 1, i], j:]
            a[i, j] = code
    return a


def recover_q(coded: np.ndarray, p: int) -> np.ndarray:
    """The first p columns of Q."""
    ny, nx = coded.shape
    q = np.eye(ny, p)
    for j in range(min(ny, nx) - 1, -1, -1):
        for i in range(j + 1, ny):
            c, s = rotation_of(coded[i, j])
            q[[i - 1, i]] = np.array([[c, -s], [s, c]]) @ q[[i - 1, i]]
    return q


def jacobi_sweep(us: np.ndarray, v: np.ndarray, tol: float, floor: float = 0.0) -> float:
    """One sweep over all pairs of columns, in place; the largest cosine that it met.

    Pairs turn if their cosine is over tol. Columns no longer than floor count as zero and stay as they are.
    """
    met, n = 0.0, us.shape[1]
    for p in range(n - 1):
        for q in range(p + 1, n):
            d, pp, qq = us[:, p] @ us[:, q], us[:, p] @ us[:, p], us[:, q] @ us[:, q]
            if min(pp, qq) <= floor * floor or abs(d) <= tol * np.sqrt(pp) * np.sqrt(qq):
                continue
            met = max(met, abs(d) / (np.sqrt(pp) * np.sqrt(qq)))
            z = (qq - pp) / (2 * d)
            t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            turn = np.array([[c, c * t], [-c * t, c]])
            us[:, [p, q]] = us[:, [p, q]] @ turn
            v[:, [p, q]] = v[:, [p, q]] @ turn
    return met


#: Cosine of columns that count as orthogonal, and length of a column that counts as zero, as a part of the matrix's norm.
COSINE, NOTHING = 1e-13, 1e-14


def jacobi_svd(a: np.ndarray, tol: float = COSINE, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(US, V): A = US Vᵀ with orthogonal columns of US, whose norms are the singular values. Raises if sweeps don't suffice.

    tol bounds the cosine between columns, whatever their size; columns under NOTHING of the matrix's norm count as zero.
    """
    us, v = a.astype(np.float64).copy(), np.eye(a.shape[1])
    floor = NOTHING * float(np.linalg.norm(us))
    for _ in range(most_sweeps):
        if jacobi_sweep(us, v, tol, floor) <= tol:
            return us, v
    raise ArithmeticError(f"cosines of columns are over {tol} after {most_sweeps} sweeps")


def column_rank(us: np.ndarray, eps: float) -> int:
    return int(((us * us).sum(axis=0) >= eps).sum())


def recompress(u1, v1, u2, v2, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(U, V) of U1's rank with U Vᵀ near U1 V1ᵀ + U2 V2ᵀ; equal if the sum's rank is no larger."""
    omega = np.random.default_rng(seed).standard_normal((v1.shape[0], u1.shape[1]))
    y = u1 @ (v1.T @ omega) + u2 @ (v2.T @ omega)
    q = recover_q(givens(y), u1.shape[1])
    return q, v1 @ (q.T @ u1).T + v2 @ (q.T @ u2).T


# ---- over tables of blocks -----------------------------------------------------------------------------------


def blocks_of(cells: DataFrame, key: str, ny: int, nx: int) -> DataFrame:
    """(key, ny, nx, data) from (key, i, j, v)."""
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * nx + F.col("j")).alias("p"), "v"))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda p: F.coalesce(F.element_at("m", p.cast("long")), F.lit(0.0)))
    return held.select(key, F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), data.alias("data"))


def _matrix(row) -> np.ndarray:
    return np.asarray(row["data"], np.float64).reshape(int(row["ny"]), int(row["nx"]))


def _cells(key: str, value, m: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(m.shape)
    return pd.DataFrame({key: [value] * m.size, "i": i.ravel().astype("int64"), "j": j.ravel().astype("int64"), "v": m.ravel()})


def each_block(blocks: DataFrame, key: str, function) -> DataFrame:
    """(key, i, j, v): the cells of function(block) for every block."""
    kind = dict(blocks.dtypes)[key]

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                yield _cells(key, row[key], function(_matrix(row)))

    return blocks.mapInPandas(run, f"`{key}` {kind}, i bigint, j bigint, v double")


def givens_qr(blocks: DataFrame, key: str) -> DataFrame:
    """R of each block."""
    return each_block(blocks, key, lambda a: np.triu(givens(a)))


def givens_q(blocks: DataFrame, key: str) -> DataFrame:
    """Q of each block, as many columns as the block has."""
    return each_block(blocks, key, lambda a: recover_q(givens(a), a.shape[1]))


def singular_values(blocks: DataFrame, key: str) -> DataFrame:
    """(key, i = 0, j, v): singular values, largest first."""

    def values(a):
        return -np.sort(-np.sqrt((jacobi_svd(a)[0] ** 2).sum(axis=0)))[None, :]

    return each_block(blocks, key, values)


def svd_rank(blocks: DataFrame, key: str, eps: float) -> DataFrame:
    """(key, i = 0, j = 0, v): rank by squared singular values of at least eps."""
    return each_block(blocks, key, lambda a: np.array([[float(column_rank(jacobi_svd(a)[0], eps))]]))


def accumulate(low1: DataFrame, low2: DataFrame, key: str) -> DataFrame:
    """(key, i, j, v) of U Vᵀ after adding low-rank blocks; low: (key, u, v) arrays of rows."""

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m = [np.stack([np.asarray(r, np.float64) for r in x[c].iloc[0]]) for x in (a, b) for c in ("u", "v")]
        u, v = recompress(*m)
        return _cells(key, a[key].iloc[0], u @ v.T)

    kind = dict(low1.dtypes)[key]
    return low1.groupBy(key).cogroup(low2.groupBy(key)).applyInPandas(run, f"`{key}` {kind}, i bigint, j bigint, v double")


def tall_r(df: DataFrame, vector: str) -> DataFrame:
    """R of a tall matrix with a row in each record: QR of each task's rows, then of the stacked triangles.

    Triangles are dealt out to a 64th of the tasks and reduced there, again and again until one task is left. Only
    triangles are shuffled, and the rows themselves are factored where they are read.
    """
    import pyarrow as pa

    def triangle(batches):
        r = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row.tolist() for row in r], pa.list_(pa.float64()))], names=["row"])

    out = df.select(F.col(vector).cast("array<double>").alias("row")).mapInArrow(triangle, "row array<double>")
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 64)
        out = out.repartition(parts).mapInArrow(triangle, "row array<double>")
    return out


def low_rank_product(u: DataFrame, v: DataFrame) -> DataFrame:
    """The cells of U Vᵀ; expand only what is read."""
    return coo.gemm(u, v, b_t=True)
