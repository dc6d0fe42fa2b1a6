"""Numeric fixtures and algebraic invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, coo, lowrank, permute
from tessera.plans import interpreter, tiled
from tessera.sources import matrices as M

RNG = np.random.default_rng(3)


def frame(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")


def array(df, ny, nx):
    out = np.zeros((ny, nx))
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def one(spark, **m):
    return spark.createDataFrame([tuple(x.tolist() for x in m.values())], ", ".join(f"{k} array<array<double>>" for k in m))


def dominant(ny, nx):
    return RNG.standard_normal((ny, nx)) + 2 * max(ny, nx) * np.eye(ny, nx)


@pytest.mark.parametrize("shape", [(5, 5), (7, 4), (4, 7), (1, 1)])
def test_getrf(spark, shape):
    a = dominant(*shape)
    lu = np.array(one(spark, m=a).select(blocks.getrf(F.col("m"))).first()[0])
    k = min(shape)
    low, up = np.tril(lu, -1)[:, :k] + np.eye(shape[0], k), np.triu(lu)[:k]
    assert np.allclose(low @ up, a)
    assert np.allclose(interpreter.lu(a), lu)


def test_solves(spark):
    lu, b, c = dominant(5, 5), RNG.standard_normal((5, 3)), RNG.standard_normal((3, 5))
    low, up = np.tril(lu, -1) + np.eye(5), np.triu(lu)
    got = one(spark, l=lu, b=b, c=c, t=np.ascontiguousarray(c.T)).select(blocks.trsml(F.col("b"), F.col("l")), blocks.trsmr(F.col("c"), F.col("l")), blocks.trsmr_stored_transposed(F.col("t"), F.col("l"))).first()
    assert np.allclose(low @ np.array(got[0]), b)
    assert np.allclose(np.array(got[1]) @ up, c)
    assert np.allclose(np.array(got[2]).T @ up, c)
    with pytest.raises(ValueError):
        interpreter.execute("trsml", b, lu, flags=[True])


@pytest.mark.parametrize("shape", [(5, 5, 5), (4, 3, 5), (5, 2, 4), (3, 2, 1)])
@pytest.mark.parametrize("flags", [(False, False), (True, False), (False, True), (True, True)])
def test_gemm(spark, shape, flags):
    m, k, n = shape
    a, b, c = RNG.standard_normal((m, k)), RNG.standard_normal((k, n)), RNG.standard_normal((m, n))
    x, y = (a.T if flags[0] else a), (b.T if flags[1] else b)
    for alpha, beta in ((1, 1), (-1, 1), (2, 0), (0, 2)):
        got = array(coo.gemm_into(frame(spark, c), frame(spark, x), frame(spark, y), alpha, beta, *flags), m, n)
        assert np.allclose(got, alpha * a @ b + beta * c)


def test_chain_orders(spark):
    dims = [3, 4, 2, 5, 3]
    m = [RNG.standard_normal((dims[i], dims[i + 1])) for i in range(4)]
    want, frames = np.linalg.multi_dot(m), [frame(spark, x) for x in m]
    for c in range(5):
        assert np.allclose(array(coo.chain4(*frames, c), 3, 3), want)
    assert np.allclose(array(coo.chain(frames, dims), 3, 3), want)
    assert coo.best_order([10, 30, 5, 60]) == (4500, ((0, 1), 2))
    with pytest.raises(ValueError):
        coo.chain4(*frames, 5)


def test_tiled_lu_and_solves(spark):
    a, b = dominant(10, 10), RNG.standard_normal((10, 4))
    lu = M.stored(tiled.tiled_lu(M.to_tiles(frame(spark, a), 10, 10, 4), 3), "t")
    assert np.allclose(array(M.from_tiles(lu, 4), 10, 10), interpreter.lu(a))
    x = array(M.from_tiles(tiled.tiled_solve(M.to_tiles(frame(spark, b), 10, 4, 4), lu, 3, 1, "l"), 4), 10, 4)
    low = np.tril(interpreter.lu(a), -1) + np.eye(10)
    assert np.allclose(low @ x, b)


def test_operations():
    a, b, c = dominant(4, 4), RNG.standard_normal((4, 4)), RNG.standard_normal((4, 4))
    assert np.allclose(interpreter.execute("gemm_plus", a, b, c), a + b @ c)
    assert np.allclose(interpreter.execute("gemm_3x", a, b, c, b), a - b @ c @ b)
    assert np.allclose(interpreter.execute("gemm_4x", a, b, c, b, c), a - b @ c @ b @ c)
    assert interpreter.execute("nop", a) is a
    with pytest.raises(ValueError):
        interpreter.execute("what", a)


@pytest.mark.parametrize("shape", [(9, 6), (6, 6), (4, 7)])
def test_givens(shape):
    a = RNG.standard_normal(shape)
    a[:, 0] = 0
    a[-1] = -np.abs(a[-1])
    coded = lowrank.givens(a)
    q = lowrank.recover_q(coded, shape[0])
    assert np.allclose(q.T @ q, np.eye(shape[0]))
    assert np.allclose(q @ np.triu(coded), a)


@pytest.mark.parametrize("shape", [(9, 6), (9, 8), (5, 3)])
def test_jacobi(shape):
    a = RNG.standard_normal(shape)
    us, v = lowrank.jacobi_svd(a, 1e-13)
    assert np.allclose(us @ v.T, a)
    assert np.allclose(np.sort((us * us).sum(0)), np.sort(np.linalg.svd(a, compute_uv=False) ** 2))
    low = a[:, :1] @ np.ones((1, 4))
    assert lowrank.column_rank(lowrank.jacobi_svd(low, 1e-13)[0], 1e-9) == 1


def test_recompress():
    u, v, w = RNG.standard_normal((12, 5)), RNG.standard_normal((10, 5)), RNG.standard_normal((10, 2))
    u2 = u @ RNG.standard_normal((5, 2))
    x, y = lowrank.recompress(u, v, u2, w)
    assert np.allclose(x @ y.T, u @ v.T + u2 @ w.T)


def test_permute(spark):
    m = RNG.standard_normal((4, 3))
    df = frame(spark, m)
    p = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "row long, target long")
    forward = permute.apply_pivot(df, p)
    assert np.allclose(array(forward, 4, 3), m[[2, 0, 3, 1]])
    assert np.allclose(array(permute.apply_pivot(forward, p, recover=True), 4, 3), m)
    assert permute.argmax_abs(spark.createDataFrame([(0, 0, -2.0), (1, 0, 2.0), (2, 0, 1.0)], "i long, j long, v double"), "i").first()[0] == 0
    assert permute.argmax_abs(spark.createDataFrame([(3, 0, 0.0), (4, 0, 0.0)], "i long, j long, v double"), "i").first()[0] == 0
    assert array(M.zeros(spark, 2, 3), 2, 3).sum() == 0


def test_hierarchical_lu(spark):
    from tessera.operators import hierarchical as H

    u, v = RNG.standard_normal((16, 2)), RNG.standard_normal((16, 2))
    a = 0.1 * u @ v.T + 20 * np.eye(16)
    leaf = M.stored(H.leaves(M.to_tiles(frame(spark, a), 16, 16, 8)), "leaf")
    assert {r["kind"] for r in leaf.where("bi <> bj").collect()} == {"lowrank"}
    assert np.allclose(array(M.from_tiles(H.expand(leaf), 8), 16, 16), a)
    done = M.stored(H.hlu(leaf, 2), "done")
    assert {r["kind"] for r in done.where("bi <> bj").collect()} == {"lowrank"}
    assert np.allclose(array(M.from_tiles(H.expand(done), 8), 16, 16), interpreter.lu(a))
    table = H.leaf_table(leaf, 8, 1).collect()
    assert sorted((r["path"], r["i0"], r["j0"]) for r in table) == [([0], 0, 0), ([1], 0, 8), ([2], 8, 0), ([3], 8, 8)]
