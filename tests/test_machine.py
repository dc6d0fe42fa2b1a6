"""Instruction words, rounds of the machine, zero pivots, nested hierarchical matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, deps, lowrank, nested
from tessera.plans import interpreter, machine, tasks, tiled
from tessera.sources import matrices as M

E, W, END = machine.encode, machine.SIGNAL_WAIT, [machine.FINISH]


@pytest.mark.parametrize("op", sorted(set(machine.OPERATIONS) - {"nop"}))
def test_lengths(op):
    n, _, n_flags, _ = machine.LAYOUT[op]
    n_sizes = {"getrf": 2, "trsml": 3, "trsmr": 3, "gemm": 3, "gemm_plus": 3, "gemm_3x": 4, "gemm_4x": 5, "accum": 4}[op]
    words = E(5, op, [(m, 10 * m, 99) for m in range(n)], [3] * n_sizes, [0] * n_flags, 1)
    assert len(words) == machine.LENGTHS[op]
    name, views, flags, _ = machine.decode(words)
    assert name == op and [v[:2] for v in views] == [(m, 10 * m) for m in range(n)] and all(v[2:] == (3, 3, 99) for v in views) and len(flags) == n_flags


def test_bad_words():
    with pytest.raises(ValueError, match="unknown operation"):
        machine.decode([0, 0, 99])
    with pytest.raises(ValueError, match="words"):
        machine.decode([0, 0, machine.OPERATIONS["gemm"], 1])
    with pytest.raises(ValueError, match="no end"):
        machine.rounds([[E(0, "nop")]])
    with pytest.raises(ValueError, match="deadlock"):
        machine.rounds([[[W, 1, 0], E(0, "nop"), END], [[W, 0, 0], E(1, "nop"), END]])
    with pytest.raises(ValueError, match="opcode"):
        machine.rounds([[[7, 0, 0], END]])


def test_rounds_obey_waits():
    streams = [[E(0, "nop"), E(1, "nop"), [W, 2, 0], E(3, "nop"), END], [[W, 1, 0], E(2, "nop"), [W, 3, 0], E(4, "nop"), END]]
    assert machine.rounds(streams) == [[(0, 0), (0, 1)], [(1, 1)], [(0, 3)], [(1, 3)]]
    assert machine.rounds([[END], [END]]) == []


def test_products():
    rng = np.random.default_rng(1)
    a, b, c, d = (rng.standard_normal(s) for s in ((3, 4), (4, 5), (5, 2), (2, 6)))
    for control in range(2):
        assert np.allclose(interpreter.product([a, b.T, c], [False, True, False], control), a @ b @ c)
    for control in range(5):
        assert np.allclose(interpreter.product([a, b, c, d], (), control), a @ b @ c @ d)
    with pytest.raises(ValueError, match="control"):
        interpreter.product([a, b, c, d], (), 5)


def test_views_of_one_matrix(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((6, 6))
    memory = spark.createDataFrame([(0, int(p), float(v)) for p, v in enumerate(m.ravel())], "m int, pos long, v double")
    # The lower right 3 x 3 loses the product of the panels; another worker then adds it again, transposed and in pieces.
    first = [E(0, "gemm", [(0, 21, 6), (0, 18, 6), (0, 3, 6)], [3, 3, 3], [0, 0]), END]
    second = [[W, 0, 0], E(1, "gemm_plus", [(0, 21, 6), (0, 3, 6), (0, 18, 6)], [3, 3, 3], [1, 1]), END]
    streams = spark.createDataFrame([(w, n, x) for w, s in enumerate((first, second)) for n, x in enumerate(s)], machine.STREAM)
    got = np.zeros(36)
    for r in machine.run(memory, streams).collect():
        got[r["pos"]] = r["v"]
    want = m.copy()
    want[3:, 3:] += -m[3:, :3] @ m[:3, 3:] + m[:3, 3:].T @ m[3:, :3].T
    assert np.allclose(got.reshape(6, 6), want)


def test_zero_pivots(spark):
    m = np.array([[0.0, 1.0], [1.0, 1.0]])
    with pytest.raises(interpreter.ZeroPivot):
        interpreter.lu(m)
    with pytest.raises(interpreter.ZeroPivot):
        interpreter.solve_upper(np.ones((1, 2)), m)
    one = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")
    with pytest.raises(Exception, match="a pivot is 0"):
        one.select(blocks.getrf(F.col("m"))).collect()
    assert np.allclose(interpreter.lu(np.array([[2.0, 1.0], [4.0, 2.0]])), [[2, 1], [2, 0]])  # the last pivot divides nothing


def by_levels(tiles):
    tasks_ = M.stored(tasks.lu_tasks(tiles.sparkSession, 3), "tasks")
    return interpreter.run_levels(tiles, interpreter.lu_reads(tasks_), tasks.levels(tasks.dag_edges(tiles.sparkSession, 3), tasks_))


@pytest.mark.parametrize("factor", [by_levels, lambda tiles: tiled.tiled_lu(tiles, 3)])
def test_tiles(spark, factor):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((10, 10)) + 30 * np.eye(10), rng.standard_normal((10, 3))
    coo = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")

    def dense(tiles, ny, nx):
        out = np.zeros((ny, nx))
        for r in M.from_tiles(tiles, 4).collect():
            out[r["i"], r["j"]] = r["v"]
        return out

    lu = M.stored(factor(M.to_tiles(coo(a), 10, 10, 4)), "lu")
    got = dense(lu, 10, 10)
    assert np.allclose(got, interpreter.lu(a))
    up = np.triu(got)
    x = dense(tiled.tiled_solve(M.to_tiles(coo(b), 10, 3, 4), lu, 3, 1, "l"), 10, 3)
    y = dense(tiled.tiled_solve(M.to_tiles(coo(b.T), 3, 10, 4), lu, 1, 3, "r"), 3, 10)
    z = dense(tiled.tiled_solve(M.to_tiles(coo(b), 10, 3, 4), lu, 3, 1, "r", transposed=True), 10, 3)
    assert np.allclose((np.tril(got, -1) + np.eye(10)) @ x, b) and np.allclose(y @ up, b.T) and np.allclose(z, y.T)


@pytest.mark.parametrize("ny, nx", [(11, 5), (5, 11), (9, 9)])
def test_tiled_lu_of_any_shape(spark, ny, nx):
    a = np.random.default_rng(ny).standard_normal((ny, nx)) + 30 * np.eye(ny, nx)
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(ny) for j in range(nx)], "i long, j long, v double")
    out = np.zeros((ny, nx))
    for r in M.from_tiles(tiled.tiled_lu(M.to_tiles(cells, ny, nx, 2), -(-ny // 2), -(-nx // 2)), 2).collect():
        out[r["i"], r["j"]] = r["v"]
    assert np.allclose(out, interpreter.lu(a))


def test_sweeps_that_do_not_suffice():
    with pytest.raises(ArithmeticError):
        lowrank.jacobi_svd(np.random.default_rng(1).standard_normal((9, 6)), 1e-14, most_sweeps=1)


def test_order_of_insertion(spark):
    rows = [(1, 5, 1, 1), (1, 3, 1, 2), (1, 9, 4, 3), (1, 5, 0, 4), (1, 3, 2, 5), (1, 5, 1, 6), (2, 7, 1, 7), (2, 7, 0, 8)]
    table = deps.replayed(spark.createDataFrame(rows, "inst_from long, inst_to long, dep int, seq long"))
    assert [tuple(r) for r in deps.dump(table).collect()] == [(1, 3, 2), (1, 5, 1), (1, 9, 4)]
    assert deps.successors(table).collect()[0]["others"] == [3, 9, 5]


def test_regions_of_unlike_widths(spark):
    rows = [(0, 0, 10**9, 10**9, 1), (1, 5, 3, 3, 2), (2, 10**6, 64, 64, 4), (3, 2 * 10**9, 1, 1, 1), (4, 10**9 - 1, 2, 2, 1)]
    got = {tuple(r) for r in deps.overlapping(spark.createDataFrame(rows, "id long, ptr long, pitch long, width long, height long"), "id").collect()}
    assert got == {(0, 1), (0, 2), (0, 4)}


@pytest.mark.parametrize(("n", "least"), [(1, 4), (5, 8), (37, 4), (128, 16)])
def test_nested(n, least):
    cells = lambda i, j: 1.0 / (1.0 + np.abs(i - j)) + 50.0 * (i == j)
    i, j = np.indices((n, n))
    m = nested.Nested(n, cells, least, 20)
    m.factor()
    got = nested.product(m)["v"].to_numpy().reshape(n, n)
    assert np.allclose(got, cells(i, j), atol=1e-8)
    assert sum(t[0] == "getrf" for t in m.tasks) == 1 << m.depth
