"""Cluster tree, admissible blocks, cross approximation and product, against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters as C
from tessera.operators import crosses


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.random((150, 2)), np.repeat([[0.3, 0.3], [5.0, 5.0]], 40, axis=0), rng.random((30, 2)) + [3, 0]])
    rows = [(i, p.tolist()) for i, p in enumerate(x)] + [(None, [0.0, 0.0]), (-1, None), (-2, [None, 1.0])]
    points, nodes = C.cluster_tree(spark.createDataFrame(rows, "id long, x array<double>").repartition(3), 2, leaf=12)
    return x, points, nodes, C.blocks(nodes)


def test_tree(made):
    x, points, nodes, _ = made
    tree = {r["node"]: r for r in nodes.collect()}
    leaves = {}
    for r in points.collect():
        leaves.setdefault(r["node"], []).append(r["id"])
    assert sorted(i for v in leaves.values() for i in v) == list(range(len(x)))
    for k, r in tree.items():
        held = [i for leaf, v in leaves.items() if bin(leaf)[2:].startswith(bin(k)[2:]) for i in v]
        assert r["n"] == len(held)
        assert np.allclose(x[held].min(0), r["lo"]) and np.allclose(x[held].max(0), r["hi"])
        assert r["is_leaf"] == (k in leaves)
        if r["is_leaf"]:
            assert len(held) <= 12 or r["lo"] == r["hi"]
        else:
            assert tree[2 * k]["n"] + tree[2 * k + 1]["n"] == r["n"] and tree[2 * k + 1]["first"] == tree[2 * k]["first"] + tree[2 * k]["n"]


def test_blocks_partition_all_pairs(made):
    x, points, nodes, pairs = made
    of = {r["id"]: bin(r["node"])[2:] for r in points.collect()}
    times = np.zeros((len(x), len(x)), int)
    for r in pairs.collect():
        i, j = ([k for k, leaf in of.items() if leaf.startswith(bin(r[s])[2:])] for s in "ab")
        times[np.ix_(i, j)] += 1
    assert (times == 1).all() and pairs.where("low").count() > 3
    got = C.coverage(points, nodes, pairs).collect()
    assert sorted(r["id"] for r in got) == list(range(len(x))) and {(r["covered"], r["gaps"]) for r in got} == {(len(x), 0)}


def test_cross_approximation_and_product(spark, made):
    x, points, _, pairs = made
    dense = 1 / (0.01 + ((x[:, None] - x[None]) ** 2).sum(-1))
    u, v = C.cross_approximation(points, pairs, eps=1e-6)
    held = {}
    for side, t in enumerate((u, v)):
        for r in t.collect():
            held.setdefault((r["a"], r["b"]), ({}, {}))[side][r["id"]] = r["f"]
    for us, vs in held.values():
        i, j = sorted(us), sorted(vs)
        near = np.array([us[k] for k in i]) @ np.array([vs[k] for k in j]).T
        want = dense[np.ix_(i, j)]
        assert np.linalg.norm(near - want) <= 1e-5 * np.linalg.norm(want)
        assert near.shape[0] < 13 or len(us[i[0]]) < near.shape[0]
    w = np.random.default_rng(1).standard_normal(len(x))
    got = C.product(points, pairs, (u, v), spark.createDataFrame([(i, float(c)) for i, c in enumerate(w)], "id long, w double")).orderBy("id").collect()
    assert np.allclose([r["y"] for r in got], dense @ w, atol=1e-5 * np.abs(dense).sum(1).max())


def test_nothing(spark):
    points, nodes = C.cluster_tree(spark.createDataFrame([], "id long, x array<double>"), 2)
    pairs = C.blocks(nodes)
    assert points.count() == nodes.count() == pairs.count() == 0
    u, v = C.cross_approximation(points, pairs)
    assert u.count() == v.count() == 0


def test_steps_of_crosses_are_no_jobs(spark, made):
    _, points, _, pairs = made
    spark.sparkContext.setJobGroup("crosses", "crosses")
    u, v = C.cross_approximation(points, pairs, eps=1e-6)
    steps = max(r["n"] for r in u.selectExpr("size(f) n").collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert steps > 5 and 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("crosses")) < 30


@pytest.mark.parametrize("most", [C.SPREAD, 25])
def test_multiplied_where_crosses_are_found(spark, made, monkeypatch, most):
    monkeypatch.setattr(C, "SPREAD", most)  # larger blocks, among them one of equal points, are spread over tasks
    x, points, _, pairs = made
    left = C._grouped(points, pairs)[1]
    assert left is None if most > 25 else {r["low"] for r in left.collect()} == {True, False}
    dense = 1 / (0.01 + ((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.random.default_rng(1).standard_normal(len(x))
    vector = spark.createDataFrame([(i, float(c)) for i, c in enumerate(w) if i != 7] + [(3, None), (-5, 1.0)], "id long, w double")
    w[7] = 0
    some = F.col("id") % 3 == 0
    got = C.multiplied(points, pairs, vector, some, eps=1e-6).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(x)))
    assert np.allclose([r["y"] for r in got], dense @ w, atol=1e-5 * np.abs(dense).sum(1).max())
    low = np.zeros(dense.shape, bool)
    of = {r["id"]: bin(r["node"])[2:] for r in points.collect()}
    for r in pairs.where("low").collect():
        low[np.ix_(*([k for k, leaf in of.items() if leaf.startswith(bin(r[s])[2:])] for s in "ab"))] = True
    whole = np.where(np.arange(len(x)) % 3 == 0, (np.where(low, dense, 0) ** 2).sum(1), 0)
    assert whole.max() > 0 and np.allclose([r["whole"] for r in got], whole) and all(r["off"] <= 1e-8 * r["whole"] for r in got)
    want = {r["id"]: r for r in C.plainly(points, vector, some).collect()}
    assert sorted(want) == list(range(0, len(x), 3))
    assert all(np.allclose([want[i]["want"], want[i]["size"]], [dense[i] @ w, dense[i] @ np.abs(w)]) for i in want)


def test_crosses_of_padded_blocks():
    rng = np.random.default_rng(2)
    x, z = rng.random((2, 3, 9)), rng.random((2, 3, 7)) + 2
    real, there = np.arange(9) < np.array([[9], [7], [1]]), np.arange(7) < np.array([[7], [6], [3]])
    u, v, rank = crosses.crosses(C.inverse_square, x, z, real, there, 1e-8, 30)
    cells = C.inverse_square(x[..., None], z[:, :, None, :]) * real[..., None] * there[:, None, :]
    assert np.allclose(u.transpose(0, 2, 1) @ v, cells, atol=1e-7) and rank[2] == 1 and rank.max() <= 9
    with pytest.raises(ArithmeticError):
        crosses.crosses(C.inverse_square, x, z, real, there, 1e-8, 2)
