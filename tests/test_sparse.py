"""Products with hot keys, and chains ordered by sketches."""

import random

from pyspark.sql import functions as F

from tessera.operators import coo
from tessera.sources import matrices as M


def cells(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, v double")


def test_hot_keys_are_spread(spark):
    rng = random.Random(1)
    a = cells(spark, [(i, 0 if rng.random() < 0.5 else rng.randrange(60), 1.0 + i % 3) for i in range(900)])
    b = cells(spark, [(0 if rng.random() < 0.4 else rng.randrange(60), j, 1.0 + j % 2) for j in range(500)])
    for flags in ({}, {"a_t": False, "b_t": False}):
        want = {(r["i"], r["j"]): r["v"] for r in coo.gemm(a, b, **flags).collect()}
        assert {(r["i"], r["j"]): r["v"] for r in coo.gemm_skewed(a, b, tasks=16, **flags).collect()} == want
    x, y = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", "v")
    share = -(-1400 // 16)
    heavy = {r["k"]: (r["down"], r["across"]) for r in coo.heavy_keys(x, y, share).collect()}
    n, m = x.where("k = 0").count(), y.where("k = 0").count()
    assert heavy == {0: (-(-n // share), -(-m // share))}
    flipped = coo.gemm_skewed(coo.transpose(a), coo.transpose(b), a_t=True, b_t=True, tasks=16)
    assert {(r["i"], r["j"]): r["v"] for r in flipped.collect()} == {(r["i"], r["j"]): r["v"] for r in coo.gemm(a, b).collect()}
    assert coo.gemm_skewed(a.limit(0), b).count() == 0


def test_sparse_order_follows_cells_not_dimensions(spark):
    # A is dense, B has one cell, C is dense: by dimensions all orders cost the same, by cells B comes first with either
    n = 40
    a = cells(spark, [(i, k, 1.0) for i in range(n) for k in range(n)])
    b = cells(spark, [(k, k, 1.0) for k in range(n)])
    c = cells(spark, [(k, 0, 1.0) for k in range(n)])
    cost, tree = coo.sparse_order([coo.supports(m) for m in (a, b, c)])
    assert tree == (0, (1, 2)) and 0.5 * (n + n * n) < cost <= n + n * n  # BC is a column of n cells
    cost, tree = coo.sparse_order([coo.supports(m) for m in (coo.transpose(c), b, a)])
    assert tree == ((0, 1), 2)
    assert {(r["i"], r["v"]) for r in coo.sparse_chain([a, b, c]).collect()} == {(i, float(n)) for i in range(n)}
    assert coo.sparse_chain([a, b.limit(0), c]).count() == 0


def test_sketches_estimate_joins(spark):
    a = cells(spark, [(i % 50, k, 1.0) for k in range(4_000) for i in range(k % 3 + 1)])
    b = cells(spark, [(k, k % 7, 1.0) for k in range(2_000, 9_000)])
    shared, muls = coo._shared(coo.supports(a)["j"], coo.supports(b)["i"])
    assert abs(shared - 2_000) < 700 and abs(muls - sum(k % 3 + 1 for k in range(2_000, 4_000))) < 1_600


def test_product_with_hot_keys_has_tasks_for_its_cells(spark, monkeypatch):
    a = spark.createDataFrame([(i, 0 if i % 2 else i % 40, float(i % 7)) for i in range(600)], "i long, j long, v double")
    b = spark.createDataFrame([(k, j, float(k + j)) for k in range(40) for j in range(5)], "i long, j long, v double")
    want = sorted(map(tuple, coo.gemm(a, b).collect()))
    monkeypatch.setattr(coo, "TASK_CELLS", 8)
    out = coo.gemm_skewed(a, b)
    assert ", 100), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == want


def test_rows_as_text_are_rounded_as_binary_numbers_are(spark):
    m = spark.createDataFrame([(0, 1, 9812.4975), (0, 0, -1.5), (1, 0, 9709.8295)], "i long, j long, v double")
    assert [tuple(r) for r in M.print_rows(m).collect()] == [(0, "-1.500000e+00 9.812497e+03"), (1, "9.709829e+03")]
