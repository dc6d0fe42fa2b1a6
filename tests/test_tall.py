"""QR of tall tables with Q, and the randomised SVD."""

import numpy as np
import pytest

from tessera.operators import lowrank, tall


def rows(spark, x, parts, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, r.tolist(), 1) for i, r in zip(ids, x, strict=True)] + [("lost" if ids is not range(len(x)) and isinstance(next(iter(ids)), str) else -1, None, 1)], ("id string" if isinstance(next(iter(ids)), str) else "id long") + ", x array<double>, q int").repartition(parts)


@pytest.mark.parametrize("parts, block", [(1, 4096), (3, 7), (9, 20)])
@pytest.mark.parametrize("shape, rank", [((230, 6), 6), ((90, 8), 3), ((4, 9), 4)])
def test_qr(spark, parts, block, shape, rank):
    rng = np.random.default_rng(parts)
    x = rng.standard_normal((shape[0], rank)) @ rng.standard_normal((rank, shape[1]))
    q, r = tall.tall_qr(rows(spark, x, parts), "id", "x", block_rows=block, fan=3)
    got = np.array([row["q"] for row in q.orderBy("id").collect()])
    assert np.allclose(got @ r, x, atol=1e-10)
    assert np.allclose(got.T @ got, np.eye(got.shape[1]), atol=1e-10)
    assert (np.diagonal(r) >= 0).all() and np.allclose(np.tril(r, -1), 0, atol=1e-10)
    if rank == min(shape):
        want_q, want_r = np.linalg.qr(x)
        sign = np.where(np.diagonal(want_r) < 0, -1, 1)
        assert np.allclose(r, sign[:, None] * want_r, atol=1e-9) and np.allclose(got, want_q * sign, atol=1e-9)


def test_blocks_over_batches(spark):
    x = np.random.default_rng(3).standard_normal((100, 3))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 15)
    try:
        q, r = tall.tall_qr(rows(spark, x, 1), "id", "x", block_rows=20)
        got = np.array([row["q"] for row in q.orderBy("id").collect()])
        assert np.allclose(got @ r, x)
    finally:
        spark.conf.set(name, before)


def test_qr_of_nothing(spark):
    q, r = tall.tall_qr(spark.createDataFrame([], "id long, x array<double>"), "id", "x")
    assert q.count() == 0 and r.size == 0


@pytest.mark.parametrize("shape, rank", [((60, 45), 5), ((30, 200), 12)])
def test_randomized_svd(spark, shape, rank):
    rng = np.random.default_rng(1)
    a = (rng.standard_normal((shape[0], rank)) * 0.5 ** np.arange(rank)) @ rng.standard_normal((rank, shape[1]))
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(shape[0]) for j in range(shape[1])], "i long, j long, v double").repartition(3)
    u, s, v = tall.randomized_svd(cells, 5)
    u, v = (np.array([r["q"] for r in f.orderBy("id").collect()]) for f in (u, v))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(s, want[:5], rtol=1e-3)
    for side in (u, v):
        assert np.allclose(side.T @ side, np.eye(5), atol=1e-9)
    assert np.linalg.norm(a - (u * s) @ v.T) <= 1.01 * np.linalg.norm(want[5:]) + 1e-9


def test_jacobi_stops_at_any_scale():
    rng = np.random.default_rng(0)
    for scale in (1e-9, 1.0, 1e9):
        for shape in ((25, 7), (7, 25), (20, 20)):
            a = scale * (1e3 * rng.random(shape) + rng.standard_normal(shape))
            us, v = lowrank.jacobi_svd(a)
            assert np.allclose(np.sort(np.linalg.norm(us, axis=0))[::-1][: min(shape)], np.linalg.svd(a, compute_uv=False), rtol=1e-9)
            assert np.allclose(us @ v.T, a, atol=1e-9 * scale * 1e3)
    low = np.outer(np.arange(1.0, 26), np.ones(7)) + 1e-13
    assert lowrank.column_rank(lowrank.jacobi_svd(low)[0], 1e-9) == 1


def test_residual_joins_no_cell_to_both_factors(spark, monkeypatch):
    """The residual of `rsvd_leading` sums AV by row before it meets U, and cells that are stored aren't stored again."""
    from tessera.plans import registry

    tags, plain = [], tall.stored
    monkeypatch.setattr(tall, "stored", lambda df, tag: (tags.append(tag), plain(df, tag))[1])
    rows = [(r % 23, (r * r) % 41, 1.0 + r % 7) for r in range(400)]
    monkeypatch.setattr(registry, "supply", lambda s, d: s.createDataFrame(rows, "i long, j long, v double").groupBy("i", "j").agg({"v": "sum"}).toDF("i", "j", "v"))
    out = registry.leading(spark, "")
    assert "rsvd-cells" not in tags
    a = np.zeros((23, 41))
    for i, j, v in rows:
        a[i, j] += v
    got = out.first()
    assert got["within"] and np.isclose(got["norm2"], (a * a).sum(), atol=1e-3) and np.isclose(got["sigma1"], np.linalg.norm(a, 2), atol=1e-3)

    def kids(node):
        return [node.children().apply(k) for k in range(node.children().size())]

    def nested(node):
        below = kids(node)
        if node.nodeName() == "Join":
            while below and any(x.nodeName() in ("Project", "Filter") for x in below):
                below = [y for x in below for y in (kids(x) if x.nodeName() in ("Project", "Filter") else [x])]
            if any(x.nodeName() == "Join" for x in below):
                return True
        return any(map(nested, kids(node)))

    assert not nested(out._jdf.queryExecution().optimizedPlan())
