"""Jacobi SVD by a tournament of column blocks."""

import numpy as np
import pytest

from tessera.operators import tournament as T


@pytest.mark.parametrize("blocks", [2, 4, 6, 10])
def test_every_pair_meets_once(blocks):
    met = set()
    for turn in range(blocks - 1):
        of = T.partners(blocks, turn)
        pairs = {p: [x for x in range(blocks) if of[x] == p] for p in of}
        assert all(len(v) == 2 for v in pairs.values())
        met |= {tuple(v) for v in pairs.values()}
    assert len(met) == blocks * (blocks - 1) // 2


@pytest.mark.parametrize("m, n, width", [(9, 14, 3), (12, 5, 2), (4, 30, 8)])
def test_singular_values(spark, m, n, width):
    rng = np.random.default_rng(n)
    held = {k: rng.standard_normal((m, n)) * 10.0 ** (3 * k - 3) for k in range(3)}
    held[3] = np.outer(rng.standard_normal(m), rng.standard_normal(n))
    cells = spark.createDataFrame([(k, i, j, float(a[i, j])) for k, a in held.items() for i in range(m) for j in range(n)], "key long, i long, j long, v double")
    got = T.singular_values(cells, "key", m, n, width).orderBy("key", "j").collect()
    for k, a in held.items():
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose([r["v"] for r in got if r["key"] == k], want, rtol=1e-9, atol=1e-12 * want[0])
    blocks = T.orthogonal_columns(cells, "key", m, n, width).where("key = 1").orderBy("block").collect()
    us, v = (np.hstack([np.frombuffer(b[c], float).reshape(rows, -1) for b in blocks]) for c, rows in (("us", m), ("v", n)))
    assert np.allclose(us @ v.T, held[1]) and np.allclose(v.T @ v, np.eye(n))
