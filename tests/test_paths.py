"""Levels and transitive reduction against plain dynamic programming."""

import random

import pytest

from tessera.operators import paths as P


def plain(edges, nodes):
    far = {n: {n: 0} for n in nodes}
    for u in sorted(nodes, reverse=True):
        for a, b in edges:
            if a == u:
                for x, d in far[b].items():
                    far[u][x] = max(far[u].get(x, 0), d + 1)
    return {n: max(far[m].get(n, 0) for m in nodes) for n in nodes}, {(u, v) for u, v in edges if far[u][v] == 1}


@pytest.mark.parametrize("leaf, reach, n", [(4, 3, 60), (4, 70, 90), (64, 9, 150), (1, 5, 20)])
def test_levels_and_reduction(spark, monkeypatch, leaf, reach, n):
    monkeypatch.setattr(P, "LEAF", leaf)
    rng = random.Random(leaf * reach)
    nodes = [7 + 3 * k for k in range(n)]
    edges = sorted({(nodes[a], nodes[b]) for a in range(n) for b in [a + 1 + rng.randrange(reach) for _ in range(2)] if b < n and rng.random() < 0.8})
    df = spark.createDataFrame([(u, v, 1) for u, v in edges], "inst_from long, inst_to long, dep int")
    insts = spark.createDataFrame([(x,) for x in [*nodes, 1, 99_999]], "inst long")
    level, kept = plain(edges, nodes)
    assert {r["inst"]: r["level"] for r in P.levels(df, insts).collect()} == level | {1: 0, 99_999: 0}
    got = P.reduced(df)
    assert got.columns == df.columns and {(r[0], r[1]) for r in got.collect()} == kept


def test_nothing_and_backwards(spark):
    none = spark.createDataFrame([], "inst_from long, inst_to long")
    assert P.reduced(none).count() == 0
    assert P.levels(none, spark.createDataFrame([(4,)], "inst long")).collect() == [(4, 0)]
    with pytest.raises(ValueError):
        P.reduced(spark.createDataFrame([(2, 1)], "inst_from long, inst_to long"))
