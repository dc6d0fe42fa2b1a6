"""Regions, dependencies, task graphs and schedules."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import deps
from tessera.plans import schedule, tasks

REGION = "ptr long, pitch long, width long, height long"


def touched(ptr, pitch, width, height):
    return {ptr + r * pitch + b for r in range(height) for b in range(width)}


def test_overlap_against_bytes(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        w = rng.randint(1, 16)
        rows.append((n, rng.randint(0, 1999), w + rng.randint(0, 15), w, rng.randint(1, 16)))
    got = {tuple(r) for r in deps.overlapping(spark.createDataFrame(rows, "id long, " + REGION), "id").collect()}
    held = {r[0]: touched(*r[1:]) for r in rows}
    assert got == {(a, b) for a in held for b in held if a < b and held[a] & held[b]}


def test_overlap_edges(spark):
    rows = [(0, 0, 10, 4, 3), (1, 4, 10, 6, 3), (2, 3, 1, 1, 1), (3, 24, 4, 4, 1)]
    got = {tuple(r) for r in deps.overlapping(spark.createDataFrame(rows, "id long, " + REGION), "id").collect()}
    assert got == {(0, 2), (1, 3)}
    with pytest.raises(Exception, match="1 <= width <= pitch"):
        deps.spans(spark.createDataFrame([(0, 3, 4, 1)], REGION)).collect()


def test_classes(spark):
    r = (0, 4, 4, 1)
    rows = [(0, True, *r), (1, False, *r), (2, True, *r), (3, False, *r)]
    got = {tuple(x) for x in deps.classify(spark.createDataFrame(rows, "inst long, is_read boolean, " + REGION)).collect()}
    assert got == {(0, 1, 2), (1, 2, 1), (2, 3, 2), (0, 3, 2), (1, 3, 4)}


@pytest.mark.parametrize(("t", "n", "edges", "flow", "out", "depth"), [(2, 5, 5, 4, 1, 4), (3, 14, 26, 20, 6, 7), (4, 30, 80, 60, 20, 10), (8, 204, 1176, 840, 336, 22)])
def test_lu_graph(spark, t, n, edges, flow, out, depth):
    task, e = tasks.lu_tasks(spark, t), tasks.dag_edges(spark, t)
    assert sorted(r[0] for r in task.select("inst").collect()) == list(range(n))
    kinds = [r[0] for r in e.select("dep").collect()]
    assert (len(kinds), kinds.count(1), kinds.count(4)) == (edges, flow, out)
    if t <= 4:
        assert tasks.levels(e, task).agg({"level": "max"}).first()[0] + 1 == depth


def replay(plan, flops, edges, workers):
    """Whether program order and waits alone satisfy every dependency."""
    lists = [[p for p in plan if p[0] == w] for w in range(workers)]
    at, done = [0] * workers, {}
    knows = [set() for _ in range(workers)]
    while any(at[w] < len(lists[w]) for w in range(workers)):
        moved = False
        for w in range(workers):
            if at[w] < len(lists[w]):
                _, inst, is_exec, _ = lists[w][at[w]]
                if is_exec:
                    assert {a for a, b in edges if b == inst} <= knows[w]
                    knows[w].add(inst)
                    done[inst] = set(knows[w])
                elif inst in done:
                    knows[w] |= done[inst]
                else:
                    continue
                at[w] += 1
                moved = True
        assert moved, "deadlock"
    return len(done) == len(flops)


@pytest.mark.parametrize(("t", "workers", "want", "waits"), [(3, 1, [54], 0.0), (3, 2, [33, 25], 0.429), (4, 2, [69, 61], 0.433), (8, 4, [255, 255, 270, 262], 0.843)])
def test_schedule(spark, t, workers, want, waits):
    flops = {r["inst"]: r["flops"] for r in tasks.lu_tasks(spark, t).collect()}
    edges = [(r[0], r[1]) for r in tasks.dag_edges(spark, t).select("inst_from", "inst_to").collect()]
    plan = schedule.plan(flops, edges, workers)
    load = [max(s + flops[i] for w, i, x, s in plan if x and w == k) for k in range(workers)]
    assert load == want
    assert round(sum(not x for _, _, x, _ in plan) / len(flops), 3) == waits
    assert replay(plan, flops, edges, workers)


def test_random_schedules():
    rng = random.Random(2)
    for _ in range(200):
        n, workers = rng.randint(1, 25), rng.randint(1, 4)
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.2]
        flops = {v: rng.randint(0, 9) for v in range(n)}
        plan = schedule.plan(flops, edges, workers)
        assert sorted(i for _, i, x, _ in plan if x) == list(range(n))
        assert replay(plan, flops, edges, workers)


def test_slices(spark):
    t = tasks.lu_tasks(spark, 3)
    assert {r[0] for r in tasks.batch_slices(t, 5).select("slice").collect()} == {0, 1, 2}
    assert {r[0] for r in tasks.batch_slices(t, 0).select("slice").collect()} == {0}


def test_regions_meet_by_bytes():
    import numpy as np

    rng = random.Random(1)

    def region():
        pitch = rng.randint(1, 30)
        return rng.randint(0, 200), pitch, rng.randint(1, pitch), rng.randint(1, 12)

    a, b = ([region() for _ in range(20_000)] for _ in "ab")
    held = lambda r: {r[0] + k * r[1] + x for k in range(r[3]) for x in range(r[2])}
    assert deps.regions_meet(*np.array(a).T, *np.array(b).T).tolist() == [bool(held(x) & held(y)) for x, y in zip(a, b, strict=True)]


def test_regions_of_a_billion_rows():
    rng = random.Random(2)
    for _ in range(500):
        pitch, tall = rng.randint(10, 10_000), 10**9
        a, b = ((rng.randint(0, 10**6), pitch, rng.randint(1, pitch), tall) for _ in "ab")
        d = (b[0] - a[0]) % pitch
        assert deps.regions_meet(*[[x] for x in a], *[[x] for x in b])[0] == (d < a[2] or d + b[2] > pitch)


def test_chosen_scales():
    assert deps.chosen_scales({3: 1000}, 1e6) == [3]
    assert deps.chosen_scales({3: 10, 4: 10, 5: 10}, 1e9) == [5]
    assert deps.chosen_scales({3: 10**7, 30: 10}, 1e12) == [3, 30]


def test_interval_join_has_tasks_for_its_rows(spark, monkeypatch):
    rows = [(k, 7 * k, 20, 5 + k % 11, 1 + k % 3) for k in range(400)]
    regions = spark.createDataFrame(rows, "id long, ptr long, pitch long, width long, height long")
    held = {r[0]: {r[1] + y * r[2] + x for y in range(r[4]) for x in range(r[3])} for r in rows}
    want = {(a, b) for a in held for b in range(a + 1, min(400, a + 20)) if held[a] & held[b]}
    monkeypatch.setattr(deps, "TASK_ROWS", 100)
    r = deps.spans(regions, "id")
    tasks = deps.interval_join(r, r).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(p) for p in deps.overlapping(regions, "id").collect()} == want
