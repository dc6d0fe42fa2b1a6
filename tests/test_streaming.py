"""The stream's cells equal those of the same events as a table."""

import random

import pytest

from tessera.operators import deps
from tessera.streaming import dependencies
from tessera.streaming.clocks import clock_cells


def test_clock_cells(spark, tmp_path):
    rows = [(f"w{i % 3}", f"2024-01-01 {i % 20:02d}:{i % 60:02d}:00") for i in range(200)]
    table = spark.createDataFrame(rows, "worker string, at string").selectExpr("worker", "cast(at as timestamp) as ts")
    table.write.parquet(f"{tmp_path}/in")
    stream = clock_cells(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), "worker", "ts")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("cells").collect()) == sorted(clock_cells(table, "worker", "ts").collect())


@pytest.mark.parametrize("batches", [1, 5])
def test_dependency_table_under_any_batching(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(rng.randrange(4), 10 + rng.randrange(4), rng.choice([0, 0, 1, 2, 5]), seq) for seq in range(160)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "inst_from long, inst_to long, dep int, seq long")
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = dependencies.run_stream(f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/out", spark)
    want = deps.replayed(df).select("inst_from", "inst_to", "dep", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "out" / "updates").glob("batch=*"))) == batches


def test_stream_of_changes_has_files_for_its_rows(spark, tmp_path, monkeypatch):
    from tessera.plans import registry

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(registry, "FILE_CHANGES", 500)
    monkeypatch.setattr(registry.M, "shared_folder", lambda *_: f"file://{tmp_path}/stream")
    got = registry.dep_stream(spark, sf)
    want = deps.replayed(registry.all_changes(spark, sf)).select("inst_from", "inst_to", "dep", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "stream" / "changes").glob("*.parquet"))) == 12
    assert len(list((tmp_path / "stream" / "updates").glob("batch=*"))) == 4
