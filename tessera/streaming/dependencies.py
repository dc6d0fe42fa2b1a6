"""The dependency table as the state of a stream of changes.

A change (inst_from, inst_to, dep, seq) puts a pair in, or deletes it if dep is 0. The state of a pair is what
`deps.replayed` makes of its changes so far: the last one decides, and a pair that was deleted and put in again has
the place of the first change after that. Changes may come in any order and any batches: a deletion leaves a tombstone, so
that older changes that come later have no effect, and the places since the last deletion are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

UPDATES = "inst_from bigint, inst_to bigint, dep int, seq bigint, version bigint"


class _Pair(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pair = handle.getValueState("pair", "gone long, last long, dep int, version long")
        self.places = handle.getListState("places", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gone, last, dep, version = self.pair.get() if self.pair.exists() else (-(2**63), -(2**63), 0, 0)
        places = [r[0] for r in self.places.get()] if self.places.exists() else []
        before = (dep, min(places, default=None))
        for pdf in rows:
            for d, seq in zip(pdf["dep"].tolist(), pdf["seq"].tolist(), strict=True):
                if seq > last:
                    last, dep = seq, d
                if d == 0:
                    gone = max(gone, seq)
                else:
                    places.append(seq)
        places = [s for s in places if s > gone]
        now = (dep, min(places, default=None))
        changed = now != before
        version += changed
        self.pair.update((gone, last, dep, version))
        if places:
            self.places.put([(s,) for s in places])
        elif self.places.exists():
            self.places.clear()
        held = [[int(key[0]), int(key[1]), dep, now[1], version]] if changed else []
        yield pd.DataFrame(held, columns=["inst_from", "inst_to", "dep", "seq", "version"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def dependency_updates(changes: DataFrame) -> DataFrame:
    """(inst_from, inst_to, dep, seq, version): each new state of a pair, dep 0 if it is gone. For a stream, in update mode.

    State is kept by pair, so a hot instruction is many keys. The session's state store must be RocksDB.
    """
    return changes.groupBy("inst_from", "inst_to").transformWithStateInPandas(statefulProcessor=_Pair(), outputStructType=UPDATES, outputMode="Update", timeMode="None")


def latest(updates: DataFrame) -> DataFrame:
    """(inst_from, inst_to, dep, seq) of the pairs that are in the table after all updates."""
    last = updates.groupBy("inst_from", "inst_to").agg(F.max_by(F.struct("dep", "seq"), "version").alias("s"))
    return last.select("inst_from", "inst_to", "s.dep", "s.seq").where("dep <> 0")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(source: str, schema, folder: str, spark, files_a_batch: int = 1) -> DataFrame:
    """Process all changes of a folder of Parquet files and return the table; updates and state go to `folder`."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        # a batch that runs again overwrites its own folder, so that no update counts twice
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}")
        q = dependency_updates(changes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return latest(spark.read.schema(UPDATES).parquet(f"{folder}/updates"))
