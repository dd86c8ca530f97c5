"""Streams that read what is there and stop, and their results as tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.drift import Watch, advance
from vigil.sources.stored import folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, each file once. The pattern stands for the path itself: a stream reads a single file only by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run to the end of what is there. append: all rows; complete: the last batch; update: the last row of each key."""
    spark = stream.sparkSession
    out, checkpoint = folder(spark, "out"), folder(spark, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.option("basePath", out).parquet(out)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


DRIFT_ROWS = "user_id long, event_id long, regime string, flag int, mmd2 double"


def _told(key: int, frame: pd.DataFrame, watch: Watch, epsilon: float, sizes: tuple[int, int, int]) -> tuple[pd.DataFrame, Watch]:
    frame = frame.sort_values(["at", "event_id"])
    regime, distance, watch = advance(watch, frame[["value"]].to_numpy(float), epsilon, *sizes)
    flag = np.array([r == "drift" for r in regime], "int32")
    return pd.DataFrame({"user_id": np.full(len(frame), key), "event_id": frame["event_id"].to_numpy(), "regime": regime, "flag": flag, "mmd2": np.round(distance, 6)}), watch


class DriftProcessor(StatefulProcessor):
    """The drift of one key's series. Rows of a batch are taken in order of time."""

    def __init__(self, epsilon: float, sizes: tuple[int, int, int] = (5, 5, 3)):
        self.epsilon, self.sizes = epsilon, sizes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch = handle.getValueState("watch", "ref array<double>, tail array<double>, seen long, age long")

    def handleInputRows(self, key, rows, timerValues):
        watch = Watch.new(1)
        if self.watch.exists():
            ref, tail, seen, age = self.watch.get()
            watch = Watch(np.array(ref, float).reshape(-1, 1), np.array(tail, float).reshape(-1, 1), seen, age)
        found, watch = _told(key[0], pd.concat(list(rows)), watch, self.epsilon, self.sizes)
        self.watch.update((watch.ref.ravel().tolist(), watch.tail.ravel().tolist(), watch.seen, watch.age))
        yield found

    def close(self) -> None:
        pass


def drift_batch(rows: DataFrame, epsilon: float, sizes: tuple[int, int, int] = (5, 5, 3)) -> DataFrame:
    """The same in one pass over each key's rows."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _told(key[0], frame, Watch.new(1), epsilon, sizes)[0]

    return rows.groupBy("user_id").applyInPandas(one, DRIFT_ROWS)
