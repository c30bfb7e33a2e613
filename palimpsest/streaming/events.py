"""Structured Streaming over the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STORE = "spark.sql.streaming.stateStore.providerClass"
TERMINAL = ("COMPLETED", "FAILED", "FAILED_QUALITY")


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by type; events later than ``late`` behind the newest are dropped."""
    window = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class _Changes(StatefulProcessor):
    """Holds the last type of a key; rows of a micro-batch are taken in the order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = frame["event_type"].shift()
        if self.last.exists():
            before.iloc[0] = self.last.get()[0]
        self.last.update((frame["event_type"].iloc[-1],))
        yield frame.loc[frame["event_type"].ne(before), ["user_id", "event_id", "event_type"]]

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """A row for each event whose type differs from the key's last one: the trace stream as keyed state.

    Events that come in a later micro-batch count as later, as in a log that is
    read while it grows.
    """
    return events.groupBy("user_id").transformWithStateInPandas(_Changes(), "user_id long, event_id long, event_type string", "append", "none")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now and return it as a table of Parquet files below ``folder``, which executors share.

    In ``complete`` mode every micro-batch replaces the table.
    """
    spark = stream.sparkSession
    path, schema = f"{folder}/rows", stream.schema
    # Keyed state of several variables needs this store; it is read when a query starts.
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
