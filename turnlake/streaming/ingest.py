"""Streams: session state of chats, action dedupe, engaged bursts, activity counters, snapshot pushes, the label queue.

Devices land immutable segments: Spark's file source never reads a changed file again. Each function takes a streaming
DataFrame (or makes one) and gives a streaming DataFrame, or takes one and starts a query; a batch of the same rows gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnlake.operators import dedupe
from turnlake.sources import sinks, store

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "device string, tool string, external_id string, seq bigint, role string, redacted_text string, ts_ms bigint, model string"


class SessionState(StatefulProcessor):
    """Numbers a session's turns on from what came before and drops a turn equal to the last kept one; holds a hash, not the text."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "next bigint, last string, model string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else (0, "", None)
        n, last, model = held
        turns = pd.concat(list(rows), ignore_index=True).sort_values(["arrived_ms", "i"], kind="stable")
        out = []
        for r in turns.itertuples():
            model = model if model is not None else (None if pd.isna(r.model) else r.model)
            mark = hashlib.sha256(f"{r.role}\u0001{r.redacted_text}".encode()).hexdigest()
            if mark != last:
                out.append((*key, n, r.role, r.redacted_text, r.ts_ms, model))
                n, last = n + 1, mark
        self.state.update((int(n), last, model))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NUMBERED.split(", ")])

    def close(self) -> None:
        pass


def numbered_turns(turns: DataFrame, idle_days: int = 90) -> DataFrame:
    """Turns of a stream of web or transcript segments, numbered and without repeats (OP-87, OP-57).

    turns has device, tool, external_id, arrived_ms, i, role, redacted_text, ts_ms, model. The session must use STATE_STORE; where
    a run is to end once all is read, it must have spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    keys = turns.groupBy("device", "tool", "external_id")
    return keys.transformWithStateInPandas(SessionState(idle_days * 86_400_000), outputStructType=NUMBERED, outputMode="Append", timeMode="ProcessingTime")


def deduplicated_actions(actions: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of actions without those whose key came within the delay (OP-88)."""
    timed = actions.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["device", "source", "ext_id"]).drop("ts")


def store_actions(actions: DataFrame, path: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Append to a table only actions that it doesn't hold, however late they come (OP-88, exact).

    The table is partitioned by a bucket of the key, and a batch reads the keys of its own buckets only.
    """
    key = ["device", "source", "ext_id"]

    def add(batch: DataFrame, _: int) -> None:
        fresh = dedupe.first_wins(batch, key, F.col("ts_ms")).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        if table_exists(batch.sparkSession, path):
            mine = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
            held = batch.sparkSession.read.parquet(path).where(F.col("bucket").isin(mine)).select("bucket", *key)
            fresh = fresh.join(held, ["bucket", *key], "left_anti")
        fresh.write.mode("append").partitionBy("bucket").parquet(path)

    return actions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def engaged_bursts(turns: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    """Engaged milliseconds of each burst of a session: last turn minus first, bursts parted by more than the gap (OP-89)."""
    timed = turns.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    bursts = timed.groupBy("device", "tool", "external_id", F.session_window("ts", gap).alias("w"))
    sums = bursts.agg((F.max("ts_ms") - F.min("ts_ms")).alias("active_ms"), F.count("*").alias("turns"))
    return sums.select("device", "tool", "external_id", F.unix_millis("w.start").alias("start_ms"), "active_ms", "turns")


def activity_counters(actions: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Actions, connectors and shortcuts by device and window (OP-90)."""
    timed = actions.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    sums = timed.groupBy("device", F.window("ts", width).alias("w")).agg(F.count("*").alias("actions"), F.count_if(F.col("tool") == "connector").alias("connectors"), F.count_if(F.col("tool") == "shortcut").alias("shortcuts"))
    return sums.select("device", F.unix_millis("w.start").alias("start_ms"), "actions", "connectors", "shortcuts")


def ingest_pushes(pushes: DataFrame, path: str, checkpoint: str, archive: str | None = None) -> StreamingQuery:
    """Apply each batch of fact rows to the store as snapshots of its devices, and rewrite the weeks that it changes (OP-91).

    No watermark: rows for past weeks are always taken. A batch that is run again after a failure is applied once; the weeks of
    the archive are rewritten from their own rows in the store, not from a scan of all.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        held = store.SnapshotStore(batch.sparkSession, path)
        done = held.apply(batch, source=checkpoint, batch=number)
        for week in done["weeks"] if archive else ():
            rows = held.rows(weeks=[week])
            if week != store.NO_WEEK:
                sinks.archive_week(batch.limit(0) if rows is None else rows, week, archive)

    return pushes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_queue(batch_of: Callable[[], DataFrame], label: Callable[[DataFrame], DataFrame], persist: Callable[[DataFrame], None]) -> int:
    """Label bounded batches until the queue is empty or a batch labels nothing; how many batches ran (OP-92).

    batch_of gives the next requests (failures already count against them), label their results with last_error.
    """
    n = 0
    while not (requests := batch_of()).isEmpty():
        results = label(requests)
        persist(results)
        n += 1
        if results.where("last_error IS NULL").isEmpty():
            break
    return n
