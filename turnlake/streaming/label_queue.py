"""The label queue as a stream: requests, their attempts, retries by timer, and labels (OP-92, OP-93).

Two inputs meet in one state for each turn: the turns themselves and the results of labeling, which land in a table. The
state holds how often a turn was tried and when it may be tried again; a request goes out when a turn comes, or when the time of its next try has
come. Each run takes a bounded number of files, labels what is due with a bounded number of calls at once, and writes results as files
of its batch: a batch that runs again writes them anew, and a result that comes twice counts once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnlake.operators.labeling import MAX_ATTEMPTS

KEY = ["device", "tool", "external_id", "seq"]
KEYS = "device string, tool string, external_id string, seq bigint"
FACETS = ["intent", "domain", "depth", "delegation", "delegate_tool", "confidence"]
KINDS = {"depth": "bigint", "confidence": "double"}
RESULTS = f"{KEYS}, attempt int, " + ", ".join(f"{f} {KINDS.get(f, 'string')}" for f in FACETS) + ", last_error string"
REQUESTS = f"{KEYS}, attempt int, request string, status string, last_error string"
REQUEST = Row(*[c.split()[0] for c in REQUESTS.split(", ")])
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"  # as the session has it when a query starts
RETRY_MS = 60_000  # before the second try; doubles with each further one
CALLS, DEADLINE_S, TRIES, BACKOFF_S = 8, 90.0, 3, 0.5


# --- calls -----------------------------------------------------------------------------------------------------------


class Transient(Exception):
    """A labeler raises it for a failure that may pass at once: the call is tried again before its deadline."""


def attempt(labeler: Callable[[str], dict], text: str, until: float, tries: int, backoff_s: float) -> dict:
    for n in range(tries):
        try:
            return labeler(text)
        except Transient:
            pause = backoff_s * 2**n
            if n + 1 == tries or time.monotonic() + pause >= until:
                raise
            time.sleep(pause)
    raise Transient("no try allowed")


def call_all(labeler: Callable[[str], dict], texts: list[str], calls: int = CALLS, deadline_s: float = DEADLINE_S, tries: int = TRIES, backoff_s: float = BACKOFF_S) -> list[dict | str]:
    """The labeler's answer for each text, or why there is none; at most `calls` at once, each with its own deadline.

    A call that outlives its deadline gives a failure at once and its thread is left to end by itself; its place goes to a new
    thread, so that calls that hang don't hold up the others.
    """
    out: list[dict | str] = ["not called"] * len(texts)
    running: dict[Future, tuple[int, float]] = {}
    todo = iter(range(len(texts)))

    def begin() -> bool:
        for k in todo:
            done: Future = Future()
            until = time.monotonic() + deadline_s

            def work(k: int = k, done: Future = done, until: float = until) -> None:
                try:
                    done.set_result(attempt(labeler, texts[k], until, tries, backoff_s))
                except BaseException as e:  # noqa: BLE001  a labeler's failure is a row, never the job's
                    done.set_exception(e)

            threading.Thread(target=work, daemon=True).start()
            running[done] = (k, until)
            return True
        return False

    while (len(running) < calls and begin()) or running:
        if len(running) < calls and begin():
            continue
        wait(running, timeout=max(0.0, min(u for _, u in running.values()) - time.monotonic()), return_when=FIRST_COMPLETED)
        for done, (k, until) in list(running.items()):
            if done.done():
                error = done.exception()
                out[k] = done.result() if error is None else f"{type(error).__name__}: {error}"
            elif time.monotonic() >= until:
                out[k] = f"timeout: no answer in {deadline_s:g} s"
            else:
                continue
            del running[done]
    return out


def labeled(requests: DataFrame, labeler: Callable[[str], dict], **limits: float) -> DataFrame:
    """Results of requests (KEY, attempt, request): facets, or last_error (OP-93). limits are those of call_all, for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = call_all(labeler, list(batch["request"]), **limits)
            out = batch[[*KEY, "attempt"]].copy()
            for f in FACETS:
                values = [x.get(f) if isinstance(x, dict) else None for x in found]
                out[f] = pd.Series(values, index=batch.index, dtype={"depth": "Int64", "confidence": "Float64"}.get(f, object))
            out["last_error"] = pd.Series([None if isinstance(x, dict) else x for x in found], index=batch.index, dtype=object)
            yield out

    return requests.mapInPandas(run, RESULTS)


# --- the queue --------------------------------------------------------------------------------------------------------


class Attempts(StatefulProcessor):
    """What is known of one turn: its request, how many tries failed, which try is out, when the next one is due.

    It works on rows: a frame for each turn's one or two rows would take most of the time.
    """

    def __init__(self, retry_ms: int, most: int):
        self.retry_ms, self.most = retry_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "request string, failed int, open int, over boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() or (None, 0, 0, False)
        request, failed, out, over = held
        for r in sorted(rows, key=lambda r: r.attempt):
            if r.attempt == 0:  # the turn itself; only its first coming counts
                if request is None and not over:
                    request, out = r.request, 1
                    yield REQUEST(*key, 1, request, "request", None)
            elif r.attempt == out and not over:  # the answer that is waited for, once
                out = 0
                if r.last_error is None:
                    over = True
                elif (failed := failed + 1) >= self.most:
                    over = True
                    yield REQUEST(*key, failed, None, "retired", r.last_error)
                else:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms * 2 ** (failed - 1))
        if (now := (None if over else request, failed, out, over)) != tuple(held):
            self.state.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        request, failed, out, over = self.state.get()
        if not over and not out and request is not None:
            self.state.update((request, failed, failed + 1, False))
            yield REQUEST(*key, failed + 1, request, "request", None)

    def close(self) -> None:
        pass


def run_queue(spark: SparkSession, turns: DataFrame, results: str, retired: str, checkpoint: str, labeler: Callable[[str], dict], retry_ms: int = RETRY_MS, most: int = MAX_ATTEMPTS, tasks: int = 8, **limits: float) -> StreamingQuery:
    """Start one run over what has come: turns is a stream with KEY and request; results and retired are folders of Parquet files.

    turns bounds a batch (maxFilesPerTrigger). Labels are the rows of `results` without last_error; a turn whose tries failed
    `most` times is a row of `retired`, and a failure stays a row of `results`. A retry that is due goes out in the next run. Null requests count as
    empty. The session must use the RocksDB state store.
    """
    # the folder must be there to be a stream, and a new file makes a batch in which timers are looked at
    spark.createDataFrame([], RESULTS).write.mode("append").parquet(results)
    come = turns.select(*KEY, F.lit(0).alias("attempt"), F.coalesce("request", F.lit("")).alias("request"), F.lit(None).cast("string").alias("last_error"))
    answers = spark.readStream.schema(RESULTS).option("recursiveFileLookup", "true").parquet(results)
    both = come.unionByName(answers.select(*KEY, "attempt", F.lit(None).cast("string").alias("request"), "last_error"))
    out = both.groupBy(*KEY).transformWithState(Attempts(retry_ms, most), outputStructType=REQUESTS, outputMode="Append", timeMode="ProcessingTime")

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()  # one pass over the state
        try:
            due = batch.where("status = 'request'").repartition(tasks)
            labeled(due, labeler, **limits).write.mode("overwrite").parquet(f"{results}/batch={number}")
            batch.where("status = 'retired'").select(*KEY, "attempt", "last_error").write.mode("overwrite").parquet(f"{retired}/batch={number}")
        finally:
            batch.unpersist()

    # a run would make batches without rows for ever, one after the other, as long as there is state
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, "false")
    try:
        return out.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(IDLE_BATCHES, before)
