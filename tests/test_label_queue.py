"""The label queue as a stream, and calls with deadlines."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row

from turnlake.sources.file_index import FileIndex, listing
from turnlake.streaming import ingest, label_queue

TURNS = f"{label_queue.KEYS}, request string"
GOOD = {"intent": "write_code", "domain": "software", "depth": 2, "delegation": "none", "delegate_tool": "none", "confidence": 0.5}


def test_calls_have_deadlines_and_retries():
    seen = {}

    def labeler(text):
        seen[text] = seen.get(text, 0) + 1
        if text == "hangs":
            time.sleep(30)
        if text == "passes" and seen[text] < 3 or text == "stays":
            raise label_queue.Transient(text)
        if text == "fails":
            raise ValueError("no")
        time.sleep(0.05)
        return {"intent": text}

    began = time.monotonic()
    texts = ["hangs", "passes", "stays", "fails", "hangs", *[f"t{k}" for k in range(40)]]
    out = label_queue.call_all(labeler, texts, calls=4, deadline_s=1.0, tries=3, backoff_s=0.01)
    assert time.monotonic() - began < 8
    assert out[:5] == ["timeout: no answer in 1 s", {"intent": "passes"}, "Transient: stays", "ValueError: no", "timeout: no answer in 1 s"]
    assert out[5:] == [{"intent": t} for t in texts[5:]] and seen["stays"] == 3 and seen["fails"] == 1
    assert label_queue.call_all(labeler, []) == []


def test_a_turn_reads_and_writes_its_state_once():
    """A turn's rows come and go as rows, without a frame for each turn."""
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("timer")

    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: 5})()
    attempts, row = label_queue.Attempts(0, 2), Row("attempt", "request", "last_error")
    attempts.init(Handle())
    come = lambda *rows: [tuple(r) for r in attempts.handleInputRows(("d", "t", "e", 0), iter(rows), now)]
    assert come(row(0, "text", None)) == [("d", "t", "e", 0, 1, "text", "request", None)] and calls == ["get", "update"]
    assert come(row(0, "text", None)) == [] and calls[2:] == ["get"]  # again: nothing to write
    assert come(row(1, None, "no")) == [] and calls[3:] == ["get", "timer", "update"]
    assert [tuple(r) for r in attempts.handleExpiredTimer(("d", "t", "e", 0), now, None)] == [("d", "t", "e", 0, 2, "text", "request", None)]
    assert come(row(2, None, "no")) == [("d", "t", "e", 0, 2, None, "retired", "no")] and attempts.state.held == (None, 2, 0, True)


def flaky(text):
    if text == "bad":
        raise ValueError("cannot")
    return GOOD


@pytest.fixture
def queue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    paths = {k: str(tmp_path / k) for k in ("turns", "results", "retired", "cp")}

    def come(*requests):
        spark.createDataFrame([("d", "t", r, 0, r) for r in requests], TURNS).coalesce(1).write.mode("append").parquet(paths["turns"])

    def drain(labeler=flaky, retry_ms=0):
        turns = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(paths["turns"])
        q = label_queue.run_queue(spark, turns, paths["results"], paths["retired"], paths["cp"], labeler, retry_ms=retry_ms, tasks=2, deadline_s=5.0)
        try:
            assert q.awaitTermination(120)
        except StreamingQueryException as e:
            return e
        return None

    def rows(what):
        schema = label_queue.RESULTS if what == "results" else f"{label_queue.KEYS}, attempt int, last_error string"
        return sorted((r.external_id, r.attempt, r.last_error) for r in spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(paths[what]).collect())

    return come, drain, rows


def test_failures_are_counted_over_runs_and_retire_a_turn(queue):
    come, drain, rows = queue
    come("a", "bad")
    come("b", "a")  # a turn that comes again is asked once
    runs = 0
    while not (done := drain()) and runs < 12 and not rows("retired"):
        runs += 1
    assert done is None
    results = rows("results")
    assert [r for r in results if r[2] is None] == [("a", 1, None), ("b", 1, None)]
    assert [r for r in results if r[0] == "bad"] == [("bad", k, "ValueError: cannot") for k in range(1, 6)]
    assert rows("retired") == [("bad", 5, "ValueError: cannot")]
    drain()
    assert rows("results") == results  # nothing is asked again


def test_a_killed_run_loses_no_attempt(queue, spark):
    come, drain, rows = queue

    class Stop(Exception):
        pass

    come("bad", "ok")
    real, calls = label_queue.labeled, []

    def dying(requests, labeler, **limits):
        out = real(requests, labeler, **limits)
        calls.append(1)
        if len(calls) == 1:
            raise Stop("killed before its results are written")
        return out

    label_queue.labeled = dying
    try:
        assert drain() is not None
        for _ in range(10):
            assert drain() is None
            if rows("retired"):
                break
    finally:
        label_queue.labeled = real
    assert rows("retired") == [("bad", 5, "ValueError: cannot")]
    assert [r[1] for r in rows("results") if r[0] == "bad"] == [1, 2, 3, 4, 5] and ("ok", 1, None) in rows("results")


def test_a_retry_waits_for_its_time(queue):
    come, drain, rows = queue
    come("bad")
    drain(retry_ms=3_600_000)
    drain(retry_ms=3_600_000)
    assert [r[1] for r in rows("results")] == [1]


def test_file_index_over_growing_files(spark, tmp_path):
    folder, index = tmp_path / "files", FileIndex(spark, str(tmp_path / "index"))
    folder.mkdir()
    (folder / "a.jsonl").write_text("x" * 10)
    (folder / "b.jsonl").write_text("y" * 10)
    (folder / "c.txt").write_text("z")
    now = int(time.time() * 1000)
    names = lambda df: sorted(r.file.rsplit("/", 1)[1] for r in df.collect())
    look = lambda at, **how: names(index.changed(listing(spark, str(folder), "*.jsonl"), at, **how))
    assert look(now) == ["a.jsonl", "b.jsonl"] and look(now, since_ms=now + 10_000_000) == []
    index.parsed(listing(spark, str(folder), "*.jsonl"), now)
    assert look(now + 1) == []
    (folder / "a.jsonl").write_text("x" * 11)
    (folder / "d.jsonl").write_text("new")
    assert look(now + 1000) == ["d.jsonl"]  # a has changed, but was parsed a second ago
    assert look(now + 30_000) == look(now + 1, cooldown_ms=0) == ["a.jsonl", "d.jsonl"]
    (folder / "a.jsonl").write_bytes(b"x" * 256 * 40_000)
    assert look(now + 30_000) == ["d.jsonl"] and look(now + 40_000) == ["a.jsonl", "d.jsonl"]  # the larger, the longer
    index.parsed(index.changed(listing(spark, str(folder), "*.jsonl"), now + 40_000), now + 40_000)
    assert look(now + 99_000) == [] and index.known().count() == 3 and index.versions.latest()[0] == 2
