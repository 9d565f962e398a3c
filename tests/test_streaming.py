import pytest
from pyspark.sql import functions as F

from turnlake.operators import dedupe, rollups
from turnlake.sources import store
from turnlake.streaming import ingest

TURNS = "device string, tool string, external_id string, arrived_ms bigint, i bigint, role string, redacted_text string, ts_ms bigint, model string"


def segments(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_session_state_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    first = [("d", "t", "s", 1, k, "user" if k % 2 else "assistant", f"x{k // 2}", k, None) for k in range(6)]
    later = [("d", "t", "s", 2, 0, "user", "x2", 9, "m"), ("d", "t", "s", 2, 1, "user", "new", 10, "m"), ("d", "t", "s", 2, 2, "user", "new", 11, None)]
    q = run(ingest.numbered_turns(segments(spark, tmp_path, [first, later], TURNS)), "numbered")
    assert not q.isActive  # it has ended by itself
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    rows = spark.table("numbered").orderBy("seq").collect()
    q.stop()
    none = F.lit(None).cast("string")
    batch = spark.createDataFrame(first + later, TURNS).withColumns({"existing": F.lit(0).cast("long"), "last_role": none, "last_text": none, "pos": F.struct("arrived_ms", "i")})
    expected = dedupe.without_repeats(batch).orderBy("seq").collect()
    assert [(r.seq, r.role, r.redacted_text) for r in rows] == [(r.seq, r.role, r.redacted_text) for r in expected]


def test_bursts_equal_engaged_time(spark, tmp_path):
    schema = "device string, tool string, external_id string, seq bigint, ts_ms bigint"
    rows = [("d", "t", "s", k, ms) for k, ms in enumerate((0, 600_000, 2_400_000, 9_000_000, 9_060_000))] + [("d", "t", "end", 0, 900_000_000_000)]
    run(ingest.engaged_bursts(segments(spark, tmp_path, [rows[:2], rows[2:]], schema)), "bursts").stop()
    total = spark.table("bursts").where("external_id = 's'").agg(F.sum("active_ms")).first()[0]
    assert total == rollups.engaged(spark.createDataFrame(rows, schema)).where("external_id = 's'").first().active_ms


ACTION = "device string, source string, ext_id string, tool string, ts_ms bigint"


def test_actions_are_stored_once(spark, tmp_path):
    rows = [[("d", "s", "1", "connector", 1), ("d", "s", "1", "shortcut", 2)], [("d", "s", "1", "connector", 1), ("d", "s", "2", "connector", 3)]]
    q = ingest.store_actions(segments(spark, tmp_path, rows, ACTION), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(240)
    assert sorted((r.ext_id, r.tool) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "connector"), ("2", "connector")]


def test_counters(spark, tmp_path):
    rows = [[("d", "s", "1", "connector", 1_000), ("d", "s", "2", "shortcut", 3_500_000)], [("d", "s", "3", "connector", 3_700_000), ("d", "s", "9", "x", 900_000_000)]]
    run(ingest.activity_counters(segments(spark, tmp_path, rows, ACTION)), "counters").stop()
    got = {r.start_ms: (r.actions, r.connectors, r.shortcuts) for r in spark.table("counters").collect()}
    assert got[0] == (2, 1, 1) and got[3_600_000] == (1, 1, 0)


def test_pushes(spark, tmp_path):
    schema = "kind string, device string, person string, day string, tool string, driven_tool string, name string, detail string, hour bigint, provider string, surface string, model string, intent string, domain string, depth bigint, delegation string, delegate_tool string, sessions bigint, received_ms bigint"
    row = lambda device, tool, n, day="2026-01-06": ("session_span", device, "p", day, tool, None, None, None, None, None, None, None, None, None, None, None, None, n, n)
    parts = [[row("a", "x", 1), row("a", "y", 1), row("b", "x", 1)], [row("a", "x", 2, "2025-01-07")]]
    q = ingest.ingest_pushes(segments(spark, tmp_path, parts, schema), str(tmp_path / "store"), str(tmp_path / "cp"), str(tmp_path / "weeks"))
    q.awaitTermination(240)
    q.exception() and pytest.fail(str(q.exception()))
    assert sorted((r.device, r.tool, r.day) for r in store.SnapshotStore(spark, str(tmp_path / "store")).rows().collect()) == [("a", "x", "2025-01-07"), ("b", "x", "2026-01-06")]


def test_drain_queue(spark):
    left = [["a", "b"], ["c"], []]
    seen = []
    batches = iter(left)
    n = ingest.drain_queue(lambda: spark.createDataFrame([(x,) for x in next(batches)], "r string"), lambda df: df.withColumn("last_error", F.lit(None).cast("string")), lambda df: seen.append(df.count()))
    assert (n, seen) == (2, [2, 1])
