"""The store of fact rows: versions, runs that die between any two steps, writers at the same time, totals of weeks."""

import threading

import pytest
from pyspark.sql import functions as F

from turnlake.sources import sinks
from turnlake.sources.store import PARTS, SUMS, TOTALS, SnapshotStore
from turnlake.sources.versions import Conflict, Versions

SCHEMA = (
    "kind string, device string, person string, day string, tool string, driven_tool string, name string, detail string, hour bigint, provider string, surface string, model string, intent string, domain string, "
    "depth bigint, delegation string, delegate_tool string, sessions bigint, total_minutes bigint, longest_minutes bigint, received_ms bigint"
)


def span(device, tool, day, minutes, received=1, kind="session_span"):
    return (kind, device, "p" + device, day, tool, *[None] * 12, 1, minutes, minutes, received)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(store):
    rows = store.rows()
    return [] if rows is None else sorted((r.device, r.tool, r.day, r.total_minutes) for r in rows.collect())


def totals(store, spark):
    """Totals kept by the store, and the same from all of its rows."""
    rows = store.rows()
    week = F.coalesce(F.date_format(F.date_trunc("week", F.col("day").try_cast("date")), "yyyy-MM-dd"), F.lit("none"))
    there = [c for c in SUMS if c in rows.columns]
    again = rows.withColumn("week", week).groupBy("week", *TOTALS).agg(*[F.sum(c).alias(c) for c in there], F.count_distinct("device").alias("devices"), F.count("*").alias("rows"), F.max("longest_minutes").alias("longest_minutes"))
    columns = sorted(again.columns)
    return sorted(map(repr, store.week_totals().select(columns).collect())), sorted(map(repr, again.select(columns).collect()))


FIRST = [span("a", "x", "2026-01-06", 5), span("a", "y", "2026-01-06", 6), span("a", "x", "2025-06-02", 7), span("b", "x", "2026-01-07", 8), span("c", "x", "no day", 9)]
SECOND = [span("a", "x", "2026-01-06", 50, 2), span("a", "x", "2026-01-06", 51, 3), span("a", "z", "2026-01-20", 52, 2), span("b", None, None, 1, 2), span("d", "x", "", 1, 2), span("d", "x", "2026-01-06", 1, 2, kind="other")]
AFTER = sorted([("a", "x", "2026-01-06", 51), ("a", "z", "2026-01-20", 52), ("b", "x", "2026-01-07", 8), ("c", "x", "no day", 9)])


def test_pushes_replace_their_devices(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.rows() is None and store.week_totals() is None
    assert store.apply(frame(spark, FIRST)) == {"stored": 5, "skipped": 0, "pruned": 0, "weeks": ["2025-06-02", "2026-01-05", "none"]}
    assert store.apply(frame(spark, SECOND)) == {"stored": 2, "skipped": 3, "pruned": 2, "weeks": ["2025-06-02", "2026-01-05", "2026-01-19"]}
    assert held(store) == AFTER
    assert sorted(r.device for r in store.rows(weeks=["2026-01-05"]).collect()) == ["a", "b"] and store.rows(weeks=["2025-06-02"]) is None
    assert len(store.rows(version=1).collect()) == 5
    kept, again = totals(store, spark)
    assert kept == again
    # the same as the plain merge
    stored = frame(spark, FIRST)
    assert sorted((r.device, r.tool, r.day, r.total_minutes) for r in sinks.merge_snapshot(stored, frame(spark, SECOND)).collect()) == AFTER
    assert store.apply(frame(spark, [])) == {"stored": 0, "skipped": 0, "pruned": 0, "weeks": []} and held(store) == AFTER


class Killed(Exception):
    pass


class Dying(SnapshotStore):
    at = ""

    def _reached(self, step):
        if step == self.at:
            raise Killed(step)


@pytest.mark.parametrize("step", ["push written", "half written", "rows written", "committed"])
def test_killed_between_steps(spark, tmp_path, step):
    path = str(tmp_path / "s")
    SnapshotStore(spark, path, buckets=4).apply(frame(spark, FIRST), "q", 0)
    dying = Dying(spark, path)
    dying.at = step
    before = held(dying)
    with pytest.raises(Killed):
        dying.apply(frame(spark, SECOND), "q", 1)
    assert held(dying) == (AFTER if step == "committed" else before)
    store = SnapshotStore(spark, path)
    store.apply(frame(spark, SECOND), "q", 1)  # the retry
    assert held(store) == AFTER
    assert store.apply(frame(spark, FIRST), "q", 1) == {"stored": 0, "skipped": 0, "pruned": 0, "weeks": ["2025-06-02", "2026-01-05", "2026-01-19"]} and held(store) == AFTER
    kept, again = totals(store, spark)
    assert kept == again
    assert store.vacuum(keep=1, older_than_ms=0) >= (step != "committed") and held(store) == AFTER


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    SnapshotStore(spark, path, buckets=2).apply(frame(spark, FIRST))
    other = [span("b", "new", "2026-01-07", 80, 2), span("e", "x", "2026-01-07", 1)]

    class Slow(SnapshotStore):
        raced = 0

        def _reached(self, step):
            if step == "rows written" and not self.raced:
                self.raced = 1
                SnapshotStore(spark, path).apply(frame(spark, other))

    slow = Slow(spark, path)
    slow.apply(frame(spark, SECOND))
    assert slow.raced and slow.manifest()[0] == 3
    assert held(slow) == sorted([*(r for r in AFTER if r[0] != "b"), ("b", "new", "2026-01-07", 80), ("e", "x", "2026-01-07", 1)])
    kept, again = totals(slow, spark)
    assert kept == again


def test_a_version_is_claimed_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() == (0, {})
    versions.commit(1, {"n": 1})
    with pytest.raises(Conflict):
        versions.commit(1, {"n": 2})
    won = []

    def claim(k):
        try:
            Versions(spark, str(tmp_path / "v")).commit(2, {"n": k})
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert versions.latest()[1]["n"] in won and [f.name for f in (tmp_path / "v/_versions").iterdir() if f.name.endswith(".tmp")] == []


def test_a_push_reads_its_own_weeks_and_buckets(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=8)
    rows = [span(f"d{k}", "x", f"2026-0{1 + k % 6}-1{k % 9}", k) for k in range(60)]
    store.apply(frame(spark, rows))
    before = store.manifest()[1]["entries"]
    store.apply(frame(spark, [span("d7", "x", "2026-01-05", 1, 2)]))
    after = store.manifest()[1]["entries"]
    changed = {e for e in {*before, *after} if before.get(e) != after.get(e)}
    assert len({e.split("/")[0] for e in changed}) == 1 and len(changed) == 2 and len(before) > 20
    kept, again = totals(store, spark)
    assert kept == again


def files_of(folder):
    return [f for f in folder.rglob("*.parquet")]


def test_files_follow_buckets_not_weeks(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    rows = [span(f"d{k % 9}", "x", f"20{10 + k // 300}-{1 + k // 25 % 12:02d}-{1 + k % 25:02d}", k) for k in range(1500)]
    store.apply(frame(spark, rows))
    assert len(store.manifest()[1]["entries"]) > 500 and len(files_of(tmp_path / "s/data")) <= 2 * 4 * 2
    assert len(held(store)) == 1500
    plan = store.rows(weeks=["2011-03-07"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(week), GreaterThanOrEqual(week,2011-03-07), LessThanOrEqual(week,2011-03-07)" in plan


def test_crowded_buckets_are_written_together(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=1)
    for k in range(PARTS + 2):
        done = store.apply(frame(spark, [span(f"d{k}", "x", f"20{10 + k}-01-05", k, k)]))
        assert len(done["weeks"]) == 1
        parts = set(store.manifest()[1]["entries"].values())
        assert len(parts) == (k + 1 if k <= PARTS else 1)
    assert len(held(store)) == PARTS + 2
    kept, again = totals(store, spark)
    assert kept == again
    assert store.vacuum(keep=1, older_than_ms=0) == PARTS + 1 and len(held(store)) == PARTS + 2


def test_columns_that_a_push_leaves_out_stay(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=64)
    store.apply(frame(spark, [span("a", "x", "2026-01-06", 5)]))
    store.apply(frame(spark, [span("b", "x", "2026-01-06", 6)]).drop("longest_minutes"))
    assert sorted((r.device, r.longest_minutes) for r in store.rows().collect()) == [("a", 5), ("b", None)]
