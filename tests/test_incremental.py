"""Sources with cursors: growing files, hook tables, restarts."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from turnlake.sources import incremental, logs


def drain(df, tmp_path, name):
    """One run of a stream with its checkpoint; all rows it has written so far."""
    out = str(tmp_path / f"{name}-out")
    q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(out)


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def values(df):
    return sorted((r.device, r.line, r.value) for r in df.collect())


def test_half_lines_restarts_and_truncation(spark, tmp_path):
    folder, a = str(tmp_path / "logs"), str(tmp_path / "logs/device=a/x.log")
    append(a, b"one\ntw")
    append(str(tmp_path / "logs/device=b/y.log"), b"no break yet")
    stream = lambda: incremental.growing_lines(spark, folder, stream=True, glob="*.log")
    first = [("a", 0, "one")]
    assert values(drain(stream(), tmp_path, "s")) == first
    append(a, b"o\r\nthree\nfo")
    second = [*first, ("a", 4, "two"), ("a", 9, "three")]
    assert values(drain(stream(), tmp_path, "s")) == sorted(second)
    assert values(incremental.growing_lines(spark, folder, glob="*.log")) == sorted(second)
    assert values(drain(stream(), tmp_path, "s")) == sorted(second)  # nothing new
    with open(a, "wb") as f:
        f.write(b"new\nlog")
    append(str(tmp_path / "logs/device=b/y.log"), b", now\n\xff\n")
    third = [*second, ("a", 0, "new"), ("b", 0, "no break yet, now"), ("b", 18, "�")]
    assert values(drain(stream(), tmp_path, "s")) == sorted(third)


def test_start_at_the_end_and_go_on_there_after_shrinking(spark, tmp_path):
    folder, a = str(tmp_path / "logs"), str(tmp_path / "logs/device=a/x.log")
    append(a, b"old\nol")
    stream = lambda: incremental.growing_lines(spark, folder, stream=True, start="end", shrunk="end")
    assert values(drain(stream(), tmp_path, "s")) == []
    append(a, b"der\nnext\n")
    assert [v for _, _, v in values(drain(stream(), tmp_path, "s"))] == ["older", "next"]
    with open(a, "wb") as f:
        f.write(b"x\n")
    assert len(values(drain(stream(), tmp_path, "s"))) == 2
    append(a, b"y\n")
    assert [v for _, _, v in values(drain(stream(), tmp_path, "s"))] == ["y", "older", "next"]


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 1000])
def test_stretches_hold_every_line_once_in_order(spark, tmp_path, split_bytes):
    lines = [b"x" * (k * 7 % 23) + b"%d" % k for k in range(120)]
    append(str(tmp_path / "logs/device=a/x.log"), b"\n".join(lines) + b"\nhalf")
    df = incremental.growing_lines(spark, str(tmp_path / "logs"), split_bytes=split_bytes)
    assert [r.value.encode() for r in df.orderBy("line").collect()] == lines
    assert split_bytes > 64 or df.rdd.getNumPartitions() > 10
    assert incremental.growing_lines(spark, str(tmp_path / "none")).count() == 0


def test_gateway_log_of_a_growing_file_equals_a_batch(spark, tmp_path):
    line = lambda k: f'2026-01-02T03:04:{k:02d}.000Z [action-gate-ui] ui started run={k} key=k{k % 3} title="run {k}"\n'.encode()
    body = b"".join(line(k) for k in range(40))
    stream = lambda: logs.gateway_log(incremental.growing_lines(spark, str(tmp_path / "logs"), stream=True))
    for lo, hi in ((0, 333), (333, 334), (334, 2000), (2000, len(body))):
        append(str(tmp_path / "logs/device=a/gateway.log"), body[lo:hi])
        out = drain(stream(), tmp_path, "s")
    batch = logs.gateway_log(incremental.growing_lines(spark, str(tmp_path / "logs")))
    assert out.count() == 40 and sorted(map(repr, out.collect())) == sorted(map(repr, batch.collect()))


def hook_file(path, ids, tool="app_runtime"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    n = len(ids)
    table = pa.table({"event_id": pa.array(ids, pa.int64()), "source_ref": [f"s:{i}" for i in ids], "session_id": pa.nulls(n, pa.string()), "ts": pa.array(ids, pa.int64()), "tool": [tool] * n, "args_json": ['{"capability":"mail.send"}'] * n, "extra": [0] * n})
    pq.write_table(table, path, row_group_size=3)


def test_hook_cursor_reads_new_ids_only(spark, tmp_path):
    folder = str(tmp_path / "hook")
    hook_file(f"{folder}/device=a/1.parquet", list(range(1, 11)))
    hook_file(f"{folder}/device=b/1.parquet", [5, 6])
    stream = lambda: incremental.hook_table(spark, folder, stream=True, after='{"a": 4}')
    ids = lambda df: sorted((r.device, r.event_id) for r in df.collect())
    first = [("a", k) for k in range(5, 11)] + [("b", 5), ("b", 6)]
    assert ids(drain(stream(), tmp_path, "s")) == first
    hook_file(f"{folder}/device=a/2.parquet", [9, 10, 11, 12], tool="other")  # two old ids; dropped rows move the cursor too
    assert ids(drain(stream(), tmp_path, "s")) == sorted([*first, ("a", 11), ("a", 12)])
    hook_file(f"{folder}/device=a/3.parquet", [12, 13])
    assert ids(drain(stream(), tmp_path, "s")) == sorted([*first, ("a", 11), ("a", 12), ("a", 13)])
    source = incremental.Events({"path": folder})
    end = source.latest()
    assert end == {"a": 13, "b": 6}
    assert [(p.file.rsplit("/", 1)[1], p.groups) for p in source.ranges({"a": 9, "b": 6}, end)] == [("1.parquet", [3]), ("2.parquet", [0, 1]), ("3.parquet", [0])]


def test_hook_batches_read_wanted_row_groups(spark, tmp_path):
    folder = str(tmp_path / "hook")
    for d in "ab":
        hook_file(f"{folder}/device={d}/1.parquet", list(range(30)))
    df = incremental.hook_table(spark, folder, groups=1, after='{"a": 20, "*": 26}')
    assert df.groupBy("device").count().orderBy("device").collect() == [("a", 9), ("b", 3)] and df.rdd.getNumPartitions() == 4
    acts = logs.hook_events(incremental.hook_table(spark, folder, after="27"))[0]
    assert sorted(r.ext_id for r in acts.select("ext_id").collect()) == ["s\u001f28", "s\u001f28", "s\u001f29", "s\u001f29"]
