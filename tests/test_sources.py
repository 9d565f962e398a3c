import json

from pyspark.sql import functions as F

from turnlake.functions import text as tf
from turnlake.sources import facts, logs, sinks, transcripts, web


def parsed(spark, name, lines, device="m1"):
    body = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    raw = spark.createDataFrame([(f"/landing/device={device}/{name}", 5, body)], "file string, modified_ms bigint, value string")
    return transcripts.with_lines(raw)


def test_claude_code(spark, tmp_path):
    lines = [
        {"type": "queue-operation", "sessionId": "s-1", "timestamp": "2026-07-02T07:00:00.000Z"},
        {"type": "user", "sessionId": "s-1", "timestamp": "2026-07-02T07:00:01.000Z", "message": {"role": "user", "content": " summarise the log "}},
        {"type": "assistant", "timestamp": "2026-07-02T07:00:05.000Z", "message": {"model": "claude-x", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": " first "}, {"type": "text", "text": "second"}, {"type": "text", "text": " "}]}},
        {"type": "user", "timestamp": "2026-07-02T07:00:06.000Z", "message": {"content": [{"type": "tool_result", "content": "ok"}]}},
        {"type": "user", "timestamp": "2026-07-02T07:00:07.000Z", "message": {"content": "<command-name>/x</command-name>"}},
        "not json",
        "",
        {"type": "user", "timestamp": "never", "message": {"content": "no stamp"}},
    ]
    folder = tmp_path / "device=m1" / "p"
    folder.mkdir(parents=True)
    (folder / "s-1.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (folder / "other.txt").write_text("{}")
    out = transcripts.claude_code(transcripts.files(spark, str(tmp_path), "*.jsonl"))
    assert [(r.device, r.seq, r.role, r.redacted_text) for r in out.turns.orderBy("seq").collect()] == [("m1", 0, "user", "summarise the log"), ("m1", 1, "assistant", "first\nsecond")]
    (s,) = out.sessions.collect()
    assert (s.external_id, s.model, s.provider, s.message_count, s.ended_ms - s.started_ms) == ("s-1", "claude-x", "anthropic", 2, 4000)


def test_files_without_turns_give_no_session(spark):
    out = transcripts.claude_code(parsed(spark, "a.jsonl", [{"type": "summary", "sessionId": "s"}]))
    assert out.sessions.count() == out.turns.count() == 0


def test_codex(spark):
    ts = "2026-01-01T00:00:00Z"
    lines = [
        {"timestamp": ts, "type": "session_meta", "payload": {"session_id": "first"}},
        {"timestamp": ts, "type": "session_meta", "payload": {"session_id": "last"}},
        {"timestamp": ts, "type": "turn_context", "payload": {"model": "gpt-5"}},
        {"timestamp": ts, "type": "turn_context", "payload": {"model": "o3"}},
        {"timestamp": ts, "type": "event_msg", "payload": {"type": "user_message", "message": "hello"}},
        {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count"}},
        {"timestamp": ts, "type": "event_msg", "payload": {"type": "agent_message", "message": "hi"}},
    ]
    out = transcripts.codex(parsed(spark, "rollout-1.jsonl", lines))
    (s,) = out.sessions.collect()
    assert (s.external_id, s.model, s.provider) == ("last", "gpt-5", "openai")
    assert [r.role for r in out.turns.orderBy("seq").collect()] == ["user", "assistant"]
    nameless = transcripts.codex(parsed(spark, "rollout-2.jsonl", lines[4:5])).sessions.first()
    assert (nameless.external_id, nameless.model) == ("rollout-2", None)


def call(name, args, call_id="c"):
    return {"type": "toolCall", "id": call_id, "name": name, "arguments": args}


def message(role, content, ts=1_000, **more):
    return {"type": "message", "message": {"role": role, "content": content, "timestamp": ts, **more}}


def test_openclaw(spark):
    lines = [
        {"type": "session", "id": "s1"},
        message("user", "head\n## Inbound user message\nreal text\n## Tail\nx", 1000),
        message("assistant", [{"type": "text", "text": "ok"}, call("app_runtime", {"capability": "claude.code_run", "action": "execute_connector"}), call("web_search", {})], 2000, model="claude-y"),
        message("assistant", [call("app_runtime", {"capability": "claude.run"}), call("app_runtime", {"capability": "claude.read"}), call("sessions_spawn", {"agentId": "Codex-1"})], 3000),
        message("assistant", [call("app_runtime", {"capability": "claude.code_run", "action": "resolve_capability"})], 4000),
    ]
    out = transcripts.openclaw(parsed(spark, "s1.jsonl", lines))
    (s,) = out.sessions.collect()
    assert (s.external_id, s.model, s.provider, s.started_ms, s.ended_ms, s.message_count) == ("s1", "claude-y", "anthropic", 1000, 4000, 2)
    assert [r.redacted_text for r in out.turns.orderBy("seq").collect()] == ["real text", "ok"]
    assert {(r.driven_tool, r.occurred_ms, r.turns) for r in out.delegations.collect()} == {("claude_code", 2000, 1), ("claude_chat", 3000, 1), ("codex", 3000, 1)}
    quiet = transcripts.openclaw(parsed(spark, "q.jsonl", [message("assistant", [call("sessions_spawn", {"agentId": "claude"})])]))
    assert quiet.turns.count() == 0 and quiet.sessions.count() == 1 and quiet.delegations.count() == 1
    assert transcripts.openclaw(parsed(spark, "q.trajectory.jsonl", [message("user", "x")])).sessions.count() == 0


def test_agent_actions(spark):
    calls = [
        call("app_runtime", {"capability": "mail.search", "connectorId": "mail", "query": "q"}, "a"),
        call("app_runtime", {"capability": "mail.send", "connector_id": "mail"}, "b"),
        call("app_runtime", {"capability": "shortcut.run", "text": "tidy"}, "c"),
        call("app_runtime", {"action": "list_capabilities", "capability": "x.y"}, "d"),
        call("bdc__run_applescript", {"script": 'tell application "Notes" to quit'}, ""),
        call("bdc__cua", {"tool": "screenshot", "args": {"appName": "Finder", "pid": 7}}, ""),
        call("browser__open", {"url": "https://www.www.example.com/a?b"}, "g"),
        call("read", {}, "h"),
    ]
    rows = transcripts.agent_actions(parsed(spark, "s.jsonl", [{"type": "session", "id": "s"}, message("assistant", calls, "2026-01-01T00:00:00Z")])).collect()
    got = {r.ext_id.split("\u001f")[1]: (r.tool, r.action, r.app, r.target_redacted, r.kind) for r in rows}
    ms = 1767225600000
    assert got == {
        "a": ("connector", "mail.search", "mail", "q", "read_only"),
        "b": ("connector", "mail.send", "mail", None, "mutating"),
        "c": ("shortcut", "tidy", None, "tidy", "mutating"),
        f"auto-{ms}-0": ("bdc__run_applescript", "run_applescript", "Notes", 'tell application "Notes" to quit', "mutating"),
        f"auto-{ms}-1": ("bdc__cua", "screenshot", "Finder", "pid 7", "read_only"),
        "g": ("browser__open", "open", "example.com", "https://www.www.example.com/a?b", "mutating"),
    }
    assert transcripts.agent_actions(parsed(spark, "t.jsonl", [message("assistant", calls[:1], 5)]), since_ms=6).count() == 0


def test_logs(spark):
    lines = ["2026-01-01T00:00:01Z [action-gate-ui] ui started run=3 key=tidy title=\"Tidy up\"", "2026-01-01T00:00:02Z [action-gate-ui] ui started run=4 key=- title=\"x\"", "noise"]
    (r,) = logs.gateway_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (r.ext_id, r.action, r.target_redacted, r.actor) == ("gw\u001f1767225601000\u001f3\u001ftidy", "tidy", "Tidy up", "human")
    said = ['[voice/action-gate] action gate: tidy "arg" → ok (2 steps) mail.send status=ok command=mail status=ok command=files', '[voice/action-gate] action gate: tidy "arg" → error x.y command=mail']
    rows = logs.narrator_log(spark.createDataFrame([(x, "f", k, 9) for k, x in enumerate(said)], "value string, file string, line bigint, seen_ms bigint")).collect()
    assert sorted((r.action, r.app, r.ts_ms) for r in rows) == [("mail.send", "mail", 9), ("tidy", "files", 9)]
    trace = [json.dumps({"cat": "action-gate", "msg": m, "tool": "t", "ts": "2026-01-01T00:00:00Z", "pid": 2, "command": "go"}) for m in ("executed", "seen")]
    (r,) = logs.voice_trace(spark.createDataFrame([(x,) for x in trace], "value string")).collect()
    assert (r.ext_id, r.session_id, r.target_redacted) == ("2026-01-01T00:00:00Z:2:0:t", "voice", "go")


def test_hook_events(spark):
    good = json.dumps({"capability": "mail.send", "query": "hi"})
    rows = [(1, "s:a", None, 10, "app_runtime", good), (2, "nocolon", None, 11, "app_runtime", good), (3, "x:b", "own", 12, "app_runtime", good), (4, "x:c", None, 13, "app_runtime", None), (5, "x:d", None, 14, "app_runtime", "{bad"), (6, "x:e", None, 15, "other", good)]
    events = spark.createDataFrame(rows, "event_id bigint, source_ref string, session_id string, ts bigint, tool string, args_json string")
    acts, cursor = logs.hook_events(events, 0)
    assert sorted((r.session_id, r.ext_id) for r in acts.collect()) == [("", "\u001fnocolon"), ("own", "own\u001fb"), ("s", "s\u001fa")]
    assert cursor.first().cursor == 6
    assert logs.hook_events(events, 6)[1].first().cursor == 6


def test_web(spark):
    chat = {"tool": "chatgpt-web", "external_id": "w", "turns": [{"role": "user", "text": " hi ", "ts_ms": 1}, {"role": "robot", "text": "yo", "ts_ms": 2}, {"role": "user", "text": " ", "ts_ms": 3}]}
    rows = [("m", 1, json.dumps(chat)), ("m", 2, json.dumps({**chat, "tool": "nope"})), ("m", 3, "{")]
    turns, rejected = web.web_chats(spark.createDataFrame(rows, "device string, arrived_ms bigint, value string"))
    assert [(r.role, r.redacted_text, r.provider) for r in turns.orderBy("pos").collect()] == [("user", "hi", "openai"), ("unknown", "yo", "openai")]
    assert rejected.count() == 2
    batch = {"actions": [{"ext_id": "1", "app": "mail.google.com", "action": "send", "ts_ms": 1}, {"ext_id": "2", "app": "evil.com", "action": "send", "ts_ms": 1}, {"ext_id": "", "app": "mail.google.com", "action": "x", "ts_ms": 1}, {"ext_id": "3", "app": "docs.google.com", "action": "open", "kind": "read_only", "ts_ms": 1}]}
    acts = web.web_actions(spark.createDataFrame([("m", json.dumps(batch))], "device string, value string"))
    assert sorted((r.ext_id, r.kind) for r in acts.collect()) == [("1", "mutating"), ("3", "read_only")]


def test_fact_rows_and_snapshots(spark):
    lines = [json.dumps(x) for x in ({"kind": "session_span", "device": "d", "day": "2026-01-05", "tool": "codex", "sessions": 2}, {"kind": "connector", "device": "d", "day": "2026-01-05", "runs": "x"}, {"kind": "label_candidate", "device": "d"})] + ["{truncated", "[1]", ""]
    rows = facts.read_fact_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows.where("bad").count() == 2
    good = rows.where("NOT bad").withColumn("received_ms", F.lit(2).cast("long")).drop("bad")
    by_kind = {r.kind: r for r in good.collect()}
    assert (by_kind["session_span"].person, by_kind["session_span"].depth, by_kind["connector"].person, by_kind["connector"].runs) == ("unknown", 1, "", 0)
    stored = good.where("kind = 'session_span'").withColumns({"received_ms": F.lit(1).cast("long"), "tool": F.lit("old")})
    stored = stored.unionByName(stored.withColumn("device", F.lit("other")))
    merged = sinks.merge_snapshot(stored, good)
    assert {(r.device, r.kind, r.tool) for r in merged.collect()} == {("d", "session_span", "codex"), ("d", "connector", "other"), ("other", "session_span", "old")}
    assert tuple(sinks.merge_counts(stored, good).first()) == (2, 1, 1)


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-06"), ("b", "2026-01-11"), ("c", "2026-01-12")], "device string, day string")
    for _ in range(2):  # written again, a week is replaced
        sinks.archive_week(rows, "2026-01-05", str(tmp_path / "weeks"))
    assert sorted(r.device for r in spark.read.json(str(tmp_path / "weeks")).collect()) == ["a", "b"]


def test_stamps(spark):
    cases = {
        "2026-01-01T02:00:00+02:00": 1767225600000, "2025-12-31T19:00:00-0500": 1767225600000, "2026-01-01T00:00:00.5Z": 1767225600500, "2026-01-01t00:00:00z": 1767225600000, "2026-01-01 00:00": 1767225600000,
        "2026-02-30T00:00:00Z": 1772409600000, "2026-01-01": None, "2026-13-01T00:00:00Z": None, "2026-01-01T25:00:00Z": None, "x": None, "2026-01-01T00:00:00.123456Z": 1767225600123,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tf.epoch_ms(F.col("s")).alias("ms")).collect()
    assert {r.s: r.ms for r in rows} == cases


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\nb" + "c" * 200, "é" * 10, " New Topic! ", "2026-07-27")], "a string, b string, c string, d string")
    r = df.select(tf.preview(F.col("a")).alias("p"), tf.hook_preview(F.col("a")).alias("h"), tf.first_bytes(F.col("b"), 5).alias("b"), tf.proposal_id(F.col("c"), F.lit("other")).alias("c"), tf.proposal_id(F.col("c"), F.lit("write_code")).alias("n"), tf.last_full_week(F.col("d")).alias("w"), tf.week_label(F.lit("2026-07-20")).alias("l")).first()
    assert (len(r.p), r.p[:4], r.p[-1], len(r.h), r.h[1], r.b, r.c, r.n, r.w, r.l) == (120, "a bc", "…", 121, "\n", "éé", "new_topic", None, "2026-07-20", "Jul 20 – Jul 26, 2026")


def test_large_files_are_read_in_many_stretches(spark, tmp_path):
    """What every format gives is the same whether a file is one stretch or dozens; ids and models stand far from the lines they hold for."""
    stamp = lambda k: f"2026-01-01T00:{k // 60:02d}:{k % 60:02d}Z"
    claude = [{"type": "summary"}] + [{"type": "user", "timestamp": stamp(k), "message": {"content": f"ask {k}" + "." * (k % 70)}} if k % 3 else {"type": "assistant", "timestamp": stamp(k), "message": {"content": [{"type": "text", "text": f"say {k}"}], **({"model": "late"} if k > 200 else {})}} for k in range(300)]
    claude += ["not json", "", {"type": "summary", "sessionId": "at-the-end"}]
    rollout = [{"timestamp": stamp(k), "type": "event_msg", "payload": {"type": ("user_message", "agent_message", "token_count")[k % 3], "message": f"text {k}"}} for k in range(300)]
    rollout[5:5] = [{"type": "session_meta", "payload": {"session_id": "first"}}, {"type": "turn_context", "payload": {"model": "gpt-5"}}]
    rollout[290:290] = [{"type": "session_meta", "payload": {"session_id": "last"}}, {"type": "turn_context", "payload": {"model": "o3"}}]
    claw = [message("assistant", [{"type": "text", "text": f"do {k}"}, call("app_runtime", {"capability": "mail.send", "connectorId": "mail"}, "" if k % 2 else f"c{k}"), call("sessions_spawn", {"agentId": "codex"})], 1000 + k // 7) for k in range(300)]
    claw += [{"type": "model_change", "modelId": "claude-z"}, {"type": "session", "id": "s9"}]
    for folder, name, lines in (("a", "s.jsonl", claude), ("b", "rollout-1.jsonl", rollout), ("c", "t.jsonl", claw)):
        (tmp_path / folder / "device=m1").mkdir(parents=True)
        (tmp_path / folder / "device=m1" / name).write_bytes("\r\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode())

    def results(limit):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        a, b, c = (transcripts.files(spark, str(tmp_path / k), "*.jsonl") for k in "abc")
        stretches = [x.select("stretch").distinct().count() for x in (a, b, c)]
        outs = [transcripts.claude_code(a), transcripts.codex(b), transcripts.openclaw(c)]
        frames = [x for o in outs for x in (o.turns, o.sessions, o.delegations) if x is not None] + [transcripts.agent_actions(c)]
        return stretches, [sorted(map(repr, f.collect())) for f in frames]

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        one, whole = results("128m")
        many, split = results("2000b")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one == [1, 1, 1] and min(many) > 10
    assert split == whole and [len(x) for x in whole] == [300, 1, 200, 1, 300, 1, 43, 300]
    assert "external_id='at-the-end'" in whole[1][0] and "model='late'" in whole[1][0] and "external_id='last'" in whole[3][0] and "model='gpt-5'" in whole[3][0] and "external_id='s9'" in whole[5][0]
    assert sum("auto-" in x for x in whole[7]) == 150 and len(set(whole[7])) == 300
