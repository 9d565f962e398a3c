"""Raw inputs derived from the given tables: transcripts, logs and payloads as their sources would land them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.plans import bridge
from turnlake.sources import transcripts


def stamp(ms: Column) -> Column:
    """RFC 3339 text of an instant, in UTC."""
    return F.concat(F.date_format(F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd"), F.lit("T"), *clock(ms), F.lit("Z"))


def clock(ms: Column) -> list[Column]:
    of = lambda unit, most, width: F.lpad(F.floor(F.pmod(ms, F.lit(86_400_000)) / unit % most).cast("string"), width, "0")
    return [of(3_600_000, 24, 2), F.lit(":"), of(60_000, 60, 2), F.lit(":"), of(1000, 60, 2), F.lit("."), of(1, 1000, 3)]


def as_files(lines: DataFrame, name: Column) -> DataFrame:
    """One transcript for each device and external_id: lines in the order of pos. A session is bounded by its conversation."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("device", "external_id").agg(body.alias("value"))
    return transcripts.with_lines(files.select(F.concat(F.lit("/landing/device="), "device", F.lit("/"), name).alias("file"), F.lit(1).cast("long").alias("modified_ms"), "value"))


def json_text(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def blocks(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def claude_files(spark: SparkSession, d: str, noisy: bool = False) -> DataFrame:
    """noisy: even turns of users are echoes of commands."""
    t = bridge.turns(spark, d)
    head = F.when(F.lit(noisy) & (F.col("seq") % 2 == 0), "  <command-name>").otherwise("  ")
    plain = json_text(type=F.lit("user"), sessionId=F.col("external_id"), timestamp=stamp(F.col("ts_ms")), message=F.struct(F.concat(head, "redacted_text").alias("content")))
    said = json_text(type=F.lit("assistant"), sessionId=F.col("external_id"), timestamp=stamp(F.col("ts_ms")), message=F.struct(F.lit("claude-x").alias("model"), blocks(F.col("redacted_text")).alias("content")))
    lines = t.select("device", "external_id", F.col("seq").alias("pos"), F.when(F.col("role") == "user", plain).when(F.col("role") == "assistant", said).otherwise("not json").alias("line"))
    return as_files(lines, F.concat("external_id", F.lit(".jsonl")))


def codex_files(spark: SparkSession, d: str) -> DataFrame:
    t = bridge.turns(spark, d)
    of = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("token_count")
    event = json_text(timestamp=stamp(F.col("ts_ms")), type=F.lit("event_msg"), payload=F.struct(of.alias("type"), F.col("redacted_text").alias("message")))
    return as_files(t.select("device", "external_id", F.col("seq").alias("pos"), event.alias("line")), F.concat(F.lit("rollout-"), "external_id", F.lit(".jsonl")))


def openclaw_files(spark: SparkSession, d: str) -> DataFrame:
    t = bridge.turns(spark, d)
    call = F.struct(F.lit("toolCall").alias("type"), F.concat(F.lit("c"), F.col("seq").cast("string")).alias("id"), F.lit("app_runtime").alias("name"), F.struct(F.lit("claude.code_run").alias("capability"), F.lit("mail").alias("connectorId")).alias("arguments"))
    plain = json_text(type=F.lit("message"), message=F.struct(F.col("role"), F.concat(F.lit("x\n## Inbound user message\n"), "redacted_text", F.lit("\n## end")).alias("content"), F.col("ts_ms").alias("timestamp")))
    said = json_text(type=F.lit("message"), message=F.struct(F.col("role"), F.array(call).alias("content"), F.col("ts_ms").alias("timestamp")))
    lines = t.select("device", "external_id", F.col("seq").alias("pos"), F.when(F.col("role") == "user", plain).when(F.col("role") == "assistant", said).otherwise("{}").alias("line"))
    return as_files(lines, F.concat("external_id", F.lit(".jsonl")))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """One message of a browser for each conversation, some of an unknown tool."""
    t = bridge.turns(spark, d)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", F.col("redacted_text").alias("text"), "ts_ms"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["ts_ms"].alias("ts_ms")))
    per = t.groupBy("device", "tool", "external_id").agg(turns.alias("turns"))
    return per.select("device", F.lit(1).cast("long").alias("arrived_ms"), json_text(tool=F.col("tool"), external_id=F.col("external_id"), turns=F.col("turns")).alias("value"))


def action_batches(spark: SparkSession, d: str) -> DataFrame:
    a = bridge.actions(spark, d)
    one = F.struct("ext_id", F.coalesce("app", F.lit("")).alias("app"), "action", "kind", "session_id", "ts_ms")
    return a.select("device", json_text(actions=F.array(one)).alias("value"))


def gateway_lines(spark: SparkSession, d: str) -> DataFrame:
    a = bridge.actions(spark, d)
    key = F.when(F.col("ts_ms") % 3 == 0, "-").otherwise(F.col("action"))
    return a.select("device", F.concat(stamp(F.col("ts_ms")), F.lit(" [action-gate-ui] ui started run="), "ext_id", F.lit(" key="), key, F.lit(' title="run '), "ext_id", F.lit('"')).alias("value"))


def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    a = bridge.actions(spark, d)
    said = F.when(F.col("tool") == "shortcut", "executed").otherwise("seen")
    return a.select("device", json_text(cat=F.lit("action-gate"), msg=said, tool=F.col("action"), ts=stamp(F.col("ts_ms")), runId=F.col("ext_id").cast("long")).alias("value"))


def hook_rows(spark: SparkSession, d: str) -> DataFrame:
    a = bridge.actions(spark, d)
    args = json_text(capability=F.concat(F.lit("mail."), F.when(F.col("kind") == "read_only", "list").otherwise("send")), connectorId=F.col("app"), query=F.col("action"))
    return a.select("device", F.col("ext_id").cast("long").alias("event_id"), F.concat_ws(":", "session_id", "ext_id").alias("source_ref"), F.lit(None).cast("string").alias("session_id"), F.col("ts_ms").alias("ts"), F.when(F.col("tool") == "browser", "other").otherwise("app_runtime").alias("tool"), args.alias("args_json"))


def reply_bodies(spark: SparkSession, d: str) -> DataFrame:
    """A model's reply for each label, some refused."""
    l = bridge.labels(spark, d)  # noqa: E741
    content = json_text(**{c: F.col(c) for c in ("intent", "domain", "depth", "delegation", "delegate_tool", "confidence")}, proposed_domain=F.concat(F.lit("New "), "external_id"))
    refused = F.col("seq") % 5 == 4
    body = json_text(choices=F.array(F.struct(F.struct(F.when(~refused, content).alias("content"), F.when(refused, F.lit("no")).alias("refusal")).alias("message"))))
    return l.select("device", "external_id", "seq", body.alias("body"))


def narrator_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a narrator's log: steps with their commands, every third run failed."""
    a, n = bridge.actions(spark, d), F.col("ext_id").cast("long")
    steps = F.when(n % 2 == 0, F.concat(F.lit("mail.send command=first"), "ext_id", F.lit(" (0.2s) command=second"))).otherwise(F.concat(F.lit("status=fine command=only"), "ext_id"))
    value = F.concat(F.lit("[voice/action-gate] action gate: "), "action", F.lit(' "do it" took 3 → '), F.when(n % 3 == 0, "failed ").otherwise("ok "), steps)
    return a.select("device", F.lit("narrator.log").alias("file"), n.alias("line"), F.col("ts_ms").alias("seen_ms"), value.alias("value"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls of every kind, one for each event: event_id, name and args (a variant)."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("n", F.col("event_id").cast("string"))
    of = lambda *parts: F.concat(*[F.col("n") if p == "#" else F.lit(p) for p in parts])
    calls = [
        ("app_runtime", of('{"capability":"shortcut.run","query":"q', "#", '","connectorId":"c"}')),
        ("app_runtime", of('{"capability":"mail.list","text":"t', "#", '"}')),
        ("bdc__run_applescript", of('{"script":" tell application \\"Mail\\" to open x', "#", ' "}')),
        ("bdc__cua", of('{"tool":"click","args":{"bundleId":"b', "#", '","element_index":', "#", "}}")),
        ("bdc__cua", of('{"tool":"screenshot","args":{"pid":', "#", "}}")),
        ("browser__page_state", of('{"url":"https://www.x', "#", '.org/a?b=c"}')),
        ("app_runtime", of('{"action":"list_connectors","capability":"mail.list","query":"q', "#", '"}')),
        ("browser", of('{"action":"click","href":"http://host/', "#", '"}')),
    ]
    k = (F.col("event_id") % len(calls)).cast("int") + 1
    return e.select("event_id", F.element_at(F.array(*[F.lit(c) for c, _ in calls]), k).alias("name"), F.parse_json(F.element_at(F.array(*[a for _, a in calls]), k)).alias("args"))


CONTROLS = ["Send now", "Resend", "Reply all", "Forward", "Archive chat", "Move to Trash", "Download file", "Upload", "Share link", "Rename", "Save as", "New folder", "Recreated", "Comment", "Commented", "Invite people", "Newest", "Open"]


def control_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label of a control for each event."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.concat(F.element_at(F.array(*[F.lit(c) for c in CONTROLS]), (F.col("event_id") % len(CONTROLS)).cast("int") + 1), F.lit(" "), "event_type").alias("label"))
