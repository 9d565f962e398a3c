"""Queries over raw inputs: what the sources read back must equal the tables that the inputs were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import taxonomy as tx
from turnlake.functions import text as tf
from turnlake.functions.redaction import redact_spans
from turnlake.operators import filters, labeling
from turnlake.plans import bridge, raw
from turnlake.plans.registry import ORACLE_SQL, SINCE, USAGE_SQL, fact_rows, interactions, registered, session_spans
from turnlake.sources import facts, logs, sinks, transcripts, web
from turnlake.streaming import ingest

TRIM = r"regexp_replace(redacted_text, '^\s+|\s+$', '', 'g')"
TURNS_SQL = f"""SELECT device, external_id, row_number() OVER (PARTITION BY external_id ORDER BY seq) - 1 AS seq, role, {TRIM} AS redacted_text, ts_ms FROM turns WHERE role <> 'unknown' AND regexp_matches(redacted_text, '\\S')"""
TURN = ["device", "external_id", "seq", "role", "redacted_text", "ts_ms"]


@registered("read_claude_code", TURNS_SQL, "turns")
def read_claude_code(spark, d):
    return transcripts.claude_code(raw.claude_files(spark, d)).turns.select(*TURN)


@registered("read_codex", TURNS_SQL.replace("device, external_id, row", "device, 'rollout-' || external_id AS external_id, row"), "turns")
def read_codex(spark, d):
    return transcripts.codex(raw.codex_files(spark, d)).turns.select(*TURN)


@registered("read_openclaw", f"SELECT device, external_id, row_number() OVER (PARTITION BY external_id ORDER BY seq) - 1 AS seq, role, {TRIM} AS redacted_text, ts_ms FROM turns WHERE role = 'user' AND regexp_matches(redacted_text, '\\S')", "turns")
def read_openclaw(spark, d):
    return transcripts.openclaw(raw.openclaw_files(spark, d)).turns.select(*TURN)


@registered("openclaw_sessions", "SELECT device, external_id, 'openclaw' AS provider, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms FROM turns WHERE role <> 'unknown' GROUP BY ALL", "turns")
def openclaw_sessions(spark, d):
    return transcripts.openclaw(raw.openclaw_files(spark, d)).sessions.select("device", "external_id", "provider", "started_ms", "ended_ms")


@registered("openclaw_drives", "SELECT device, external_id, 'claude_code' AS driven_tool, ts_ms AS occurred_ms, count(*) AS turns FROM turns WHERE role = 'assistant' GROUP BY ALL", "turns")
def openclaw_drives(spark, d):
    return transcripts.openclaw(raw.openclaw_files(spark, d)).delegations.select("device", "external_id", "driven_tool", "occurred_ms", "turns")


@registered("agent_actions", "SELECT device, 'c' || seq || chr(31) || 'c' || seq AS ext_id, 'connector' AS tool, 'claude.code_run' AS action, 'mail' AS app, 'mutating' AS kind, ts_ms FROM turns WHERE role = 'assistant'", "turns")
def agent_actions(spark, d):
    return transcripts.agent_actions(raw.openclaw_files(spark, d)).select("device", "ext_id", "tool", "action", "app", "kind", "ts_ms")


@registered("read_web_chats", f"SELECT device, tool, external_id, seq AS i, role, {TRIM} AS redacted_text, ts_ms FROM turns WHERE tool LIKE '%-web' AND regexp_matches(redacted_text, '\\S')", "turns")
def read_web_chats(spark, d):
    turns, _ = web.web_chats(raw.chat_messages(spark, d))
    return turns.select("device", "tool", "external_id", F.col("pos.i").cast("long").alias("i"), "role", "redacted_text", "ts_ms")


@registered("rejected_web_chats", "SELECT device, count(*) AS n FROM (SELECT DISTINCT device, tool, external_id FROM turns WHERE tool NOT LIKE '%-web') GROUP BY device", "turns")
def rejected_web_chats(spark, d):
    return web.web_chats(raw.chat_messages(spark, d))[1].groupBy("device").agg(F.count("*").alias("n"))


@registered("read_web_actions", f"SELECT device, ext_id, app, action, kind, ts_ms FROM actions WHERE app IN ({', '.join(repr(a) for a in tx.APP_LABELS)})", "actions")
def read_web_actions(spark, d):
    return web.web_actions(raw.action_batches(spark, d)).select("device", "ext_id", "app", "action", "kind", "ts_ms")


@registered("read_gateway_log", "SELECT device, 'gw' || chr(31) || ts_ms || chr(31) || ext_id || chr(31) || action AS ext_id, action, 'run ' || ext_id AS target_redacted, ts_ms FROM actions WHERE ts_ms % 3 <> 0", "actions")
def read_gateway_log(spark, d):
    return logs.gateway_log(raw.gateway_lines(spark, d)).select("device", "ext_id", "action", "target_redacted", "ts_ms")


@registered("read_voice_trace", "SELECT device, action, ts_ms, 'voice' AS session_id FROM actions WHERE tool = 'shortcut'", "actions")
def read_voice_trace(spark, d):
    return logs.voice_trace(raw.trace_lines(spark, d)).select("device", "action", "ts_ms", "session_id")


@registered("read_hook_events", "SELECT session_id || chr(31) || ext_id AS ext_id, session_id, app, CASE WHEN kind = 'read_only' THEN 'mail.list' ELSE 'mail.send' END AS action, kind, ts_ms FROM actions WHERE tool <> 'browser' AND CAST(ext_id AS BIGINT) > 100", "actions")
def read_hook_events(spark, d):
    return logs.hook_events(raw.hook_rows(spark, d), 100)[0].select("ext_id", "session_id", "app", "action", "kind", "ts_ms")


@registered(
    "read_fact_rows",
    "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(runs) AS BIGINT) AS runs FROM (SELECT 'analytics_cell' AS kind, sessions, 0 AS runs FROM cells UNION ALL SELECT 'session_span', sessions, 0 FROM spans UNION ALL SELECT 'delegation', 0, 0 FROM drives"
    + "".join(f" UNION ALL SELECT '{kind}', 0, runs FROM ({USAGE_SQL.format(kind)})" for kind in ("connector", "shortcut")) + ") GROUP BY kind",
    "cells", "spans", "drives", "actions", "devices",
)
def read_fact_rows(spark, d):
    rows = fact_rows(spark, d)
    back = facts.read_fact_rows(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")))
    return back.where("NOT bad").groupBy("kind").agg(F.count("*").alias("n"), F.sum("sessions").alias("sessions"), F.sum("runs").alias("runs"))


@registered(
    "label_replies",
    "SELECT device, external_id, seq, CASE WHEN seq % 5 = 4 THEN 'model refused: no' END AS last_error, CASE WHEN domain = 'other' AND seq % 5 <> 4 THEN 'new_' || external_id END AS proposed_domain FROM turn_labels",
    "turn_labels",
)
def label_replies(spark, d):
    return labeling.parse_replies(raw.reply_bodies(spark, d)).select("device", "external_id", "seq", "last_error", "proposed_domain")


@registered("label_report", "SELECT count(*) AS considered, count(*) FILTER (WHERE seq % 5 <> 4) AS labeled, count(*) FILTER (WHERE seq % 5 = 4) AS failed, count(*) FILTER (WHERE domain = 'other' AND seq % 5 <> 4) AS candidates FROM turn_labels", "turn_labels")
def label_report(spark, d):
    return labeling.job_report(labeling.parse_replies(raw.reply_bodies(spark, d)))


@registered("failure_amnesty", "SELECT device, external_id, seq, attempts FROM label_failures WHERE device >= 'd3'", "label_failures")
def failure_amnesty(spark, d):
    f = bridge.failures(spark, d)
    return labeling.amnesty(f, F.substring("device", 2, 1).cast("int"), 3).select("device", "external_id", "seq", "attempts")


@registered(
    "engaged_bursts",
    """SELECT external_id, min(ts_ms) AS start_ms, max(ts_ms) - min(ts_ms) AS active_ms, count(*) AS turns FROM (SELECT *, sum(CASE WHEN gap <= 1800000 THEN 0 ELSE 1 END) OVER (PARTITION BY external_id ORDER BY ts_ms) AS burst
    FROM (SELECT CAST(user_id AS VARCHAR) AS external_id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS gap FROM events)) GROUP BY external_id, burst""",
)
def engaged_bursts(spark, d):
    t = bridge.big_turns(spark, d).select(F.lit("d").alias("device"), F.lit("t").alias("tool"), F.col("external_id").cast("string").alias("external_id"), "ts_ms")
    return ingest.engaged_bursts(t).select("external_id", "start_ms", "active_ms", "turns")


@registered("activity_counters", "SELECT device, ts_ms // 3600000 * 3600000 AS start_ms, count(*) AS actions, count(*) FILTER (WHERE tool = 'connector') AS connectors, count(*) FILTER (WHERE tool = 'shortcut') AS shortcuts FROM actions GROUP BY ALL", "actions")
def activity_counters(spark, d):
    return ingest.activity_counters(bridge.actions(spark, d))


@registered(
    "labels_of_time",
    """SELECT event_id, CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS VARCHAR) END || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS hour, strftime(date_trunc('week', ts), '%b %-d') || ' – ' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%b %-d, %Y') AS week FROM events""",
)
def labels_of_time(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select("event_id", cl.hour_label(F.hour("ts")).alias("hour"), tf.week_label(tf.week_start(day)).alias("week"))


@registered("previews", "SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE t[:119] || '…' END AS preview FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def previews(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tf.preview(F.col("text")).alias("preview"))


# --- more sources ----------------------------------------------------------------------------------------------------


@registered("command_noise", TURNS_SQL + " AND NOT (role = 'user' AND seq % 2 = 0)", "turns")
def command_noise(spark, d):
    return transcripts.claude_code(raw.claude_files(spark, d, noisy=True)).turns.select(*TURN)


@registered(
    "read_narrator_log",
    """SELECT device, concat_ws(chr(31), 'narr', 'narrator.log', ext_id, 'conn' || i) AS ext_id, step AS action, app, ts_ms FROM (
    SELECT device, ext_id, 0 AS i, 'mail.send' AS step, 'first' || ext_id AS app, ts_ms FROM actions WHERE CAST(ext_id AS BIGINT) % 2 = 0 UNION ALL SELECT device, ext_id, 1, action, 'second', ts_ms FROM actions WHERE CAST(ext_id AS BIGINT) % 2 = 0
    UNION ALL SELECT device, ext_id, 0, action, 'only' || ext_id, ts_ms FROM actions WHERE CAST(ext_id AS BIGINT) % 2 = 1) WHERE CAST(ext_id AS BIGINT) % 3 <> 0""",
    "actions",
)
def read_narrator_log(spark, d):
    return logs.narrator_log(raw.narrator_lines(spark, d)).select("device", "ext_id", "action", "app", "ts_ms")


@registered(
    "changed_files",
    f"SELECT device, external_id, modified_ms, modified_ms >= {SINCE} AS marked FROM (SELECT device, external_id, max(ts_ms) AS modified_ms FROM turns GROUP BY ALL) WHERE modified_ms >= {SINCE} OR modified_ms >= {SINCE} + 3 * 86400000 - 16 * 86400000",
    "turns",
)
def changed_files(spark, d):
    """Transcripts changed since a mark, or without one in the last 16 days."""
    files = bridge.turns(spark, d).groupBy("device", "external_id").agg(F.max("ts_ms").alias("modified_ms"))
    recent = filters.changed_since(files, None, SINCE + 3 * 24 * filters.HOUR_MS)
    marked = filters.changed_since(files, SINCE, 0).select("device", "external_id", F.lit(True).alias("marked"))
    return recent.join(marked, ["device", "external_id"], "full").join(files.select("device", "external_id", F.col("modified_ms").alias("at")), ["device", "external_id"]).select("device", "external_id", F.col("at").alias("modified_ms"), F.coalesce("marked", F.lit(False)).alias("marked"))


# --- written exports, read back --------------------------------------------------------------------------------------


@registered("interactions_written", ORACLE_SQL["interactions"])
def interactions_written(spark, d):
    rows = interactions(spark, d)
    sinks.write_by_day(rows, path := sinks.landing(spark, "interactions"), "ts_ms", "event_id")
    return spark.read.schema(rows.schema).json(path)


@registered("actions_written", "SELECT 'action/1' AS schema, device || ':' || source || ':' || ext_id AS event_id, strftime(make_timestamp_ms(ts_ms), '%Y-%m-%d') AS day, * FROM actions", "actions")
def actions_written(spark, d):
    rows = sinks.flat_actions(bridge.actions(spark, d))
    sinks.write_by_day(rows, path := sinks.landing(spark, "actions"), "ts_ms", "event_id")
    return spark.read.schema(rows.schema).json(path)


@registered("fact_rows_written", ORACLE_SQL["fact_rows"])
def fact_rows_written(spark, d):
    rows = fact_rows(spark, d)
    sinks.write_fact_rows(rows, path := sinks.landing(spark, "facts"))
    return spark.read.schema(rows.schema).json(path).select("kind", "device", "person", "day", "tool", "turns", "sessions", "runs")


@registered("week_archived", "SELECT device, day, tool, sessions, '2024-01-08' AS week_start FROM spans WHERE day BETWEEN '2024-01-08' AND '2024-01-14'", "spans")
def week_archived(spark, d):
    rows = session_spans(spark, d)
    sinks.archive_week(rows, "2024-01-08", path := sinks.landing(spark, "archive"))
    sinks.archive_week(rows, "2024-01-08", path)  # again, as after a late upload
    return spark.read.schema(rows.withColumn("week_start", F.lit("")).schema).json(path).select("device", "day", "tool", "sessions", "week_start")


# --- more scalars ----------------------------------------------------------------------------------------------------


@registered(
    "tool_calls",
    """SELECT event_id, CASE k WHEN 0 THEN 'shortcut' WHEN 1 THEN 'connector' WHEN 2 THEN 'bdc__run_applescript' WHEN 5 THEN 'browser__page_state' WHEN 7 THEN 'browser' ELSE 'bdc__cua' END AS tool,
    CASE k WHEN 0 THEN 'q' || event_id WHEN 1 THEN 'mail.list' WHEN 2 THEN 'run_applescript' WHEN 3 THEN 'click' WHEN 4 THEN 'screenshot' WHEN 5 THEN 'page_state' ELSE 'click' END AS action,
    CASE k WHEN 0 THEN 'c' WHEN 2 THEN 'Mail' WHEN 3 THEN 'b' || event_id WHEN 5 THEN 'x' || event_id || '.org' WHEN 7 THEN 'host' END AS app,
    CASE k WHEN 0 THEN 'q' || event_id WHEN 1 THEN 't' || event_id WHEN 2 THEN 'tell application "Mail" to open x' || event_id WHEN 3 THEN 'element#' || event_id WHEN 4 THEN 'pid ' || event_id WHEN 5 THEN 'https://www.x' || event_id || '.org/a?b=c' ELSE 'http://host/' || event_id END AS target,
    CASE WHEN k IN (1, 4, 5) THEN 'read_only' ELSE 'mutating' END AS kind FROM (SELECT event_id, event_id % 8 AS k FROM events) WHERE k <> 6""",
)
def tool_calls(spark, d):
    return raw.tool_calls(spark, d).withColumn("a", cl.tool_call(F.col("name"), F.col("args"))).where("a IS NOT NULL").select("event_id", "a.*")


CONTROL_SQL = " ".join(f"WHEN regexp_matches(lower(label), '{p}') THEN '{v}'" for p, v in cl.CONTROL_VERBS)


@registered(
    "control_verbs",
    f"""SELECT event_id, verb, CASE WHEN verb = 'download' THEN 'read_only' ELSE 'mutating' END AS kind FROM (SELECT event_id, CASE {CONTROL_SQL} END AS verb FROM (
    SELECT event_id, ([{', '.join(f"'{c}'" for c in raw.CONTROLS)}])[event_id % {len(raw.CONTROLS)} + 1] || ' ' || event_type AS label FROM events)) WHERE verb IS NOT NULL""",
)
def control_verbs(spark, d):
    return raw.control_labels(spark, d).select("event_id", cl.control_verb(F.col("label")).alias("verb")).where("verb IS NOT NULL").withColumn("kind", cl.control_kind(F.col("verb")))


@registered(
    "spans_redacted",
    """SELECT doc_id, length(CASE WHEN length(w) >= 3 THEN replace(text, w, '[name]') ELSE text END) AS n_chars, CASE WHEN length(w) >= 3 THEN (length(text) - length(replace(text, w, ''))) // length(w) ELSE 0 END AS n,
    CASE WHEN length(w) >= 3 THEN replace(text, w, '[name]') ELSE text END AS text FROM (SELECT doc_id, text, regexp_extract(text, '[^ ]+') AS w FROM documents WHERE text IS NOT NULL)""",
)
def spans_redacted(spark, d):
    """Each document's first word as a detected name, beside a doubtful and a short span that are left alone."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    span = lambda text, of, prob: F.struct(text.alias("text"), F.lit(of).alias("class"), F.lit(prob).alias("prob"))
    spans = F.array(span(F.regexp_extract("text", "[^ ]+", 0), "name", 0.9), span(F.regexp_extract("text", "[^ ]+$", 0), "place", 0.4), span(F.lit(" e "), "letter", 0.9))
    return docs.withColumn("r", redact_spans(F.col("text"), spans)).select("doc_id", F.length("r.text").cast("long").alias("n_chars"), F.col("r.n").alias("n"), F.col("r.text").alias("text"))


@registered("full_weeks", "SELECT event_id, strftime(date_trunc('week', ts) - INTERVAL 7 DAY, '%Y-%m-%d') AS week FROM events")
def full_weeks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", tf.last_full_week(F.date_format("ts", "yyyy-MM-dd")).alias("week"))
