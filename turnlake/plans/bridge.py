"""Canonical tables over the given tables, by fixed rules, as Spark SQL; the same text runs in DuckDB.

conversations give sessions, turns, labels and delegations; events give actions and one large turns table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import taxonomy as tx

TOOLS = ["openclaw", "claude-code", "codex", "chatgpt-web", "claude-web", "gemini-web"]
MODELS = ["claude-sonnet", "gpt-5", "gemini-pro", None, "o3-mini"]
EPOCH = 1_704_067_200_000


def pick(values: list, index) -> F.Column:
    """values[index] for an index column that is in range."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def sql_pick(values: list, index: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


def device(n) -> F.Column:
    return F.concat(F.lit("d"), (n % 7).cast("string"))


def devices(spark: SparkSession) -> DataFrame:
    """One row for each of the seven devices: person, name, minutes ahead of UTC."""
    k = F.col("id")
    return spark.range(7).select(device(k).alias("device"), F.concat(F.lit("p"), (k % 4).cast("string")).alias("person"), F.concat(F.lit("laptop "), k.cast("string")).alias("device_name"), ((k % 5 - 2) * 90).cast("int").alias("offset_min"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n, t = F.col("conv_id"), F.col("turn")
    ts = F.lit(EPOCH) + n * 10_800_000 + t * 240_000 + F.floor(t / 4) * 2_700_000
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("unknown")
    return c.select(device(n).alias("device"), pick(TOOLS, n % 6).alias("tool"), n.cast("string").alias("external_id"), t.alias("seq"), role.alias("role"), F.col("text").alias("redacted_text"), ts.alias("ts_ms"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("external_id").cast("long")
    base = turns(spark, sf_dir).groupBy("device", "tool", "external_id").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.count("*").alias("message_count"))
    model = pick(MODELS, n % 5)
    surface = F.when(F.col("tool").endswith("-web"), "web").otherwise("cli")
    return base.select("device", "tool", "external_id", cl.provider(model, F.lit("openai")).alias("provider"), surface.alias("surface"), model.alias("model"), "started_ms", "ended_ms", "message_count")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("external_id").cast("long"), F.col("seq")
    asked = turns(spark, sf_dir).where((F.col("role") == "user") & ((n + s) % 3 != 0))
    return asked.select(
        "device", "tool", "external_id", "seq", F.lit(tx.TAXONOMY_VERSION).cast("long").alias("taxonomy_version"), ((n + s) % 2 + 1).alias("prompt_version"), F.lit("labeler").alias("model"),
        pick(tx.INTENTS, (n * 5 + s) % len(tx.INTENTS)).alias("intent"), pick(tx.DOMAINS, (n * 3 + s) % len(tx.DOMAINS)).alias("domain"), ((n + s) % 4 + 1).alias("depth"),
        pick(tx.DELEGATIONS, (n + s) % 3).alias("delegation"), pick(tx.DELEGATE_TARGETS, (n + s) % len(tx.DELEGATE_TARGETS)).alias("delegate_tool"), (((n + s) % 10) / 10.0).alias("confidence"), F.col("ts_ms").alias("analyzed_ms"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("external_id").cast("long"), F.col("seq")
    failed = turns(spark, sf_dir).where((F.col("role") == "user") & ((n + s) % 3 == 0))
    return failed.select("device", "tool", "external_id", "seq", F.lit(tx.PROMPT_VERSION).cast("long").alias("prompt_version"), (n % 7).alias("attempts"), F.lit("timeout").alias("last_error"), F.col("ts_ms").alias("last_attempt_ms"))


def delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("external_id").cast("long"), F.col("seq")
    drives = turns(spark, sf_dir).where(F.col("role") == "assistant")
    return drives.select("device", "tool", "external_id", pick(["claude_code", "claude_chat", "codex"], (n + s) % 3).alias("driven_tool"), F.col("ts_ms").alias("occurred_ms"), (s % 3 + 1).alias("turns"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, u = F.col("event_id"), F.col("user_id")
    apps = ["mail.google.com", "drive.google.com", "", None, "docs.google.com", "other", "slack", "calendar.google.com"]
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    kind = F.when(F.col("event_type") == "view", "read_only").otherwise("mutating")
    return e.select(device(u).alias("device"), F.lit("bridge").alias("source"), n.cast("string").alias("ext_id"), u.cast("string").alias("session_id"), pick(["agent", "human", "agent"], u % 3).alias("actor"), pick(apps, u % 8).alias("app"), pick(["connector", "shortcut", "browser", "browser", "connector"], n % 5).alias("tool"), F.col("event_type").alias("action"), kind.alias("kind"), F.floor(ms).cast("long").alias("ts_ms"))


def big_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user of events, turns numbered by event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("external_id"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"))


_n, _apps = "CAST(external_id AS BIGINT)", ["mail.google.com", "drive.google.com", "", None, "docs.google.com", "other", "slack", "calendar.google.com"]
#: The same tables for DuckDB, each a common table expression.
SQL = {
    "devices": "SELECT 'd' || k AS device, 'p' || (k % 4) AS person, 'laptop ' || k AS device_name, CAST((k % 5 - 2) * 90 AS INTEGER) AS offset_min FROM (SELECT unnest(range(7)) AS k)",
    "turns": f"""SELECT 'd' || (conv_id % 7) AS device, {sql_pick(TOOLS, 'conv_id % 6')} AS tool, CAST(conv_id AS VARCHAR) AS external_id, turn AS seq,
        CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END AS role, text AS redacted_text,
        {EPOCH} + conv_id * 10800000 + turn * 240000 + (turn // 4) * 2700000 AS ts_ms FROM conversations""",
    "sessions": f"""SELECT device, tool, external_id, {sql_pick(['anthropic', 'openai', 'google', 'openai', 'openai'], _n + ' % 5')} AS provider,
        CASE WHEN tool LIKE '%-web' THEN 'web' ELSE 'cli' END AS surface, {sql_pick(MODELS, _n + ' % 5')} AS model, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, count(*) AS message_count FROM turns GROUP BY ALL""",
    "turn_labels": f"""SELECT device, tool, external_id, seq, CAST({tx.TAXONOMY_VERSION} AS BIGINT) AS taxonomy_version, ({_n} + seq) % 2 + 1 AS prompt_version,
        {sql_pick(tx.INTENTS, f'({_n} * 5 + seq) % {len(tx.INTENTS)}')} AS intent, {sql_pick(tx.DOMAINS, f'({_n} * 3 + seq) % {len(tx.DOMAINS)}')} AS domain, ({_n} + seq) % 4 + 1 AS depth,
        {sql_pick(tx.DELEGATIONS, f'({_n} + seq) % 3')} AS delegation, {sql_pick(tx.DELEGATE_TARGETS, f'({_n} + seq) % {len(tx.DELEGATE_TARGETS)}')} AS delegate_tool, (({_n} + seq) % 10) / 10.0 AS confidence, ts_ms AS analyzed_ms
        FROM turns WHERE role = 'user' AND ({_n} + seq) % 3 <> 0""",
    "label_failures": f"SELECT device, tool, external_id, seq, {_n} % 7 AS attempts FROM turns WHERE role = 'user' AND ({_n} + seq) % 3 = 0",
    "delegations": f"SELECT device, tool, external_id, {sql_pick(['claude_code', 'claude_chat', 'codex'], f'({_n} + seq) % 3')} AS driven_tool, ts_ms AS occurred_ms, seq % 3 + 1 AS turns FROM turns WHERE role = 'assistant'",
    "actions": f"""SELECT 'd' || (user_id % 7) AS device, 'bridge' AS source, CAST(event_id AS VARCHAR) AS ext_id, CAST(user_id AS VARCHAR) AS session_id, {sql_pick(['agent', 'human', 'agent'], 'user_id % 3')} AS actor,
        {sql_pick(_apps, 'user_id % 8')} AS app, {sql_pick(['connector', 'shortcut', 'browser', 'browser', 'connector'], 'event_id % 5')} AS tool, event_type AS action,
        CASE WHEN event_type = 'view' THEN 'read_only' ELSE 'mutating' END AS kind, epoch_us(ts) // 1000 AS ts_ms FROM events""",
    "engaged": """SELECT device, tool, external_id, sum(CASE WHEN gap > 0 AND gap <= 1800000 THEN gap ELSE 0 END) AS active_ms
        FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY device, tool, external_id ORDER BY seq) AS gap FROM turns) GROUP BY ALL""",
    "spans": """SELECT s.device, strftime(make_timestamp_ms(started_ms + offset_min * 60000), '%Y-%m-%d') AS day, s.tool, count(*) AS sessions,
        CAST(sum(coalesce(active_ms, 0)) // 60000 AS BIGINT) AS total_minutes, CAST(max(coalesce(active_ms, 0)) // 60000 AS BIGINT) AS longest_minutes
        FROM sessions s LEFT JOIN engaged USING (device, tool, external_id) JOIN devices USING (device) GROUP BY ALL""",
    "cells": f"""SELECT device, strftime(make_timestamp_ms(t.ts_ms + offset_min * 60000), '%Y-%m-%d') AS day, CAST(((t.ts_ms + offset_min * 60000) % 86400000) // 3600000 AS INTEGER) AS hour,
        tool, provider, surface, s.model, intent, domain, depth, delegation, delegate_tool, count(*) AS turns, count(DISTINCT external_id) AS sessions, CAST(sum(length(redacted_text)) AS BIGINT) AS chars
        FROM turn_labels l JOIN sessions s USING (device, tool, external_id) JOIN turns t USING (device, tool, external_id, seq) JOIN devices USING (device)
        WHERE taxonomy_version = {tx.TAXONOMY_VERSION} GROUP BY ALL""",
    "drives": """SELECT device, strftime(make_timestamp_ms(occurred_ms + offset_min * 60000), '%Y-%m-%d') AS day, tool, driven_tool, CAST(sum(turns) AS BIGINT) AS turns FROM delegations JOIN devices USING (device) GROUP BY ALL""",
}
NEEDS = {
    "sessions": ["turns"], "turn_labels": ["turns"], "label_failures": ["turns"], "delegations": ["turns"], "engaged": ["turns"], "spans": ["devices", "sessions", "engaged"],
    "cells": ["devices", "turn_labels", "sessions", "turns"], "drives": ["devices", "delegations"],
}


def oracle(body: str, *tables: str) -> str:
    """DuckDB SQL: the named bridge tables and what they need, then the body (SELECT ..., or more expressions and SELECT)."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    head = ",\n".join(f"{t} AS ({SQL[t]})" for t in order)
    return f"WITH {head}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"
