"""Chats and actions that a browser extension sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import redaction
from turnlake.functions import taxonomy as tx
from turnlake.functions.text import trimmed

CHAT = "tool string, external_id string, model string, turns array<struct<role:string,text:string,ts_ms:bigint>>"
ACTIONS = "actions array<struct<ext_id:string,app:string,action:string,kind:string,session_id:string,ts_ms:bigint>>"


def web_chats(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of chat messages (device, arrived_ms, value) and the messages rejected for their tool or shape (OP-09).

    pos orders the turns of a session over all its messages; an unlisted role becomes unknown. Texts are redacted (OP-49).
    """
    parsed = messages.withColumn("m", F.from_json("value", CHAT))
    good = F.coalesce(F.col("m.tool").isin(list(tx.WEB_TOOLS)) & F.col("m.external_id").isNotNull() & F.col("m.turns").isNotNull(), F.lit(False))
    rows = parsed.where(good).select("device", "arrived_ms", "m.tool", "m.external_id", "m.model", F.posexplode("m.turns").alias("i", "t"))
    role = F.when(F.col("t.role").isin("user", "assistant"), F.col("t.role")).otherwise("unknown")
    turns = rows.select("device", "tool", "external_id", "model", cl.mapped(F.col("tool"), tx.WEB_TOOLS).alias("provider"), F.struct("arrived_ms", "i").alias("pos"), role.alias("role"), trimmed(F.col("t.text")).alias("redacted_text"), F.col("t.ts_ms").alias("ts_ms"))
    return redaction.gated_turns(turns.where("redacted_text <> ''")), parsed.where(~good).drop("m")


def web_actions(batches: DataFrame) -> DataFrame:
    """Human actions of allow-listed apps with an id and a name; details are never kept (OP-10)."""
    rows = batches.select("device", F.explode(F.from_json("value", ACTIONS)["actions"]).alias("a")).select("device", "a.*")
    kept = rows.where((F.col("ext_id") != "") & (F.col("action") != "") & F.col("app").isin(list(tx.APP_LABELS)))
    kind = F.when(F.col("kind") == "read_only", "read_only").otherwise("mutating")
    return kept.select("device", F.lit("web-extension").alias("source"), "ext_id", F.coalesce("session_id", F.lit("")).alias("session_id"), F.lit("human").alias("actor"), "app", F.lit("browser").alias("tool"), "action", kind.alias("kind"), F.lit(None).cast("string").alias("target_redacted"), "ts_ms")
