"""Actions from hook events, gateway and narrator logs, and voice traces. Targets are redacted before they are cut (OP-49)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import text as tf
from turnlake.functions.redaction import redacted
from turnlake.sources.transcripts import text_of

SOURCE = "voice-shortcuts"
COLUMNS = ["source", "ext_id", "session_id", "actor", "app", "tool", "action", "kind", "target_redacted", "ts_ms"]


def action(df: DataFrame, **values) -> DataFrame:
    """df's other columns dropped; an action row of the given columns or constants."""
    made = {k: v if hasattr(v, "alias") else F.lit(v).cast("string") for k, v in values.items()}
    keep = [c for c in ("device",) if c in df.columns]
    return df.select(*keep, *[made.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def hook_events(events: DataFrame, cursor: int = -1) -> tuple[DataFrame, DataFrame]:
    """Actions of runtime hook events after the cursor, and the new cursor, which also counts dropped rows (OP-05).

    source_ref is session:call, split at the last colon; the session_id column wins over it.
    """
    new = events.where(F.col("event_id") > cursor)
    args = F.try_parse_json(F.coalesce("args_json", F.lit("null")))
    rows = new.where("tool = 'app_runtime'").withColumn("a", cl.tool_call(F.lit("app_runtime"), args)).where("a IS NOT NULL")
    split = F.col("source_ref").contains(":")
    session = F.coalesce(F.nullif("session_id", F.lit("")), F.when(split, F.regexp_extract("source_ref", "^(.*):([^:]*)$", 1)), F.lit(""))
    call = F.when(split, F.regexp_extract("source_ref", "^(.*):([^:]*)$", 2)).otherwise(F.col("source_ref"))
    acts = action(rows, source="hook", ext_id=F.concat_ws("\u001f", session, call), session_id=session, actor="agent", app=F.col("a.app"), tool=F.col("a.tool"), action=F.col("a.action"), kind=F.col("a.kind"), target_redacted=F.col("a.target"), ts_ms=F.col("ts"))
    acts = redacted(acts, "target_redacted").withColumn("target_redacted", tf.hook_preview(F.col("target_redacted")))
    return acts, new.agg(F.coalesce(F.max("event_id"), F.lit(cursor)).alias("cursor"))


def gateway_log(lines: DataFrame) -> DataFrame:
    """Human shortcut runs of lines (column value) that say a run's window started (OP-06)."""
    marker = r"^(.*?)\[action-gate-ui\] ui started (.*)$"
    rows = lines.withColumns({"head": F.regexp_extract("value", marker, 1), "rest": F.regexp_extract("value", marker, 2)}).withColumn("ts_ms", tf.epoch_ms(F.col("head")))
    run = F.coalesce(F.regexp_extract("rest", r"(?:^|\s)run=(\S+)", 1).try_cast("long"), F.lit(0))
    key = F.regexp_extract("rest", r"(?:^|\s)key=(\S*)", 1)
    title = F.regexp_replace(F.regexp_extract("rest", r'title="(.*)$', 1), '"+$', "")
    rows = rows.withColumns({"run": run, "key": key, "title": title}).where("ts_ms IS NOT NULL AND key NOT IN ('', '-')")
    ext = F.concat_ws("\u001f", F.lit("gw"), F.col("ts_ms").cast("string"), F.col("run").cast("string"), "key")
    return redacted(action(rows, source=SOURCE, ext_id=ext, session_id="voice", actor="human", app="voice", tool="shortcut", action=F.col("key"), kind="mutating", target_redacted=F.col("title"), ts_ms=F.col("ts_ms")), "target_redacted")


def narrator_log(lines: DataFrame) -> DataFrame:
    """Connector steps of action-gate lines with status ok (OP-07). lines: value, file, line, seen_ms.

    Each command= token pairs with the dotted step before it, or else with the shortcut's name.
    """
    shape = r'^\[voice/action-gate\] action gate: (\S+) "[^"]*".*?→ ok(?: (.*))?$'
    rows = lines.withColumns({"shortcut": F.regexp_extract("value", shape, 1), "rest": F.regexp_extract("value", shape, 2)}).where(F.col("value").rlike(shape))
    dotted = lambda t: ~t.startswith("(") & ~t.startswith("status=") & ~t.endswith(")") & t.contains(".")
    zero = F.struct(F.lit(None).cast("string").alias("step"), F.array().cast("array<struct<step:string,app:string>>").alias("out"))

    def fold(acc, t):
        paired = F.struct(F.lit(None).cast("string").alias("step"), F.concat(acc["out"], F.array(F.struct(F.coalesce(acc["step"], "shortcut").alias("step"), F.substr(t, F.lit(9)).alias("app")))).alias("out"))
        return F.when(t.startswith("command="), paired).when(dotted(t), F.struct(t.alias("step"), acc["out"].alias("out"))).otherwise(acc)

    steps = F.aggregate(F.split("rest", r"\s+"), zero, fold)["out"]
    each = rows.select(*[c for c in ("device",) if c in rows.columns], "file", "line", "seen_ms", F.posexplode(steps).alias("i", "s"))
    ext = F.concat(F.concat_ws("\u001f", F.lit("narr"), "file", F.col("line").cast("string")), F.lit("\u001fconn"), F.col("i").cast("string"))
    return action(each, source=SOURCE, ext_id=ext, session_id="voice", actor="agent", app=F.col("s.app"), tool="connector", action=F.col("s.step"), kind="mutating", ts_ms=F.col("seen_ms"))


def voice_trace(lines: DataFrame) -> DataFrame:
    """Human shortcut runs of executed action-gate records (OP-08)."""
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("value")).where((text_of(v, "$.cat") == "action-gate") & (text_of(v, "$.msg") == "executed"))
    number = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0)).cast("string")
    rows = rows.withColumns({"ts_ms": tf.epoch_ms(text_of(v, "$.ts")), "shortcut": text_of(v, "$.tool")}).where("ts_ms IS NOT NULL AND shortcut IS NOT NULL")
    ext = F.concat_ws(":", text_of(v, "$.ts"), number("pid"), number("runId"), "shortcut")
    return redacted(action(rows, source=SOURCE, ext_id=ext, session_id=F.coalesce(text_of(v, "$.sessionKey"), F.lit("voice")), actor="human", app="voice", tool="shortcut", action=F.col("shortcut"), kind="mutating", target_redacted=text_of(v, "$.command"), ts_ms=F.col("ts_ms")), "target_redacted")
