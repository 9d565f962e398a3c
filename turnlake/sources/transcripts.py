"""Chat transcripts of three formats as turns, sessions, delegations and actions.

A transcript is one file of JSON lines. Lines are rows, and a large file is read by many tasks: a line's place is its stretch (where
the piece of the file that a task reads begins) and its row there. What holds for a whole file, and how many turns its earlier
stretches have, is aggregated to one row a stretch and joined back, so that no task holds more of a file than a stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import redaction
from turnlake.functions import text as tf
from turnlake.operators.dedupe import SESSION


@dataclass
class Parsed:
    """What a source gives: turns, sessions, and delegations where the format has them."""

    turns: DataFrame
    sessions: DataFrame
    delegations: DataFrame | None = None


LINE = ["file", "stem", "device", "modified_ms", "stretch", "pos"]


def files(spark: SparkSession, path: str, pattern: str, modified_after: str | None = None) -> DataFrame:
    """LINE and `v` (a variant, null for a line that is no JSON) of each line of matching files.

    device comes from a path part `device=...`; OP-22's mark is the reader's modifiedAfter.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    # rows of a scan are numbered in the order in which its task reads them, and a stretch is read by one task
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), F.col("_metadata.file_block_start").alias("stretch"), F.monotonically_increasing_id().alias("pos"), parsed_line(F.col("value")).alias("v"))
    return placed(raw)


def with_lines(raw: DataFrame) -> DataFrame:
    """The same of raw (file, modified_ms, value), whose values are whole files; each is one stretch."""
    lines = F.transform(F.split("value", "\r?\n"), parsed_line)
    return placed(raw.select("file", "modified_ms", F.lit(0).cast("long").alias("stretch"), F.posexplode(lines).alias("pos", "v")))


def parsed_line(line: Column) -> Column:
    return F.when(line.rlike(r"\S"), F.try_parse_json(line))


def placed(lines: DataFrame) -> DataFrame:
    name = F.element_at(F.split("file", "/"), -1)
    device = F.nullif(F.regexp_extract("file", "device=([^/]+)/", 1), F.lit(""))
    return lines.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "device": F.coalesce(device, F.lit("unknown")), "pos": F.col("pos").cast("long")}).select(*LINE, "v")


def with_file_values(rows: DataFrame, counted: Column, first: dict[str, str], last: dict[str, str] | None = None) -> DataFrame:
    """rows with the first or last non-null value of columns of their file, and `before`: the sum of `counted` over its earlier stretches.

    first and last map new columns to columns of rows, which are dropped.
    """
    last = last or {}
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    firsts, lasts = [F.min_by(c, seen(c)).alias(n) for n, c in first.items()], [F.max_by(c, seen(c)).alias(n) for n, c in last.items()]
    stretches = rows.groupBy("file", "stretch").agg(F.sum(counted.cast("long")).alias("before"), *firsts, *lasts)
    w = Window.partitionBy("file").orderBy("stretch")  # one row for each piece of a file
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = [F.first(n, ignorenulls=True).over(whole).alias(n) for n in first] + [F.last(n, ignorenulls=True).over(whole).alias(n) for n in last]
    heads = stretches.select("file", "stretch", F.coalesce(F.sum("before").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), *held)
    return rows.drop(*first.values(), *last.values()).join(heads, ["file", "stretch"])


def text_of(v: Column, path: str) -> Column:
    """A string at a path of a variant; other types give null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def stamp_of(v: Column, path: str, numbers: bool = False) -> Column:
    """Epoch ms at a path: an RFC 3339 string, or a whole number where allowed (OP-41)."""
    found = tf.epoch_ms(text_of(v, path))
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.coalesce(found, whole) if numbers else found


def blocks_text(v: Column, path: str = "$.message.content") -> Column:
    """The trimmed, non-blank text blocks of an assistant message, one a line; null if there is none."""
    blocks = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: text_of(b, "$.type") == "text"), lambda b: tf.trimmed(text_of(b, "$.text")))
    return F.nullif(F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n"), F.lit(""))


def assembled(rows: DataFrame, tool: str, surface: str = "cli") -> Parsed:
    """Turns and sessions of rows with device, external_id, file, modified_ms, model, provider, stretch, pos, before, role, redacted_text, ts_ms.

    Rows without a role only stretch the session. Rows with one are numbered within the file, `before` of them in earlier stretches; `ord` orders versions. Texts are
    redacted here, so that no raw text of a transcript is ever written (OP-49).
    """
    order = F.struct("modified_ms", "file")
    named = rows.withColumns({"tool": F.lit(tool), "ord": order})
    said = named.where(F.col("role").isNotNull())
    w = Window.partitionBy("file", "stretch").orderBy("pos")
    turns = redaction.gated_turns(said).withColumn("seq", F.col("before") + F.row_number().over(w) - 1).select(*SESSION, "seq", "role", "redacted_text", "ts_ms", "ord", "file")
    sessions = named.groupBy(*SESSION, "ord", "provider", "model").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.count("role").alias("message_count")).withColumn("surface", F.lit(surface))
    return Parsed(turns, sessions)


def claude_code(lines: DataFrame) -> Parsed:
    """Turns of `type` user and assistant with a stamp; user text is a plain string and no command's echo (OP-01, OP-18, OP-21)."""
    v = F.col("v")
    kind, ts, asked = text_of(v, "$.type"), stamp_of(v, "$.timestamp"), tf.trimmed(text_of(v, "$.message.content"))
    text = F.when(kind == "user", F.when((asked != "") & ~tf.is_noise(asked), asked)).when(kind == "assistant", blocks_text(v))
    model = F.when((kind == "assistant") & ts.isNotNull(), text_of(v, "$.message.model"))
    rows = lines.select(*LINE, kind.alias("role"), text.alias("redacted_text"), ts.alias("ts_ms"), text_of(v, "$.sessionId").alias("_id"), model.alias("_model"), F.lit("anthropic").alias("provider"))
    turn = F.expr("redacted_text IS NOT NULL AND ts_ms IS NOT NULL")
    rows = with_file_values(rows, turn, {"external_id": "_id", "model": "_model"})
    return assembled(rows.where(turn & F.col("external_id").isNotNull()), "claude-code")


def codex(lines: DataFrame) -> Parsed:
    """Turns of event messages; the last session id and the first model of the file hold, else the file's name (OP-02)."""
    v = F.col("v")
    typed = lambda name, path: F.when(text_of(v, "$.type") == name, text_of(v, path))
    of = typed("event_msg", "$.payload.type")
    role = F.when(of == "user_message", "user").when(of == "agent_message", "assistant")
    text = F.nullif(tf.trimmed(text_of(v, "$.payload.message")), F.lit(""))
    rows = lines.select(*LINE, role.alias("role"), text.alias("redacted_text"), stamp_of(v, "$.timestamp").alias("ts_ms"), typed("session_meta", "$.payload.session_id").alias("_id"), typed("turn_context", "$.payload.model").alias("_model"))
    turn = F.expr("role IS NOT NULL AND redacted_text IS NOT NULL AND ts_ms IS NOT NULL")
    rows = with_file_values(rows, turn, {"model": "_model"}, {"external_id": "_id"}).where(turn)
    rows = rows.withColumns({"external_id": F.coalesce("external_id", "stem"), "provider": cl.provider(F.col("model"), F.lit("openai"))})
    return assembled(rows, "codex")


def calls(v: Column) -> Column:
    """The tool-call blocks of an assistant message as array<struct<id, name, args>>."""
    blocks = F.filter(F.try_variant_get(v, "$.message.content", "array<variant>"), lambda b: text_of(b, "$.type") == "toolCall")
    args = lambda b: F.coalesce(F.try_variant_get(b, "$.arguments", "variant"), F.try_variant_get(b, "$.input", "variant"))
    made = F.transform(blocks, lambda b: F.struct(F.nullif(text_of(b, "$.id"), F.lit("")).alias("id"), text_of(b, "$.name").alias("name"), args(b).alias("args")))
    return F.when(text_of(v, "$.message.role") == "assistant", made)


def stamped(v: Column) -> Column:
    return F.coalesce(stamp_of(v, "$.message.timestamp", numbers=True), stamp_of(v, "$.timestamp", numbers=True))


def openclaw(lines: DataFrame) -> Parsed:
    """Turns and drives of messages; sessions with any stamped message stay, also without a turn or drive (OP-03, OP-19, OP-35).

    Files named *.trajectory.jsonl are left out.
    """
    lines = lines.where(~F.col("file").endswith(".trajectory.jsonl"))
    v = F.col("v")
    kind, ts, said = text_of(v, "$.type"), stamped(v), text_of(v, "$.message.role")
    message = (kind == "message") & ts.isNotNull()
    text = F.when(said == "user", tf.inbound(text_of(v, "$.message.content"))).when(said == "assistant", blocks_text(v))
    model = F.when(kind == "model_change", text_of(v, "$.modelId")).when(message, text_of(v, "$.message.model"))
    none = F.array().cast("array<struct<id:string,name:string,args:variant>>")
    rows = lines.select(*LINE, message.alias("message"), F.when(message & text.isNotNull(), said).alias("role"), text.alias("redacted_text"), ts.alias("ts_ms"), F.coalesce(calls(v), none).alias("calls"), F.when(kind == "session", text_of(v, "$.id")).alias("_id"), model.alias("_model"))
    rows = with_file_values(rows, F.col("role").isNotNull(), {"external_id": "_id", "model": "_model"}).where("message")
    rows = rows.withColumns({"external_id": F.coalesce("external_id", "stem"), "provider": cl.provider(F.col("model"), F.lit("openclaw"))})
    out = assembled(rows.drop("calls"), "openclaw")
    drives = rows.select("device", F.lit("openclaw").alias("tool"), "external_id", "ts_ms", F.explode("calls").alias("c"))
    drives = drives.select("device", "tool", "external_id", cl.driven_tool(F.col("c.name"), F.col("c.args")).alias("driven_tool"), F.col("ts_ms").alias("occurred_ms")).where("driven_tool IS NOT NULL")
    out.delegations = drives.groupBy(*SESSION, "driven_tool", "occurred_ms").agg(F.count("*").alias("turns"))
    return out


def agent_actions(lines: DataFrame, since_ms: int = 0, source: str = "openclaw") -> DataFrame:
    """One action for each tool call that is one, of any assistant message (OP-04, OP-33, OP-54).

    A call without an id is numbered within its file; without a session header the call's id stands for the session. The
    target is redacted, then cut to one line (OP-49).
    """
    v = F.col("v")
    made = F.transform(calls(v), lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), cl.tool_call(c["name"], c["args"]).alias("a")))
    acts = F.filter(made, lambda c: c["a"].isNotNull() & (c["name"] != ""))
    rows = lines.select("device", "file", "stretch", "pos", stamped(v).alias("ts"), acts.alias("acts"), F.when(text_of(v, "$.type") == "session", text_of(v, "$.id")).alias("_id"))
    unnamed = F.coalesce(F.size(F.filter("acts", lambda c: c["id"].isNull())), F.lit(0))
    rows = with_file_values(rows, F.greatest(unnamed, F.lit(0)), {"header": "_id"})
    acts = rows.select("*", F.posexplode("acts").alias("block", "c")).select("*", "c.a").withColumn("ts_ms", F.coalesce("ts", F.lit(0)))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("file", "stretch", F.col("c.id").isNull()).orderBy("pos", "block")) - 1
    call = F.coalesce("c.id", F.concat_ws("-", F.lit("auto"), F.col("ts_ms").cast("string"), nth.cast("string")))
    acts = acts.withColumn("call", call).withColumn("session_id", F.coalesce("header", "call")).where(F.col("ts_ms") >= since_ms)
    return redaction.gated_actions(acts.select("device", F.lit(source).alias("source"), F.concat_ws("\u001f", "session_id", "call").alias("ext_id"), "session_id", F.lit("agent").alias("actor"), "a.app", "a.tool", "a.action", "a.kind", F.col("a.target").alias("target_redacted"), "ts_ms"))
