"""Rollups of turns, labels, actions and delegations into the usage facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import text as tf
from turnlake.operators.dedupe import SESSION
from turnlake.operators.labeling import of_version

GAP_MS = 30 * 60_000


def engaged(turns: DataFrame, key: list[str] = SESSION, gap_ms: int = GAP_MS) -> DataFrame:
    """active_ms of each session: the gaps between consecutive turns that are above 0 and at most gap_ms (OP-78)."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*key).orderBy("seq"))
    gaps = turns.select(*key, gap.alias("gap"))
    return gaps.groupBy(*key).agg(F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") <= gap_ms), F.col("gap"))), F.lit(0)).alias("active_ms"))


def with_local_time(rows: DataFrame, devices: DataFrame, ms: str) -> DataFrame:
    """rows with day and hour on the clock of their device. devices is one small row for each device."""
    joined = rows.join(devices.select("device", "offset_min"), "device", "left")
    offset = F.coalesce("offset_min", F.lit(0))
    return joined.withColumns({"day": tf.local_day(F.col(ms), offset), "hour": tf.local_hour(F.col(ms), offset)}).drop("offset_min")


def session_spans(sessions: DataFrame, turns: DataFrame, devices: DataFrame) -> DataFrame:
    """Sessions, engaged minutes and longest minutes by device, start day and tool; minutes are cut after summing (OP-62, OP-29)."""
    active = sessions.join(engaged(turns), SESSION, "left").withColumn("active_ms", F.coalesce("active_ms", F.lit(0)))
    dated = with_local_time(active, devices, "started_ms")
    minutes = lambda c: F.expr(f"{c} div 60000")
    sums = dated.groupBy("device", "day", "tool").agg(F.count("*").alias("sessions"), F.sum("active_ms").alias("_sum"), F.max("active_ms").alias("_max"))
    return sums.select("device", "day", "tool", "sessions", minutes("_sum").alias("total_minutes"), minutes("_max").alias("longest_minutes"))


def label_cells(labels: DataFrame, sessions: DataFrame, turns: DataFrame, devices: DataFrame) -> DataFrame:
    """turns, sessions and chars by device, local day and hour and the label's dimensions; a null model is a group (OP-61, OP-28).

    Sessions are counted by first reducing to (dimensions, session), so that no distinct aggregate expands the rows.
    """
    facts = of_version(labels, prompt_version=None).drop("model").join(sessions.select(*SESSION, "provider", "surface", "model"), SESSION)
    facts = facts.join(turns.select(*SESSION, "seq", "ts_ms", F.length("redacted_text").cast("long").alias("n")), [*SESSION, "seq"])
    dims = ["device", "day", "hour", "tool", "provider", "surface", "model", "intent", "domain", "depth", "delegation", "delegate_tool"]
    each = with_local_time(facts, devices, "ts_ms").groupBy(*dims, "external_id").agg(F.count("*").alias("t"), F.sum("n").alias("c"))
    return each.groupBy(*dims).agg(F.sum("t").alias("turns"), F.count("*").alias("sessions"), F.sum("c").alias("chars"))


def usage_spans(actions: DataFrame, devices: DataFrame, kind: str) -> DataFrame:
    """Runs of connector or shortcut actions by device, local day, name (of the app, or unknown) and detail (OP-63)."""
    name = F.coalesce(F.nullif("app", F.lit("")), F.lit("unknown")).alias("name")
    dated = with_local_time(actions.where(F.col("tool") == kind), devices, "ts_ms")
    return dated.groupBy("device", "day", name, F.col("action").alias("detail")).agg(F.count("*").alias("runs"))


def delegation_spans(delegations: DataFrame, sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Drives by device, local day of the drive, tool and driven tool (OP-64)."""
    known = delegations.join(sessions.select(*SESSION), SESSION, "left_semi")
    return with_local_time(known, devices, "occurred_ms").groupBy("device", "day", "tool", "driven_tool").agg(F.sum("turns").alias("turns"))


def action_stats(actions: DataFrame, since_ms: int = 0) -> DataFrame:
    """Actions by app, actor and kind (OP-65)."""
    return actions.where(F.col("ts_ms") >= since_ms).groupBy("app", "actor", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "app", "actor", "kind")


def activity_stats(sessions: DataFrame, actions: DataFrame, since_ms: int) -> DataFrame:
    """interactions, actions, connectors, shortcuts and the last activity of each device (OP-66)."""
    s = sessions.select("device", (F.col("ended_ms") >= since_ms).cast("long").alias("i"), F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0).alias("s"), F.col("ended_ms").alias("at"))
    new = (F.col("ts_ms") >= since_ms).cast("long")
    a = actions.select("device", F.lit(0).alias("i"), new.alias("a"), (new * (F.col("tool") == "connector").cast("long")).alias("c"), (new * (F.col("tool") == "shortcut").cast("long")).alias("s"), F.col("ts_ms").alias("at"))
    sums = {"i": "interactions", "a": "actions", "c": "connectors", "s": "shortcuts"}
    return s.unionByName(a).groupBy("device").agg(*[F.sum(k).cast("long").alias(v) for k, v in sums.items()], F.max("at").alias("last_ms"))


def ingest_census(turns: DataFrame, file: str = "file") -> DataFrame:
    """Files, sessions and messages by tool (OP-70)."""
    one = turns.groupBy("tool", "device", "external_id").agg(F.count("*").alias("m"))
    files = turns.select("tool", file).distinct().groupBy("tool").agg(F.count("*").alias("files"))
    return one.groupBy("tool").agg(F.count("*").alias("sessions"), F.sum("m").alias("messages")).join(files, "tool").select("tool", "files", "sessions", "messages")


def busiest_app(actions: DataFrame) -> DataFrame:
    """The named app with most mutating actions, by agents and by people; no row if there is none. Ties: app ascending (OP-71)."""
    named = actions.where((F.col("kind") == "mutating") & (F.col("app") != "") & (F.col("app") != "other"))
    by_app = named.groupBy("app").agg(F.count_if(F.col("actor") == "agent").alias("agent"), F.count_if(F.col("actor") == "human").alias("human"))
    top = by_app.where("agent + human > 0").orderBy(F.desc(F.col("agent") + F.col("human")), "app").limit(1)
    return top.select(cl.app_label(F.col("app")).alias("app"), "agent", "human")


def leaderboard(cells: DataFrame, devices: DataFrame, since_day: str) -> DataFrame:
    """Turns and sessions by person and tool name from a day on (OP-75)."""
    named = cells.where(F.col("day") >= since_day).join(devices.select("device", "person"), "device", "left")
    sums = named.groupBy("person", cl.tool_name(F.col("tool")).alias("tool_name")).agg(F.sum("turns").alias("turns"), F.sum("sessions").alias("sessions"))
    return sums.orderBy(F.desc("turns"), "person", "tool_name")


def provider_turns(cells: DataFrame) -> DataFrame:
    return cells.groupBy("provider").agg(F.sum("turns").alias("turns"))


def coverage(cells: DataFrame) -> DataFrame:
    """The share of turns labelled `other`, by day (OP-76)."""
    other = F.sum(F.when(F.col("intent") == "other", F.col("turns")).otherwise(0))
    return cells.groupBy("day").agg(other.alias("other_turns"), F.sum("turns").alias("turns")).withColumn("share", F.col("other_turns") / F.col("turns"))
