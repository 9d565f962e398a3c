"""Queries over sources with cursors, the store of pushes and the label queue: each runs twice or more, and must end where one pass would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import taxonomy as tx
from turnlake.plans import bridge, raw
from turnlake.plans.registry import fact_rows, registered
from turnlake.sources import incremental, label_store, logs, sinks
from turnlake.sources.file_index import FileIndex, listing
from turnlake.sources.store import SnapshotStore
from turnlake.streaming import ingest, label_queue


def drained(stream: DataFrame, base: str) -> DataFrame:
    """One run of a stream that goes on from its checkpoint; all that its runs have written."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@registered("hook_events_resumed", "SELECT device, session_id || chr(31) || ext_id AS ext_id, session_id, app, CASE WHEN kind = 'read_only' THEN 'mail.list' ELSE 'mail.send' END AS action, kind, ts_ms FROM actions WHERE tool <> 'browser'", "actions")
def hook_events_resumed(spark, d):
    """A hook table that lands in two parts, the second with all rows of the first again: ids up to the cursor aren't read twice."""
    rows, base = raw.hook_rows(spark, d), sinks.landing(spark, "hook-events")
    middle = rows.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    for part in (rows.where(F.col("event_id") <= middle), rows):
        part.write.mode("append").partitionBy("device").parquet(f"{base}/table")
        acts = logs.hook_events(incremental.hook_table(spark, f"{base}/table", stream=True))[0]
        out = drained(acts.select("device", "ext_id", "session_id", "app", "action", "kind", "ts_ms"), base)
    return out


@registered("gateway_log_tailed", "SELECT device, 'gw' || chr(31) || ts_ms || chr(31) || ext_id || chr(31) || action AS ext_id, action, 'run ' || ext_id AS target_redacted, ts_ms FROM actions WHERE ts_ms % 3 <> 0", "actions")
def gateway_log_tailed(spark, d):
    """Gateway logs of all devices, read by byte offset after each of two landings."""
    lines, base = raw.gateway_lines(spark, d), sinks.landing(spark, "gateway-log")
    early = F.crc32("value") % 2 == 0
    for part in (lines.where(early), lines.where(~early)):
        part.write.mode("append").partitionBy("device").text(f"{base}/logs")
        acts = logs.gateway_log(incremental.growing_lines(spark, f"{base}/logs", stream=True, glob="*.txt"))
        out = drained(acts.select("device", "ext_id", "action", "target_redacted", "ts_ms"), base)
    return out


@registered(
    "files_changed",
    """SELECT device, CAST(count(*) FILTER (WHERE half = 0) > 0 AS BIGINT) AS known, CAST(count(*) FILTER (WHERE half = 1) > 0 AS BIGINT) AS changed, CAST(count(*) AS BIGINT) AS lines
    FROM (SELECT device, CAST(external_id AS BIGINT) % 2 AS half FROM turns) GROUP BY device""",
    "turns",
)
def files_changed(spark, d):
    """Transcripts that land in two parts: the kept index of the first lets only the files of the second pass."""
    t, base = bridge.turns(spark, d), sinks.landing(spark, "file-index")
    index = FileIndex(spark, f"{base}/index")
    here = F.nullif(F.regexp_extract("file", "device=([^/]+)/", 1), F.lit("")).alias("device")
    counts = []
    for half in (0, 1):
        part = t.where(F.col("external_id").cast("long") % 2 == half).select("device", F.concat_ws("-", "external_id", "seq").alias("value"))
        part.repartition("device").write.mode("append").partitionBy("device").text(f"{base}/files")
        fresh = index.changed(listing(spark, f"{base}/files", "*.txt"), half, cooldown_ms=0)
        counts.append(sinks.written(fresh.groupBy(here).agg(F.count("*").alias(("known", "changed")[half])), f"{base}/count{half}"))
        index.parsed(fresh, half)
    lines = incremental.growing_lines(spark, f"{base}/files", glob="*.txt").groupBy("device").agg(F.count("*").alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return lines.join(counts[0], "device", "left").join(counts[1], "device", "left").select("device", zero("known"), zero("changed"), "lines")


def pushed(spark, d) -> SnapshotStore:
    """A store after three pushes: all devices with wrong numbers, all again, then device d2 with one tool only."""
    rows = sinks.written(fact_rows(spark, d).where("kind = 'session_span'"), f"{sinks.landing(spark, 'spans')}/rows")
    store = SnapshotStore(spark, f"{sinks.landing(spark, 'store')}/store", buckets=16)
    stamped = lambda df, n: df.withColumn("received_ms", F.lit(n).cast("long"))
    store.apply(stamped(rows.withColumn("total_minutes", F.lit(-1).cast("long")), 1), "devices", 0)
    store.apply(stamped(rows, 2), "devices", 1)
    store.apply(stamped(rows, 2), "devices", 1)  # a batch that comes again
    store.apply(stamped(rows.where("device = 'd2' AND tool = 'codex'"), 3), "devices", 2)
    return store


@registered("store_rows", "SELECT device, day, tool, sessions, total_minutes, longest_minutes FROM spans WHERE device <> 'd2' OR tool = 'codex'", "spans")
def store_rows(spark, d):
    return pushed(spark, d).rows().select("device", "day", "tool", "sessions", "total_minutes", "longest_minutes")


@registered(
    "store_week_totals",
    """SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, person, tool, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total_minutes) AS BIGINT) AS total_minutes, CAST(max(longest_minutes) AS BIGINT) AS longest_minutes, count(*) AS rows
    FROM spans JOIN devices USING (device) WHERE device <> 'd2' OR tool = 'codex' GROUP BY ALL""",
    "spans", "devices",
)
def store_week_totals(spark, d):
    """The totals that the store keeps beside its rows."""
    return pushed(spark, d).week_totals().select("week", "person", "tool", "sessions", "total_minutes", "longest_minutes", "rows")


def by_length(text: str) -> dict:
    """A labeler that fails for every fifth length of a text."""
    if len(text) % 5 == 0:
        raise ValueError("no label")
    return {"intent": tx.INTENTS[0], "domain": tx.DOMAINS[0], "depth": 1, "delegation": "none", "delegate_tool": "none", "confidence": 1.0}


@registered(
    "labels_streamed",
    """SELECT device, tool, external_id, seq, CASE WHEN length(coalesce(redacted_text, '')) % 5 = 0 THEN 2 ELSE 1 END AS tries, CASE WHEN length(coalesce(redacted_text, '')) % 5 = 0 THEN 'retired' ELSE 'labeled' END AS state FROM turns WHERE role = 'user'""",
    "turns",
)
def labels_streamed(spark, d):
    """All user turns through the label queue, with two tries: each run takes up where the one before it ended."""
    base, provider = sinks.landing(spark, "label-queue"), "spark.sql.streaming.stateStore.providerClass"
    asked = bridge.turns(spark, d).where("role = 'user'").select(*label_queue.KEY, F.col("redacted_text").alias("request"))
    asked.write.parquet(f"{base}/turns")
    before = spark.conf.get(provider)
    spark.conf.set(provider, ingest.STATE_STORE)
    try:
        for _ in range(3):  # first tries, second tries, what came of them
            turns = spark.readStream.schema(asked.schema).parquet(f"{base}/turns")
            label_queue.run_queue(spark, turns, f"{base}/results", f"{base}/retired", f"{base}/checkpoint", by_length, retry_ms=0, most=2).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    read = lambda what, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/{what}")
    labels = read("results", label_queue.RESULTS).where("last_error IS NULL").select(*label_queue.KEY, F.col("attempt").alias("tries"), F.lit("labeled").alias("state"))
    retired = read("retired", f"{label_queue.KEYS}, attempt int, last_error string").select(*label_queue.KEY, F.col("attempt").alias("tries"), F.lit("retired").alias("state"))
    return labels.unionByName(retired)


@registered("labels_purged", f"SELECT device, tool, external_id, seq, intent, depth FROM turn_labels WHERE taxonomy_version = {tx.TAXONOMY_VERSION} AND prompt_version = {tx.PROMPT_VERSION}", "turn_labels")
def labels_purged(spark, d):
    """Labels of all versions, written by version; the folders of superseded ones are dropped."""
    rows, path = bridge.labels(spark, d), sinks.landing(spark, "labels")
    label_store.append(rows, path, "labels")
    label_store.purge(spark, path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return label_store.read(spark, path, "labels", ddl).select(*label_queue.KEY, "intent", "depth")
