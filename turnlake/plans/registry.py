"""All queries of the library outside the language-model subpackage, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import redaction
from turnlake.functions import taxonomy as tx
from turnlake.functions import text as tf
from turnlake.operators import dedupe, filters, labeling, recap, rollups
from turnlake.plans import bridge
from turnlake.sources import facts, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SINCE = 1_705_000_000_000


def registered(name: str, sql: str | None = None, *tables: str):
    """Register a query and, if SQL can express it, the DuckDB SQL over the named bridge tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = bridge.oracle(sql, *tables) if tables else sql
        return f

    return put


# --- rollups ---------------------------------------------------------------------------------------------------------


@registered("session_spans", "SELECT device, day, tool, sessions, total_minutes, longest_minutes FROM spans", "spans")
def session_spans(spark, d):
    return rollups.session_spans(bridge.sessions(spark, d), bridge.turns(spark, d), bridge.devices(spark))


@registered(
    "engaged_big",
    """SELECT user_id AS external_id, CAST(sum(CASE WHEN gap > 0 AND gap <= 1800000 THEN gap ELSE 0 END) AS BIGINT) AS active_ms
    FROM (SELECT user_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY user_id""",
)
def engaged_big(spark, d):
    return rollups.engaged(bridge.big_turns(spark, d), ["external_id"])


@registered("label_cells", "SELECT * FROM cells", "cells")
def label_cells(spark, d):
    return rollups.label_cells(bridge.labels(spark, d), bridge.sessions(spark, d), bridge.turns(spark, d), bridge.devices(spark))


USAGE_SQL = """SELECT device, strftime(make_timestamp_ms(ts_ms + offset_min * 60000), '%Y-%m-%d') AS day, coalesce(nullif(app, ''), 'unknown') AS name, action AS detail, count(*) AS runs
    FROM actions JOIN devices USING (device) WHERE tool = '{}' GROUP BY ALL"""


@registered("usage_connectors", USAGE_SQL.format("connector"), "actions", "devices")
def usage_connectors(spark, d):
    return rollups.usage_spans(bridge.actions(spark, d), bridge.devices(spark), "connector")


@registered("usage_shortcuts", USAGE_SQL.format("shortcut"), "actions", "devices")
def usage_shortcuts(spark, d):
    return rollups.usage_spans(bridge.actions(spark, d), bridge.devices(spark), "shortcut")


@registered("delegation_spans", "SELECT * FROM drives", "drives")
def delegation_spans(spark, d):
    return rollups.delegation_spans(bridge.delegations(spark, d), bridge.sessions(spark, d), bridge.devices(spark))


@registered("action_stats", f"SELECT app, actor, kind, count(*) AS n FROM actions WHERE ts_ms >= {SINCE} GROUP BY ALL", "actions")
def action_stats(spark, d):
    return rollups.action_stats(bridge.actions(spark, d), SINCE)


@registered(
    "activity_stats",
    f"""SELECT device, CAST(sum(i) AS BIGINT) AS interactions, CAST(sum(a) AS BIGINT) AS actions, CAST(sum(c) AS BIGINT) AS connectors, CAST(sum(s) AS BIGINT) AS shortcuts, max(seen) AS last_ms FROM (
    SELECT device, CAST(ended_ms >= {SINCE} AS INT) AS i, 0 AS a, 0 AS c, 0 AS s, ended_ms AS seen FROM sessions UNION ALL
    SELECT device, 0, CAST(ts_ms >= {SINCE} AS INT), CAST(ts_ms >= {SINCE} AND tool = 'connector' AS INT), CAST(ts_ms >= {SINCE} AND tool = 'shortcut' AS INT), ts_ms FROM actions) GROUP BY device""",
    "sessions",
    "actions",
)
def activity_stats(spark, d):
    return rollups.activity_stats(bridge.sessions(spark, d), bridge.actions(spark, d), SINCE)


@registered("ingest_census", "SELECT tool, count(DISTINCT device) AS files, count(DISTINCT external_id) AS sessions, count(*) AS messages FROM turns GROUP BY tool", "turns")
def ingest_census(spark, d):
    return rollups.ingest_census(bridge.turns(spark, d).withColumn("file", F.col("device")))


@registered(
    "busiest_app",
    f"""SELECT CASE app {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.APP_LABELS.items())} ELSE app END AS app, agent, human FROM (
    SELECT app, count(*) FILTER (WHERE actor = 'agent') AS agent, count(*) FILTER (WHERE actor = 'human') AS human FROM actions WHERE kind = 'mutating' AND app NOT IN ('', 'other') GROUP BY app)
    WHERE agent + human > 0 ORDER BY agent + human DESC, app LIMIT 1""",
    "actions",
)
def busiest_app(spark, d):
    return rollups.busiest_app(bridge.actions(spark, d))


@registered(
    "leaderboard",
    f"""SELECT person, CASE tool {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.DISPLAY_NAMES.items())} ELSE tool END AS tool_name, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(sessions) AS BIGINT) AS sessions
    FROM cells JOIN devices USING (device) WHERE day >= '2024-01-03' GROUP BY ALL""",
    "cells",
)
def leaderboard(spark, d):
    return rollups.leaderboard(label_cells(spark, d), bridge.devices(spark), "2024-01-03")


@registered("provider_turns", "SELECT provider, CAST(sum(turns) AS BIGINT) AS turns FROM cells GROUP BY provider", "cells")
def provider_turns(spark, d):
    return rollups.provider_turns(label_cells(spark, d))


@registered("coverage", "SELECT day, CAST(sum(CASE WHEN intent = 'other' THEN turns ELSE 0 END) AS BIGINT) AS other_turns, CAST(sum(turns) AS BIGINT) AS turns, sum(CASE WHEN intent = 'other' THEN turns ELSE 0 END) / sum(turns) AS share FROM cells GROUP BY day", "cells")
def coverage(spark, d):
    return rollups.coverage(label_cells(spark, d))


# --- the label queue -------------------------------------------------------------------------------------------------

QUEUE_SQL = f"""queued AS (
    SELECT t.*, s.model FROM turns t JOIN sessions s USING (device, tool, external_id) WHERE role = 'user'
    AND NOT EXISTS (SELECT 1 FROM turn_labels l WHERE l.device = t.device AND l.tool = t.tool AND l.external_id = t.external_id AND l.seq = t.seq AND l.taxonomy_version = {tx.TAXONOMY_VERSION} AND l.prompt_version = {tx.PROMPT_VERSION})
    AND NOT EXISTS (SELECT 1 FROM label_failures f WHERE f.device = t.device AND f.tool = t.tool AND f.external_id = t.external_id AND f.seq = t.seq AND f.attempts >= 5))"""


def queue(spark, d):
    return labeling.queue(bridge.turns(spark, d), bridge.sessions(spark, d), bridge.labels(spark, d), bridge.failures(spark, d))


@registered("label_queue", QUEUE_SQL + " SELECT device, tool, external_id, seq, model, ts_ms FROM queued", "turns", "sessions", "turn_labels", "label_failures")
def label_queue(spark, d):
    return queue(spark, d).select("device", "tool", "external_id", "seq", "model", "ts_ms")


@registered(
    "label_batch",
    QUEUE_SQL + r" SELECT device, tool, external_id, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts_ms DESC, tool, external_id, seq DESC) AS place FROM queued) WHERE place <= 25 AND regexp_matches(redacted_text, '\S')",
    "turns", "sessions", "turn_labels", "label_failures",
)
def label_batch(spark, d):
    return labeling.batch(bridge.turns(spark, d), bridge.sessions(spark, d), bridge.labels(spark, d), bridge.failures(spark, d)).select("device", "tool", "external_id", "seq", F.col("place").cast("long").alias("place"))


#: The longest prefix of at most 400 bytes: no character takes more than four.
LINE_SQL = "CASE WHEN strlen(l) <= 400 THEN l ELSE left(l, list_max(list_filter(range(100, 401), lambda k: strlen(left(l, k)) <= 400))) END"


@registered(
    "label_context",
    f"""SELECT device, tool, external_id, seq, coalesce(array_to_string(list_filter(list(line) OVER (PARTITION BY device, tool, external_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), '|'), '') AS context
    FROM (SELECT *, {LINE_SQL} AS line FROM (SELECT *, CASE WHEN regexp_matches(redacted_text, '\\S') THEN role || ': ' || trim(redacted_text, E' \\n\\t') END AS l FROM turns))""",
    "turns",
)
def label_context(spark, d):
    """The contexts as a labeler gets them, of up to 400 bytes a line."""
    return labeling.with_context(bridge.turns(spark, d)).select("device", "tool", "external_id", "seq", F.array_join("context", "|").alias("context"))


@registered("label_context_whole")
def label_context_whole(spark, d):
    """The contexts as lists, and the whole requests of up to 5,000 bytes."""
    return labeling.with_context(bridge.turns(spark, d)).select("device", "tool", "external_id", "seq", "context", labeling.request_text().alias("request"))


@registered("label_progress", f"SELECT user_turns, labeled, labeled * 100 // user_turns AS percent FROM (SELECT count(*) AS user_turns FROM turns WHERE role = 'user'), (SELECT count(*) AS labeled FROM turn_labels WHERE taxonomy_version = {tx.TAXONOMY_VERSION} AND prompt_version = {tx.PROMPT_VERSION})", "turns", "turn_labels")
def label_progress(spark, d):
    return labeling.progress(bridge.turns(spark, d), bridge.labels(spark, d))


def doubtful(spark, d):
    """Labels some of which fall outside the taxonomy."""
    k = F.col("seq") + F.col("external_id").cast("long")
    return bridge.labels(spark, d).withColumns({"intent": F.when(k % 7 == 0, "unheard_of").otherwise(F.col("intent")), "depth": F.when(k % 11 == 0, 9).otherwise(F.col("depth"))})


@registered(
    "label_validation",
    f"""SELECT device, tool, external_id, seq, CASE WHEN k % 7 = 0 THEN 'intent outside taxonomy: unheard_of' WHEN k % 11 = 0 THEN 'depth outside range: 9' END AS last_error
    FROM (SELECT *, seq + CAST(external_id AS BIGINT) AS k FROM turn_labels)""",
    "turn_labels",
)
def label_validation(spark, d):
    good, bad = labeling.validated(doubtful(spark, d))
    return good.withColumn("last_error", F.lit(None).cast("string")).unionByName(bad).select("device", "tool", "external_id", "seq", "last_error")


@registered(
    "label_failures_merged",
    """SELECT device, tool, external_id, seq, CAST(attempts + 1 AS BIGINT) AS attempts FROM label_failures""",
    "label_failures",
)
def label_failures_merged(spark, d):
    f = bridge.failures(spark, d)
    again = f.withColumns({"attempts": F.lit(1).cast("long"), "last_error": F.lit("refused"), "last_attempt_ms": F.col("last_attempt_ms") + 1})
    return dedupe.merge_failures(f, again, bridge.labels(spark, d)).select("device", "tool", "external_id", "seq", "attempts")


@registered(
    "label_candidates",
    """SELECT taxonomy_version, 'domain' AS facet, 'topic_' || depth AS proposed, count(*) AS observations, min(analyzed_ms) AS first_seen_ms, max(analyzed_ms) AS last_seen_ms FROM turn_labels WHERE domain = 'other' GROUP BY ALL""",
    "turn_labels",
)
def label_candidates(spark, d):
    other = bridge.labels(spark, d).where("domain = 'other'")
    proposals = other.select("taxonomy_version", F.lit("domain").alias("facet"), tf.proposal_id(F.concat(F.lit(" Topic "), F.col("depth").cast("string"), F.lit("! ")), F.col("domain")).alias("proposed"), F.lit("seen").alias("rationale"), F.col("analyzed_ms").alias("seen_ms"))
    return labeling.candidate_report(dedupe.merge_candidates(proposals)).drop("rationale")


# --- upserts and set semantics ---------------------------------------------------------------------------------------


@registered("turns_first_wins", "SELECT device, tool, external_id, seq, redacted_text FROM turns", "turns")
def turns_first_wins(spark, d):
    t = bridge.turns(spark, d)
    stored = t.where("seq < 2")
    parsed = t.withColumn("ord", F.lit(1)).unionByName(t.withColumns({"redacted_text": F.lit("later"), "ord": F.lit(2)}))
    return dedupe.add_new_turns(stored, parsed).select("device", "tool", "external_id", "seq", "redacted_text")


@registered("sessions_upserted", "SELECT device, tool, external_id, 'late' AS provider, surface, model, started_ms, ended_ms + 5 AS ended_ms, message_count FROM sessions", "sessions")
def sessions_upserted(spark, d):
    s = bridge.sessions(spark, d)
    later = s.withColumns({"provider": F.lit("late"), "model": F.lit(None).cast("string"), "started_ms": F.col("started_ms") + 9, "ended_ms": F.col("ended_ms") + 5, "message_count": F.lit(0).cast("long")})
    return dedupe.upsert_sessions(s.withColumn("ord", F.lit(1)).unionByName(later.withColumn("ord", F.lit(2)))).select(*s.columns)


@registered("actions_first_wins", "SELECT source, ext_id, device, action FROM actions", "actions")
def actions_first_wins(spark, d):
    a = bridge.actions(spark, d).withColumn("ord", F.lit(0))
    again = a.withColumns({"action": F.lit("again"), "ord": F.lit(1)})
    return dedupe.first_wins(a.unionByName(again), ["device", "source", "ext_id"], F.col("ord")).select("source", "ext_id", "device", "action")


@registered("delegations_replaced", "SELECT device, tool, external_id, driven_tool, occurred_ms, CAST(sum(CASE WHEN CAST(external_id AS BIGINT) % 2 = 0 THEN 1 ELSE turns END) AS BIGINT) AS turns FROM delegations WHERE CAST(external_id AS BIGINT) % 3 <> 0 OR CAST(external_id AS BIGINT) % 2 = 1 GROUP BY ALL", "delegations")
def delegations_replaced(spark, d):
    stored, n = bridge.delegations(spark, d), F.col("external_id").cast("long")
    parsed = stored.where((n % 2 == 0) & (n % 3 != 0)).withColumn("turns", F.lit(1).cast("long"))
    return dedupe.replace_delegations(stored, stored.where(n % 2 == 0), parsed)


@registered(
    "web_turns",
    """marked AS (SELECT *, lag(role) OVER w AS r, lag(redacted_text) OVER w AS t FROM turns WHERE regexp_matches(redacted_text, '\\S') WINDOW w AS (PARTITION BY device, tool, external_id ORDER BY seq))
    SELECT device, tool, external_id, role, redacted_text, row_number() OVER (PARTITION BY device, tool, external_id ORDER BY seq) - 1 AS seq FROM marked WHERE r IS DISTINCT FROM role OR t IS DISTINCT FROM redacted_text""".replace("\\\\", "\\"),
    "turns",
)
def web_turns(spark, d):
    t = bridge.turns(spark, d).withColumnRenamed("seq", "pos")
    twice = t.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("pos", F.col("pos") * 2 + F.col("copy")).drop("copy")
    none = F.lit(None).cast("string")
    out = dedupe.without_repeats(twice.withColumns({"existing": F.lit(0).cast("long"), "last_role": none, "last_text": none}))
    return out.select("device", "tool", "external_id", "role", "redacted_text", F.col("seq").cast("long").alias("seq"))


@registered("pause_filter", "SELECT ext_id, device, ts_ms FROM actions WHERE NOT ((device = 'd1' AND ts_ms >= 1704300000000 AND ts_ms < 1705300000000) OR (device = 'd3' AND ts_ms >= 1704000000000 AND ts_ms < 1704600000000))", "actions")
def pause_filter(spark, d):
    pauses = spark.sql("SELECT * FROM VALUES ('d1', 1704300000000, 1705300000000), ('d3', 1704000000000, 1704600000000) AS t(device, from_ms, until_ms)")
    return filters.outside_pauses(bridge.actions(spark, d), pauses).select("ext_id", "device", "ts_ms")


# --- fact rows -------------------------------------------------------------------------------------------------------


def fact_rows(spark, d):
    devices = bridge.devices(spark)
    return facts.fact_rows(label_cells(spark, d), session_spans(spark, d), usage_connectors(spark, d), usage_shortcuts(spark, d), delegation_spans(spark, d), devices)


@registered(
    "fact_rows",
    """SELECT 'analytics_cell' AS kind, device, person, day, tool, turns, sessions, NULL AS runs FROM cells JOIN devices USING (device)
    UNION ALL SELECT 'session_span', device, person, day, tool, NULL, sessions, NULL FROM spans JOIN devices USING (device)
    UNION ALL SELECT 'connector', device, person, day, NULL, NULL, NULL, runs FROM (""" + USAGE_SQL.format("connector") + """) JOIN devices USING (device)
    UNION ALL SELECT 'shortcut', device, person, day, NULL, NULL, NULL, runs FROM (""" + USAGE_SQL.format("shortcut") + """) JOIN devices USING (device)
    UNION ALL SELECT 'delegation', device, person, day, tool, turns, NULL, NULL FROM drives JOIN devices USING (device)""",
    "cells", "spans", "drives", "actions", "devices",
)
def fact_rows_query(spark, d):
    return fact_rows(spark, d).select("kind", "device", "person", "day", "tool", "turns", "sessions", "runs")


@registered(
    "facts_merged",
    """SELECT 'session_span' AS kind, device, day, tool, total_minutes FROM spans WHERE device <> 'd2' OR tool = 'codex'""",
    "spans",
)
def facts_merged(spark, d):
    """A stored snapshot, then a push of device d2 that holds one tool only: its other rows go, other devices stay."""
    rows = fact_rows(spark, d).where("kind = 'session_span'")
    stored = rows.withColumns({"total_minutes": F.lit(-1).cast("long"), "received_ms": F.lit(1).cast("long")}).where("device = 'd2'").unionByName(rows.where("device <> 'd2'").withColumn("received_ms", F.lit(1).cast("long")))
    push = rows.where("device = 'd2' AND tool = 'codex'").withColumn("received_ms", F.lit(2).cast("long"))
    return sinks.merge_snapshot(stored, push).select("kind", "device", "day", "tool", "total_minutes")


@registered("week_export", "SELECT device, day, tool, sessions FROM spans WHERE day BETWEEN '2024-01-08' AND '2024-01-14'", "spans")
def week_export(spark, d):
    return sinks.week_rows(session_spans(spark, d), "2024-01-08").select("device", "day", "tool", "sessions")


@registered(
    "interactions",
    """SELECT 'interaction/1' AS schema, device || ':' || external_id || ':' || seq AS event_id, device, strftime(make_timestamp_ms(ts_ms), '%Y-%m-%d') AS day, ts_ms, provider, tool, surface, model, external_id AS session_id, seq AS turn_index, role, redacted_text AS text, length(redacted_text) AS text_chars
    FROM turns JOIN sessions USING (device, tool, external_id)""",
    "turns",
    "sessions",
)
def interactions(spark, d):
    return sinks.interactions(bridge.turns(spark, d), bridge.sessions(spark, d))


# --- recap -----------------------------------------------------------------------------------------------------------

TEAM_SQL = """who AS (SELECT *, 't' || (CAST(substr(person, 2) AS INTEGER) % 2) AS team FROM devices),
    tcells AS (SELECT c.*, team, person, strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week_start, CASE WHEN turns > 0 THEN turns ELSE greatest(sessions, 1) END AS w,
      CASE WHEN intent IN ({asking}) THEN 'asking' WHEN intent IN ({expressing}) THEN 'expressing' WHEN intent = 'other' THEN 'other' ELSE 'doing' END AS shape FROM cells c JOIN who USING (device)),
    tspans AS (SELECT s.*, team, person, strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week_start FROM spans s JOIN who USING (device)),
    tdrives AS (SELECT s.*, team, person, strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week_start FROM drives s JOIN who USING (device)),
    people AS (SELECT team, week_start, person, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(n) AS BIGINT) AS sessions, CAST(max(longest) AS BIGINT) AS longest, CAST(sum(w) AS BIGINT) AS turns, CAST(sum(chars) AS BIGINT) AS chars,
      CAST(sum(asking) AS BIGINT) AS asking_turns, CAST(sum(doing) AS BIGINT) AS doing_turns, CAST(sum(late) AS BIGINT) AS late_turns, CAST(sum(named) AS BIGINT) AS delegate_turns, CAST(sum(drives) AS BIGINT) AS drives, CAST(sum(code) AS BIGINT) AS code_drives,
      count(DISTINCT used) AS tools, count(DISTINCT active) AS active_days FROM (
      SELECT team, week_start, person, 0 AS minutes, 0 AS n, 0 AS longest, w, chars, CASE WHEN shape = 'asking' THEN w ELSE 0 END AS asking, CASE WHEN shape = 'doing' THEN w ELSE 0 END AS doing, CASE WHEN hour <= 4 THEN w ELSE 0 END AS late, CASE WHEN delegate_tool <> 'none' THEN w ELSE 0 END AS named, 0 AS drives, 0 AS code, tool AS used, NULL AS active FROM tcells
      UNION ALL SELECT team, week_start, person, total_minutes, sessions, longest_minutes, 0, 0, 0, 0, 0, 0, 0, 0, tool, day FROM tspans
      UNION ALL SELECT team, week_start, person, 0, 0, 0, 0, 0, 0, 0, 0, 0, turns, CASE WHEN driven_tool = 'claude_code' THEN turns ELSE 0 END, NULL, NULL FROM tdrives) GROUP BY ALL)
""".format(asking=", ".join(f"'{x}'" for x in tx.ASKING), expressing=", ".join(f"'{x}'" for x in tx.EXPRESSING))
FACTS = ("cells", "spans", "drives", "devices")


def team_facts(spark, d):
    who = bridge.devices(spark).select("device", "person", F.concat(F.lit("t"), (F.substring("person", 2, 9).cast("int") % 2).cast("string")).alias("team"))
    of = lambda df: df.join(who, "device").withColumn("week_start", tf.week_start(F.col("day")))
    return of(label_cells(spark, d).withColumn("shape", cl.shape(F.col("intent")))), of(session_spans(spark, d)), of(delegation_spans(spark, d))


@registered("person_week", TEAM_SQL + " SELECT * FROM people", *FACTS)
def person_week(spark, d):
    out = recap.person_week(*team_facts(spark, d))
    return out.select("team", "week_start", "person", "minutes", "sessions", "longest", "turns", "chars", "asking_turns", "doing_turns", "late_turns", "delegate_turns", "drives", "code_drives", "tools", "active_days")


@registered(
    "team_week",
    TEAM_SQL
    + """ SELECT p.team, p.week_start, count(*) AS people, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(round(sum(minutes) / 60.0) AS BIGINT) AS hours, CAST(sum(turns) AS BIGINT) AS turns, sum(minutes) / 60.0 / 40.0 AS work_weeks,
    coalesce(any_value(n), 0) AS tool_count, CAST(sum(delegate_turns) AS BIGINT) AS delegate_turns, CAST(coalesce(round(100.0 * sum(asking_turns) / nullif(sum(asking_turns) + sum(doing_turns), 0)), 0) AS BIGINT) AS research_pct,
    max(longest) AS longest_minutes, CASE WHEN max(longest) > 0 THEN min(person) FILTER (WHERE longest = m) END AS longest_person
    FROM (SELECT *, max(longest) OVER (PARTITION BY team, week_start) AS m FROM people) p LEFT JOIN (SELECT team, week_start, count(DISTINCT tool) AS n FROM (SELECT team, week_start, tool FROM tcells UNION ALL SELECT team, week_start, tool FROM tspans) GROUP BY ALL) USING (team, week_start) GROUP BY ALL""",
    *FACTS,
)
def team_week(spark, d):
    cells, spans, drives = team_facts(spark, d)
    out = recap.team_week(recap.person_week(cells, spans, drives), recap.tool_counts(cells, spans))
    return out.select("team", "week_start", "people", "minutes", "hours", "turns", "work_weeks", "tool_count", "delegate_turns", "research_pct", "longest_minutes", "longest_person")


MARGIN_SQL = """margins AS (SELECT team, week_start, 'tool' AS axis, tool AS key, NULL AS key2, CAST(sum(w) AS BIGINT) AS turns FROM tcells GROUP BY ALL
    UNION ALL SELECT team, week_start, 'domain', domain, NULL, CAST(sum(w) AS BIGINT) FROM tcells WHERE domain <> 'other' GROUP BY ALL
    UNION ALL SELECT team, week_start, 'day', day, NULL, CAST(sum(w) AS BIGINT) FROM tcells GROUP BY ALL
    UNION ALL SELECT team, week_start, 'hour', CAST(hour AS VARCHAR), NULL, CAST(sum(w) AS BIGINT) FROM tcells GROUP BY ALL
    UNION ALL SELECT team, week_start, 'tool_domain', tool, domain, CAST(sum(w) AS BIGINT) FROM tcells WHERE domain <> 'other' GROUP BY ALL)
"""


@registered("team_marginals", TEAM_SQL + ", " + MARGIN_SQL + " SELECT * FROM margins", *FACTS)
def team_marginals(spark, d):
    return recap.marginals(team_facts(spark, d)[0])


RANK_SQL = """SELECT team, week_start, key, turns, CAST(round(100.0 * turns / sum(turns) OVER (PARTITION BY team, week_start)) AS BIGINT) AS pct, row_number() OVER (PARTITION BY team, week_start ORDER BY turns DESC, key) AS place FROM margins WHERE axis = '{}'"""


@registered("domain_rank", TEAM_SQL + ", " + MARGIN_SQL + RANK_SQL.format("domain"), *FACTS)
def domain_rank(spark, d):
    return recap.ranked(team_marginals(spark, d), "domain")


@registered("tool_rank", TEAM_SQL + ", " + MARGIN_SQL + RANK_SQL.format("tool"), *FACTS)
def tool_rank(spark, d):
    return recap.ranked(team_marginals(spark, d), "tool")


@registered("podium", TEAM_SQL + " SELECT team, week_start, person, minutes, row_number() OVER (PARTITION BY team, week_start ORDER BY minutes DESC, person) AS place FROM people", *FACTS)
def podium(spark, d):
    return recap.podium(recap.person_week(*team_facts(spark, d)))


@registered(
    "team_peaks",
    TEAM_SQL + ", " + MARGIN_SQL
    + """ SELECT team, week_start, CAST((list(key ORDER BY turns DESC, TRY_CAST(key AS INTEGER)) FILTER (WHERE axis = 'hour'))[1] AS INTEGER) AS peak_hour, (list(key ORDER BY turns DESC, key) FILTER (WHERE axis = 'day'))[1] AS busy_day,
    (list(key ORDER BY turns DESC, key) FILTER (WHERE axis = 'domain'))[1] AS top_domain FROM (SELECT team, week_start, axis, CASE WHEN axis = 'hour' THEN key ELSE '0' END AS h, key, turns FROM margins WHERE axis IN ('hour', 'day', 'domain')) GROUP BY ALL""",
    *FACTS,
)
def team_peaks(spark, d):
    return recap.peaks(team_marginals(spark, d))


AXES_SQL = """pm AS (SELECT * FROM people
    LEFT JOIN (SELECT team, week_start, person, sum(CASE WHEN tool = 'openclaw' THEN total_minutes ELSE 0 END) AS own_minutes, sum(CASE WHEN tool = 'openclaw' THEN sessions ELSE 0 END) AS own_sessions,
      sum(CASE WHEN tool = 'claude-code' THEN total_minutes ELSE 0 END) AS code_minutes, sum(CASE WHEN tool = 'claude-code' THEN sessions ELSE 0 END) AS code_sessions FROM tspans GROUP BY ALL) USING (team, week_start, person)
    LEFT JOIN (SELECT team, week_start, person, sum(w) FILTER (WHERE intent = 'troubleshooting_or_diagnosis') AS troubles, sum(w) FILTER (WHERE intent = 'casual_conversation') AS casual,
      sum(w) FILTER (WHERE intent = 'draft_communication') AS drafts, sum(w) FILTER (WHERE intent = 'configure_or_setup') AS setups FROM tcells GROUP BY ALL) USING (team, week_start, person)),
    axes AS (SELECT team, week_start, person, a.axis, a.value FROM (SELECT *, unnest([
      {'axis': 0, 'value': minutes / 1, 'gate': minutes >= 600},
      {'axis': 1, 'value': chars / greatest(turns, 1), 'gate': turns > 10 AND chars / greatest(turns, 1) > 600},
      {'axis': 2, 'value': troubles / 1, 'gate': troubles > 30},
      {'axis': 3, 'value': casual / 1, 'gate': casual > 20},
      {'axis': 4, 'value': own_sessions / (own_minutes + 1), 'gate': own_sessions >= 60 AND round(own_minutes * 60 / greatest(own_sessions, 1)) < 120},
      {'axis': 5, 'value': own_minutes / greatest(minutes, 1), 'gate': own_minutes > 120 AND own_minutes / greatest(minutes, 1) > 0.5},
      {'axis': 6, 'value': late_turns / 1, 'gate': late_turns > 10},
      {'axis': 7, 'value': drafts / 1, 'gate': drafts >= 8},
      {'axis': 8, 'value': code_minutes / greatest(code_sessions, 1), 'gate': code_sessions >= 5 AND code_minutes / greatest(code_sessions, 1) >= 60},
      {'axis': 9, 'value': drives / 1, 'gate': drives >= 20},
      {'axis': 10, 'value': setups / 1, 'gate': setups >= 20},
      {'axis': 11, 'value': tools / 1, 'gate': tools >= 4},
      {'axis': 12, 'value': sessions / (minutes + 1), 'gate': minutes > 0 AND minutes < 180 AND sessions >= 10},
      {'axis': 13, 'value': 1 / (minutes + 1), 'gate': minutes < 150}]) AS a FROM pm) WHERE a.gate AND a.value > 0)"""
BADGE_SQL = "CASE axis " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(recap.BADGES)) + " END"


@registered("persona_candidates", TEAM_SQL + ", " + AXES_SQL + f" SELECT team, week_start, person, axis, {BADGE_SQL} AS badge, value / max(value) OVER (PARTITION BY team, week_start, axis) AS score FROM axes", *FACTS)
def persona_candidates(spark, d):
    return recap.persona_candidates(recap.person_week(*team_facts(spark, d)))


@registered("personas")
def personas(spark, d):
    return recap.personas(recap.person_week(*team_facts(spark, d)))


@registered("recap_cards")
def recap_cards(spark, d):
    cells, spans, drives = team_facts(spark, d)
    folder = sinks.landing(spark, "recap")  # reduced facts, read by several branches
    people, margins = (sinks.written(df, f"{folder}/{n}") for n, df in (("people", recap.person_week(cells, spans, drives)), ("margins", recap.marginals(cells))))
    return recap.cards(recap.team_week(people, recap.tool_counts(cells, spans)), margins, recap.podium(people), recap.personas(people))


@registered(
    "live_board",
    """used AS (SELECT person, 'connector' AS kind, CASE WHEN app IS NULL OR app = '' THEN 'unknown' ELSE app END AS name, count(*) AS runs FROM actions JOIN devices USING (device) WHERE tool = 'connector' AND strftime(make_timestamp_ms(ts_ms + offset_min * 60000), '%Y-%m-%d') = '2024-01-10' GROUP BY ALL
    UNION ALL SELECT person, 'shortcut', CASE WHEN app IS NULL OR app = '' THEN 'unknown' ELSE app END, count(*) FROM actions JOIN devices USING (device) WHERE tool = 'shortcut' AND strftime(make_timestamp_ms(ts_ms + offset_min * 60000), '%Y-%m-%d') = '2024-01-10' GROUP BY ALL)
    SELECT person, CAST(5 AS BIGINT) AS last_ms, '1.0' AS version, string_agg(kind || ':' || name || ':' || runs, ',' ORDER BY runs DESC, kind, name) AS details, CAST(coalesce(sum(runs) FILTER (WHERE kind = 'shortcut'), 0) AS BIGINT) AS shortcuts, CAST(coalesce(sum(runs) FILTER (WHERE kind = 'connector'), 0) AS BIGINT) AS connectors FROM (SELECT DISTINCT person FROM devices) LEFT JOIN used USING (person) GROUP BY person""",
    "actions",
    "devices",
)
def live_board(spark, d):
    rows = fact_rows(spark, d).withColumns({"received_ms": F.lit(5).cast("long"), "version": F.lit("1.0")})
    details = F.array_join(F.transform("details", lambda x: F.concat_ws(":", x["kind"], x["name"], x["runs"].cast("string"))), ",")
    return recap.live_board(rows, "2024-01-10").select("person", "last_ms", "version", details.alias("details"), "shortcuts", "connectors")


# --- redaction -------------------------------------------------------------------------------------------------------



EDGE, BLANK = r"[^\p{L}\p{N}_]", r"[\x09-\x0D\x1C-\x20\x85\p{Z}]*"


def token_sql() -> str:
    """The two rules in RE2, which has no word bounds of all scripts: with the character in front (and behind), twice, as neighbours may share one."""
    keys = f"(^|{EDGE})(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{{16}}({EDGE}|$)"
    assigned = f"""(?i)(^|{EDGE})(?:api[_-]?key|secret|token|password|passwd|access[_-]?key|client[_-]?secret){BLANK}[:=]{BLANK}[''"]?[A-Za-z0-9_\\-.]{{12,}}[''"]?"""
    text = "text"
    for pattern, new in ((keys, r"\1[REDACTED:aws_key]\2"), (assigned, r"\1[REDACTED:assigned_secret]")):
        for _ in range(2):
            text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


@registered("redact_tokens", f"SELECT doc_id, length(t) AS n, sha256(t) AS text_sha256 FROM (SELECT doc_id, {token_sql()} AS t FROM documents)")
def redact_tokens(spark, d):
    """Cloud keys and assigned secrets replaced in all documents; all nine rules without a validator: redact_tokens_whole."""
    text = F.col("text")
    for kind in ("aws_key", "assigned_secret"):
        text = redaction.after_token_rule(text, kind)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256"))


def tokens_redacted(text: Column) -> Column:
    """text after the nine rules without a validator, as chained JVM functions."""
    for kind, _, ok in redaction.RULES:
        if ok is None:
            text = redaction.after_token_rule(text, kind)
    return text


@registered("redact_tokens_whole")
def redact_tokens_whole(spark, d):
    """All nine rules without a validator over all documents: without SQL, since RE2's word bounds are ASCII only."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.length(tokens_redacted(F.col("text"))).cast("long").alias("n"))


@registered("redacted_documents")
def redacted_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return redaction.redacted(docs, "text", "counts").select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), kinds.alias("kinds"))


@registered("redaction_audit")
def redaction_audit(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "lang", "text")
    return redaction.audit(redaction.redacted(docs, "text", "counts"), "counts", "source", "lang")


# --- scalar classification -------------------------------------------------------------------------------------------


@registered(
    "shapes_and_titles",
    f"""SELECT device, external_id, seq, CASE WHEN intent IN ({', '.join(f"'{x}'" for x in tx.ASKING)}) THEN 'asking' WHEN intent IN ('personal_or_reflective', 'casual_conversation') THEN 'expressing' WHEN intent = 'other' THEN 'other' ELSE 'doing' END AS shape,
    CASE domain {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.DOMAIN_TITLES.items())} ELSE 'Other' END AS title FROM turn_labels""",
    "turn_labels",
)
def shapes_and_titles(spark, d):
    return bridge.labels(spark, d).select("device", "external_id", "seq", cl.shape(F.col("intent")).alias("shape"), cl.domain_title(F.col("domain")).alias("title"))


@registered(
    "page_hosts",
    """SELECT page_id, nullif(regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/?#]*'), '^(www\\.)+', ''), '') AS host FROM pages""".replace("\\\\", "\\"),
)
def page_hosts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", cl.host(F.col("url")).alias("host"))


@registered("event_stamps", "SELECT event_id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events")
def event_stamps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    ms = tf.epoch_ms(stamp)
    return e.select("event_id", ms.alias("ms"), tf.utc_day(ms).alias("day"), tf.week_start(tf.utc_day(ms)).alias("week"))
