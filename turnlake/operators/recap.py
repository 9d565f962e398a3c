"""Weekly metrics of people and teams from merged fact rows, rankings, personas and recap cards.

Facts carry team, week_start and person beside their own columns: every function computes all teams and weeks in one job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.functions import classify as cl
from turnlake.functions import text as tf

TEAM = ["team", "week_start"]
OWN, CODE = "openclaw", "claude-code"
LATE, EARLY = (0, 4), (6, 9)
# Badges of the persona axes in tie-break order, and the fallback.
BADGES = ["cooked", "the lore dropper", "the crashout arc", "the situationship", "the hit and run", "day one", "3am coded", "the ghostwriter", "in the trenches", "the middle manager", "the setup arc", "the polycule", "the drive-by", "the ghost"]
FALLBACK = "the cryptid"
MEASURES = [
    "minutes", "sessions", "turns", "chars", "asking_turns", "doing_turns", "expressing_turns", "other_turns", "late_turns", "early_turns", "delegate_turns", "delegate_cells",
    "own_turns", "own_asking", "own_minutes", "own_sessions", "code_minutes", "code_sessions", "casual_turns", "troubleshoot_turns", "draft_turns", "setup_turns", "drives", "code_drives",
]


def weight() -> Column:
    return tf.weight(F.col("turns"), F.col("sessions"))


def measures(cells: DataFrame, spans: DataFrame, delegations: DataFrame) -> DataFrame:
    """All facts in one long frame of MEASURES, longest, tool and day; what a kind of row doesn't measure is 0 or null (OP-32)."""
    w = weight()
    when = lambda cond, value: F.when(cond, value).otherwise(0)
    intent = lambda name: when(F.col("intent") == name, w)
    shape = lambda name: when(F.col("shape") == name, w)
    named = F.coalesce(F.col("delegate_tool"), F.lit("none")) != "none"
    of_cells = {
        "turns": w, "chars": F.col("chars"), "asking_turns": shape("asking"), "doing_turns": shape("doing"), "expressing_turns": shape("expressing"),
        "other_turns": when(~F.col("shape").isin("asking", "doing", "expressing"), w), "late_turns": when(F.col("hour").between(*LATE), w), "early_turns": when(F.col("hour").between(*EARLY), w),
        "delegate_turns": when(named, w), "delegate_cells": when(named, 1), "own_turns": when(F.col("tool") == OWN, w), "own_asking": when((F.col("tool") == OWN) & (F.col("shape") == "asking"), w),
        "casual_turns": intent("casual_conversation"), "troubleshoot_turns": intent("troubleshooting_or_diagnosis"), "draft_turns": intent("draft_communication"), "setup_turns": intent("configure_or_setup"),
    }
    of_spans = {
        "minutes": F.col("total_minutes"), "sessions": F.col("sessions"), "own_minutes": when(F.col("tool") == OWN, F.col("total_minutes")), "own_sessions": when(F.col("tool") == OWN, F.col("sessions")),
        "code_minutes": when(F.col("tool") == CODE, F.col("total_minutes")), "code_sessions": when(F.col("tool") == CODE, F.col("sessions")),
    }
    of_drives = {"drives": F.col("turns"), "code_drives": when(F.col("driven_tool") == "claude_code", F.col("turns"))}

    def long(df: DataFrame, of: dict[str, Column], longest: Column, tool: Column, day: Column) -> DataFrame:
        return df.select(*TEAM, "person", *[of.get(m, F.lit(0)).cast("long").alias(m) for m in MEASURES], longest.cast("long").alias("longest"), tool.alias("used"), day.alias("active"))

    none = F.lit(None).cast("string")
    return long(cells, of_cells, F.lit(0), F.col("tool"), none).unionByName(long(spans, of_spans, F.col("longest_minutes"), F.col("tool"), F.col("day"))).unionByName(long(delegations, of_drives, F.lit(0), none, none))


def person_week(cells: DataFrame, spans: DataFrame, delegations: DataFrame) -> DataFrame:
    """One row for each team, week and person with any fact: all MEASURES, longest, tools, active_days (OP-72)."""
    one = [F.sum(m).alias(m) for m in MEASURES]
    return measures(cells, spans, delegations).groupBy(*TEAM, "person").agg(*one, F.max("longest").alias("longest"), F.size(F.collect_set("used")).cast("long").alias("tools"), F.size(F.collect_set("active")).cast("long").alias("active_days"))


def team_week(people: DataFrame, tools: DataFrame) -> DataFrame:
    """Totals of a team's week (OP-73). tools: team, week_start, tool_count."""
    sums = [F.sum(m).alias(m) for m in ("minutes", "turns", "asking_turns", "doing_turns", "expressing_turns", "other_turns", "delegate_turns", "delegate_cells")]
    out = people.groupBy(*TEAM).agg(F.count("*").alias("people"), *sums, F.max("longest").alias("longest_minutes"), F.min(F.struct((-F.col("longest")).alias("k"), "person")).alias("_by"))
    both = F.col("asking_turns") + F.col("doing_turns")
    return out.join(tools, TEAM, "left").select(
        *TEAM, "people", "minutes", F.round(F.col("minutes") / 60).cast("long").alias("hours"), "turns", (F.col("minutes") / 60 / 40).alias("work_weeks"), F.coalesce("tool_count", F.lit(0)).alias("tool_count"),
        "delegate_turns", "delegate_cells", tf.percent(F.col("asking_turns"), both).alias("research_pct"), tf.percent(F.col("doing_turns"), both).alias("doing_pct"),
        "asking_turns", "doing_turns", "expressing_turns", "other_turns", "longest_minutes", F.when(F.col("longest_minutes") > 0, F.col("_by.person")).alias("longest_person"),
    )


def tool_counts(cells: DataFrame, spans: DataFrame) -> DataFrame:
    used = cells.select(*TEAM, "tool").union(spans.select(*TEAM, "tool")).distinct()
    return used.groupBy(*TEAM).agg(F.count("*").alias("tool_count"))


def marginals(cells: DataFrame) -> DataFrame:
    """Weighted turns of a team's week by tool, domain, day, hour, and tool x domain, in one pass (OP-74).

    axis names the marginal; key and key2 its values. The domain `other` is left out of the two domain marginals.
    """
    rows = cells.withColumn("w", weight().cast("long")).withColumn("hour", F.col("hour").cast("string"))
    sets = [("tool",), ("domain",), ("day",), ("hour",), ("tool", "domain")]
    sums = rows.groupingSets([[F.col(c) for c in (*TEAM, *s)] for s in sets], *TEAM, "tool", "domain", "day", "hour").agg(F.grouping_id().alias("g"), F.sum("w").alias("turns"))
    mask = {s: sum(1 << (3 - k) for k, c in enumerate(("tool", "domain", "day", "hour")) if c not in s) for s in sets}
    axis = cl.one_of(F.col("g"), [(F.col("g") == mask[s], F.lit("_".join(s))) for s in sets])
    key = F.coalesce("tool", "domain", "day", "hour")
    out = sums.select(*TEAM, axis.alias("axis"), key.alias("key"), F.when(axis == "tool_domain", F.col("domain")).alias("key2"), "turns")
    domain = F.when(F.col("axis") == "domain", F.col("key")).when(F.col("axis") == "tool_domain", F.col("key2"))
    return out.where(F.coalesce(domain, F.lit("")) != "other")


def ranked(margins: DataFrame, axis: str, own: str | None = None) -> DataFrame:
    """key, turns, pct and place of one marginal: most turns first, then key (OP-82). own: of tool_domain, the tool."""
    rows = margins.where(F.col("axis") == axis)
    if own is not None:
        rows = rows.where(F.col("key") == own).withColumn("key", F.col("key2"))
    total = F.sum("turns").over(Window.partitionBy(*TEAM))
    place = F.row_number().over(Window.partitionBy(*TEAM).orderBy(F.desc("turns"), "key"))
    return rows.select(*TEAM, "key", "turns", tf.percent(F.col("turns"), total).alias("pct"), place.cast("long").alias("place"))


def podium(people: DataFrame) -> DataFrame:
    """People by minutes, then name."""
    place = F.row_number().over(Window.partitionBy(*TEAM).orderBy(F.desc("minutes"), "person"))
    return people.select(*TEAM, "person", "minutes", place.cast("long").alias("place"))


def peaks(margins: DataFrame) -> DataFrame:
    """peak_hour (ties: the earliest), busy_day and top_domain (ties: the least key) of each team's week."""
    best = lambda axis, order: F.min(F.when(F.col("axis") == axis, F.struct((-F.col("turns")).alias("n"), order.alias("o"), F.col("key").alias("k"))))["k"]
    hour = F.min(F.when(F.col("axis") == "hour", F.struct((-F.col("turns")).alias("n"), F.col("key").try_cast("int").alias("k"))))["k"]
    return margins.groupBy(*TEAM).agg(F.coalesce(hour, F.lit(0)).alias("peak_hour"), best("day", F.col("key")).alias("busy_day"), best("domain", F.col("key")).alias("top_domain"))


def axes() -> list[tuple[Column, Column]]:
    """(value, gate) of the persona axes, in the order of BADGES."""
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    chars, seconds, share, block = per("chars", "turns"), F.round(c("own_minutes") * 60 / F.greatest(c("own_sessions"), F.lit(1))), per("own_minutes", "minutes"), per("code_minutes", "code_sessions")
    return [
        (c("minutes"), c("minutes") >= 600),
        (chars, (c("turns") > 10) & (chars > 600)),
        (c("troubleshoot_turns"), c("troubleshoot_turns") > 30),
        (c("casual_turns"), c("casual_turns") > 20),
        (c("own_sessions") / (c("own_minutes") + 1), (c("own_sessions") >= 60) & (seconds < 120)),
        (share, (c("own_minutes") > 120) & (share > 0.5)),
        (c("late_turns"), c("late_turns") > 10),
        (c("draft_turns"), c("draft_turns") >= 8),
        (block, (c("code_sessions") >= 5) & (block >= 60)),
        (c("drives"), c("drives") >= 20),
        (c("setup_turns"), c("setup_turns") >= 20),
        (c("tools"), c("tools") >= 4),
        (c("sessions") / (c("minutes") + 1), (c("minutes") > 0) & (c("minutes") < 180) & (c("sessions") >= 10)),
        (F.lit(1) / (c("minutes") + 1), c("minutes") < 150),
    ]


def claims(people: DataFrame) -> DataFrame:
    """Every person's axes with their scores; a person without any has one row without badge."""
    each = F.array(*[F.when(gate & (value > 0), F.struct(F.lit(k).alias("axis"), F.lit(BADGES[k]).alias("badge"), value.cast("double").alias("value"))) for k, (value, gate) in enumerate(axes())])
    rows = people.select(*TEAM, "person", F.explode_outer(F.array_compact(each)).alias("a")).select(*TEAM, "person", "a.*")
    most = F.max("value").over(Window.partitionBy(*TEAM, "axis"))
    return rows.withColumn("score", F.col("value") / most).drop("value")


def persona_candidates(people: DataFrame) -> DataFrame:
    """person, axis, badge and score (value over the axis' largest among those whom it admits) (OP-83)."""
    return claims(people).where(F.col("badge").isNotNull())


def personas(people: DataFrame) -> DataFrame:
    """One badge for each person: each axis to its strongest open person, then repeats, then the fallback (OP-84).

    The greedy walk runs in one task for each team and week, over at most one row for each person and axis.
    """
    found = claims(people)
    schema = T.StructType([*[people.schema[c] for c in (*TEAM, "person")], T.StructField("badge", T.StringType())])

    def assign(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        claims = sorted((r for r in rows if r["badge"] is not None), key=lambda r: (-r["score"], r["axis"], r["person"]))
        given: dict[str, str] = {}
        for unique in (True, False):
            taken = set(given.values())
            for r in claims:
                if r["person"] not in given and not (unique and r["badge"] in taken):
                    given[r["person"]] = r["badge"]
                    taken.add(r["badge"])
        names = sorted({r["person"] for r in rows}, key=lambda n: (n is None, n))
        first = rows[0]
        out = [{**{c: first[c] for c in TEAM}, "person": n, "badge": given.get(n, FALLBACK)} for n in names]
        return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field(c) for c in (*TEAM, "person")] + [pa.field("badge", pa.string())]))

    return found.groupBy(*TEAM).applyInArrow(assign, schema)


def cards(totals: DataFrame, margins: DataFrame, board: DataFrame, badges: DataFrame) -> DataFrame:
    """Recap cards in order: position, kind, title, hero_number, hero_text, unit, rows (OP-85). Empty sections are left out."""
    pairs = lambda df, label, n: df.where(F.col("place") <= n).groupBy(*TEAM).agg(F.array_sort(F.collect_list(F.struct("place", label.alias("label"), F.col("value").cast("long").alias("value"), F.lit(None).cast("string").alias("text")))).alias("r"))
    tool = ranked(margins, "tool").withColumn("value", F.col("pct"))
    own = ranked(margins, "tool_domain", OWN).withColumn("value", F.col("pct"))
    domain = ranked(margins, "domain").withColumn("value", F.col("pct"))
    hours = board.where("minutes > 0").withColumn("value", F.round(F.col("minutes") / 60))
    people = badges.groupBy(*TEAM).agg(F.array_sort(F.collect_list(F.struct("person", "badge"))).alias("badges"))
    base = totals.join(peaks(margins), TEAM, "left")
    for df, label, name in ((tool, cl.tool_name(F.col("key")), "tools"), (own, cl.domain_title(F.col("key")), "owns"), (domain, cl.domain_title(F.col("key")), "domains")):
        base = base.join(pairs(df, label, 5).withColumnRenamed("r", name), TEAM, "left")
    base = base.join(pairs(hours, cl.first_name(F.col("person")), 1 << 30).withColumnRenamed("r", "board"), TEAM, "left").join(people, TEAM, "left")
    row = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("label", T.StringType()), T.StructField("value", T.LongType()), T.StructField("text", T.StringType())]))

    def card(kind: str, title: str, number: Column | None = None, text: Column | None = None, unit: Column | str | None = None, rows: Column | None = None, when: Column | None = None) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), F.lit(title).alias("title"), (F.lit(None) if number is None else number).cast("long").alias("hero_number"), (F.lit(None) if text is None else text).cast("string").alias("hero_text"), (unit if isinstance(unit, Column) else F.lit(unit)).cast("string").alias("unit"), (F.lit(None) if rows is None else rows).cast(row).alias("rows"))
        return made if when is None else F.when(when, made)

    c = F.col
    counted = lambda n, one: F.when(c(n) == 1, one).otherwise(f"{one}s")
    short, long = c("minutes") < 60, c("minutes") >= 60
    share = F.coalesce(F.get(F.filter("tools", lambda t: t["label"] == cl.tool_name(F.lit(OWN))), 0)["value"], F.lit(0))
    made = F.array_compact(
        F.array(
            card("title", "week", text=tf.week_label(c("week_start"))),
            card("stat", "time spent", number=c("minutes"), unit=counted("minutes", "minute"), when=(c("minutes") > 0) & short),
            card("stat", "time spent", number=c("hours"), unit=counted("hours", "hour"), when=long),
            card("stat", "prompts sent", number=c("turns"), unit=counted("turns", "prompt"), when=c("turns") > 0),
            card("stat", "top tool", text=F.get("tools", 0)["label"], when=F.size("tools") > 0),
            card("ranked", "tools", rows=c("tools"), when=F.size("tools") > 1),
            card("ranked", "own assistant", rows=c("owns"), when=F.size("owns") > 0),
            card("stat", "own assistant", number=share, unit="% of prompts", when=F.coalesce(F.size("owns"), F.lit(0)) <= 0),
            card("ranked", "domains", rows=c("domains"), when=F.size("domains") > 0),
            card("stat", "peak hour", text=cl.hour_label(F.coalesce("peak_hour", F.lit(0)))),
            card("stat", "busiest day", text=F.date_format(c("busy_day").cast("date"), "EEEE"), when=c("busy_day").isNotNull()),
            card("podium", "hours", rows=c("board"), when=F.size("board") > 1),
        )
    )
    persons = F.transform(F.coalesce("badges", F.array()), lambda b: F.struct(F.lit("person").alias("kind"), cl.first_name(b["person"]).alias("title"), F.lit(None).cast("long").alias("hero_number"), b["badge"].alias("hero_text"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast(row).alias("rows")))
    none, peak = F.lit(None), cl.hour_label(F.coalesce("peak_hour", F.lit(0)))
    cells = [("hours", c("hours"), none, F.lit(True)), ("prompts", c("turns"), none, F.lit(True)), ("people", c("people"), none, F.lit(True)), ("top tool", none, F.get("tools", 0)["label"], F.size("tools") > 0), ("peak hour", none, peak, F.lit(True))]
    grid = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(k).cast("long").alias("place"), F.lit(n).alias("label"), v.cast("long").alias("value"), t.cast("string").alias("text"))) for k, (n, v, t, there) in enumerate(cells, 1)]))
    whole = F.concat(made, persons, F.array(card("summary", "summary", rows=grid)))
    return base.select(*TEAM, F.posexplode(whole).alias("position", "x")).select(*TEAM, "position", "x.*")


def live_board(facts: DataFrame, today: str) -> DataFrame:
    """Each person's last push, the version of the newest row, and today's shortcut and connector runs with details (OP-77).

    facts: person, received_ms, version, kind, day, name, runs.
    """
    last = facts.groupBy("person").agg(F.max("received_ms").alias("last_ms"), F.max_by("version", "received_ms").alias("version"))
    used = facts.where((F.col("day") == today) & F.col("kind").isin("connector", "shortcut")).groupBy("person", "kind", "name").agg(F.sum("runs").alias("runs"))
    runs = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("runs"))), F.lit(0)).alias(f"{kind}s")
    detail = F.array_sort(F.collect_list(F.struct((-F.col("runs")).alias("k"), "kind", "name", "runs")))
    per = used.groupBy("person").agg(runs("shortcut"), runs("connector"), F.transform(detail, lambda d: F.struct(d["kind"].alias("kind"), d["name"].alias("name"), d["runs"].alias("runs"))).alias("details"))
    out = last.join(per, "person", "left").withColumns({"shortcuts": F.coalesce("shortcuts", F.lit(0)), "connectors": F.coalesce("connectors", F.lit(0))})
    return out.orderBy(F.desc("shortcuts"), F.desc("connectors"), F.desc("last_ms"), "person")
