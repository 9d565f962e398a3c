"""Scalar classification: providers, shapes, names, tool calls, hosts, verbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions import taxonomy as tx

# What tool calls are called in transcripts.
READ_VERBS = ["read", "find", "list", "search", "status", "sessions", "info", "get", "state"]
READ_DRIVERS = ["get_window_state", "get_accessibility_tree", "list_apps", "list_windows", "screenshot"]
READ_PAGE_ACTIONS = ["page_state", "screenshot", "read", "snapshot"]
FAMILIES = ["claude", "codex", "gemini", "cursor", "copilot"]
# Parts of labels of controls, in the order in which they are tried.
CONTROL_VERBS = [
    (r"\bsend\b", "send"), (r"\breply\b", "reply"), (r"\bforward\b", "forward"), (r"\barchive\b", "archive"), (r"delete|trash", "delete"), (r"download", "download"),
    (r"upload", "upload"), (r"share", "share"), (r"rename", "rename"), (r"\bsave\b", "save"), (r"create|\bnew\b", "create"), (r"\bcomment\b", "comment"), (r"\binvite\b", "invite"),
]


def mapped(column: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """names[column], or default (column itself)."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)
    return F.coalesce(found, column if default is None else default)


def one_of(column: Column, choices: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, else null."""
    return reduce(lambda w, c: w.when(*c), choices[1:], F.when(*choices[0])) if choices else F.lit(None)


def provider(model: Column, fallback: Column | None = None) -> Column:
    """The provider by the first prefix that the trimmed, lower-cased model starts with (OP-30)."""
    m = F.lower(F.regexp_replace(model, r"^\s+|\s+$", ""))
    found = one_of(m, [(m.startswith(p), F.lit(v)) for p, v in tx.MODEL_PREFIXES])
    return found if fallback is None else F.coalesce(found, fallback)


def shape(intent: Column) -> Column:
    """asking, expressing, other or doing; an unknown intent is doing (OP-39)."""
    return F.when(intent.isin(tx.ASKING), "asking").when(intent.isin(tx.EXPRESSING), "expressing").when(intent == tx.OTHER, tx.OTHER).otherwise("doing")


def tool_name(tool: Column) -> Column:
    return mapped(tool, tx.DISPLAY_NAMES)


def domain_title(domain: Column) -> Column:
    """The title of a domain; of others the id with spaces and initial capitals (OP-40)."""
    return mapped(domain, tx.DOMAIN_TITLES, F.initcap(F.replace(domain, F.lit("_"), F.lit(" "))))


def app_label(app: Column) -> Column:
    return mapped(app, tx.APP_LABELS)


def hour_label(hour: Column) -> Column:
    """3 -> 3 AM, 15 -> 3 PM."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int")
    return F.concat(twelve.cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def first_name(person: Column) -> Column:
    """What stands in front of the first blank, dot, underscore or hyphen; the whole name if nothing does."""
    return F.coalesce(F.nullif(F.regexp_extract(person, r"^[^\s._-]+", 0), F.lit("")), person)


def capability_kind(capability: Column) -> Column:
    """read_only if the last part after `.` or `_` is a read verb, else mutating (OP-34)."""
    return F.when(F.regexp_extract(capability, "[^._]*$", 0).isin(READ_VERBS), "read_only").otherwise("mutating")


def host(url: Column) -> Column:
    """Host of a URL: no scheme, nothing from / ? # on, no leading www. (OP-37); null if empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    bare = F.when(rest, F.regexp_replace(url, r"^[\s\S]*?://", "")).otherwise(url)
    return F.nullif(F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*", 0), r"^(www\.)+", ""), F.lit(""))


def script_app(script: Column) -> Column:
    """The application that a script names, by the first of three markers that gives one (OP-36)."""
    found = [F.nullif(F.trim(F.regexp_extract(script, p, 1)), F.lit("")) for p in (r'application id "([^"]*)"', r'application "([^"]*)"', r'Application\("([^"]*)"')]
    return F.coalesce(*found)


def control_verb(label: Column) -> Column:
    """The verb of a control's label, by the first pattern found in it; null if none (OP-38)."""
    low = F.lower(label)
    return one_of(low, [(low.rlike(p), F.lit(v)) for p, v in CONTROL_VERBS])


def control_kind(verb: Column) -> Column:
    return F.when(verb == "download", "read_only").otherwise("mutating")


def field(v: Column, *keys: str) -> Column:
    """The first string among the fields of a variant object; other types don't count."""
    of = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    return F.coalesce(*[of(k) for k in keys])


def whole(v: Column, key: str) -> Column:
    """An integral number field of a variant object."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "BIGINT", F.try_variant_get(v, f"$.{key}", "bigint"))


def tool_call(name: Column, args: Column) -> Column:
    """struct(tool, action, app, target, kind) of a tool call, or null for calls that are no action (OP-33)."""
    action, capability = field(args, "action"), field(args, "capability")
    query, connector = field(args, "query", "text", "task"), field(args, "connectorId", "connector_id")
    row = lambda tool, act, app, target, kind: F.struct(tool.alias("tool"), act.alias("action"), app.alias("app"), target.alias("target"), kind.alias("kind"))
    runs = (F.coalesce(action, F.lit("")).isin("", "execute_connector")) & capability.isNotNull()
    shortcut = runs & (capability == "shortcut.run")
    driver, inner = F.coalesce(field(args, "tool"), F.lit("cua")), F.try_variant_get(args, "$.args", "variant")
    names = ("appName", "bundleId", "bundle_id")
    element, pid = whole(inner, "element_index"), whole(inner, "pid")
    target = F.coalesce(field(inner, "value", "text", "filePath", "query"), F.concat(F.lit("element#"), element.cast("string")), F.concat(F.lit("pid "), pid.cast("string")))
    script = F.coalesce(field(args, "script"), F.lit(""))
    page, url = F.coalesce(action, F.element_at(F.split(name, "__"), -1)), field(args, "url", "href")
    text = lambda s: F.lit(s)
    return (
        F.when((name == "app_runtime") & shortcut, F.when(query.isNotNull(), row(text("shortcut"), query, connector, query, text("mutating"))))
        .when((name == "app_runtime") & runs, row(text("connector"), capability, connector, query, capability_kind(capability)))
        .when(name == "bdc__run_applescript", row(name, text("run_applescript"), script_app(script), F.regexp_replace(script, r"^\s+|\s+$", ""), text("mutating")))
        .when(name == "bdc__cua", row(name, driver, F.coalesce(field(inner, *names), field(args, *names)), target, F.when(driver.isin(READ_DRIVERS), "read_only").otherwise("mutating")))
        .when(name.startswith("browser"), row(name, page, host(url), url, F.when(page.isin(READ_PAGE_ACTIONS), "read_only").otherwise("mutating")))
    )


def family(name: Column) -> Column:
    return one_of(name, [(name.contains(f), F.lit(f)) for f in FAMILIES])


def driven_tool(name: Column, args: Column) -> Column:
    """The AI that a tool call hands work to, or null: spawns by agent family, connector runs by family and verb (OP-35)."""
    spawned = family(F.lower(F.coalesce(field(args, "agentId"), F.lit(""))))
    capability = F.lower(F.coalesce(field(args, "capability"), F.lit("")))
    of, verb = family(capability), F.regexp_extract(capability, r"[^.]*$", 0)
    code = verb.startswith("code")
    drives = F.coalesce(field(args, "action"), F.lit("")).isin("", "execute_connector") & (code | verb.isin("run", "review", "ask", "send", "resume"))
    return F.when(name.isin("sessions_spawn", "subagents", "task", "agent"), F.when(spawned == "claude", "claude_code").otherwise(spawned)).when(
        (name == "app_runtime") & drives, F.when((of == "claude") & code, "claude_code").when(of == "claude", "claude_chat").otherwise(of)
    )
