"""Redaction of secrets and personal data before anything is written."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import let


def card_ok(match: str) -> bool:
    digits = [int(c) for c in match if c in "0123456789"]
    doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def ssn_ok(match: str) -> bool:
    if not match.isascii():
        return False
    area, group, serial = map(int, match.split("-"))
    return area not in (0, 666) and area < 900 and group != 0 and serial != 0


def phone_ok(match: str) -> bool:
    return 7 <= sum(c in "0123456789" for c in match) <= 15


# Kinds, patterns and their order. A later rule sees what earlier ones left.
RULES: list[tuple[str, str, Callable[[str], bool] | None]] = [
    ("aws_key", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b", None),
    ("github_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b", None),
    ("openai_key", r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}\b", None),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", None),
    ("stripe_key", r"\b(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}\b", None),
    ("google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b", None),
    ("private_key_block", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", None),
    ("assigned_secret", r"""(?i)\b(?:api[_-]?key|secret|token|password|passwd|access[_-]?key|client[_-]?secret)\b\s*[:=]\s*['"]?([A-Za-z0-9_\-\.]{12,})['"]?""", None),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", None),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b", card_ok),
    ("us_ssn", r"\b\d{3}-\d{2}-\d{4}\b", ssn_ok),
    ("phone", r"\b(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{3,4}[ .\-]\d{3,4}(?:[ .\-]\d{2,4})?\b", phone_ok),
]
#: What a text with a match of the rule holds: a cheap test in front of it. \p{Nd} stands for digits of all scripts.
HOLDS = {
    "aws_key": "A[KSGIRN][IDOPV]A", "github_token": "gh[pousr]_|github_pat_", "openai_key": "sk-", "slack_token": "xox[baprs]-", "stripe_key": "_live_", "google_api_key": "AIza", "private_key_block": "PRIVATE KEY-----",
    "assigned_secret": r"[yYtTnNdD][\t-\r\x1c-\x20\x85\p{Z}]*[:=]", "email": "@",
    "credit_card": r"\p{Nd}(?:[ -]?\p{Nd}){12}", "us_ssn": r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}", "phone": r"\p{Nd}{3}[ .\-]\p{Nd}{3}",
}
#: Characters that a match of these rules begins with, so that word bounds are looked for there only.
BEGINS = {"aws_key": "(?=A)", "github_token": "(?=g)", "openai_key": "(?=sk-)", "slack_token": "(?=xox)", "stripe_key": "(?=[srp]k_)", "google_api_key": "(?=AIza)", "credit_card": r"(?=\p{Nd})", "us_ssn": r"(?=\p{Nd})", "phone": r"(?=[+(\p{Nd}])", "assigned_secret": "(?=[AaCcPpSsTt\u017f])", "email": r"(?=[A-Za-z0-9._%+\-])"}
_compiled = [(kind, re.compile(pattern), ok) for kind, pattern, ok in RULES]

# What the patterns' short forms mean, spelled out for the JVM: letters, digits and white space of all scripts.
WORD = r"[\p{L}\p{N}_]"
SPELLED = {r"\b": f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))", r"\d": r"\p{Nd}", r"\s": r"[\t-\r\x1c-\x20\x85\p{Z}]"}


def spelled(pattern: str) -> str:
    """A pattern of RULES for the JVM's regular expressions. [\\s\\S] stays: it is every character in both."""
    parts = pattern.split(r"[\s\S]")
    return r"[\s\S]".join(re.sub(r"\\[bds]", lambda m: SPELLED[m[0]], p).replace("(?i)", "(?iu)") for p in parts)


def placeholder(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def redact_text(text: str) -> tuple[str, dict[str, int]]:
    """The text with every match replaced, and how many of each kind were: what redacted() does, one text at a time in Python."""
    counts: dict[str, int] = {}
    for kind, pattern, ok in _compiled:
        n = 0

        def swap(m: re.Match, kind: str = kind, ok: Callable[[str], bool] | None = ok) -> str:
            nonlocal n
            if ok is not None and not ok(m[0]):
                return m[0]
            n += 1
            return placeholder(kind)

        text = pattern.sub(swap, text)
        if n:
            counts[kind] = n
    return text, counts


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def card_valid(match: Column) -> Column:
    """card_ok as an expression: 13 to 19 ASCII digits whose sum, every second one from the right doubled, ends in 0."""
    d = F.reverse(digits(match))
    value = lambda c, k: F.when(k % 2 == 0, c).otherwise(2 * c - F.when(c > 4, 9).otherwise(0))
    doubled = F.transform(F.split(d, ""), lambda c, k: value(F.coalesce(c.try_cast("int"), F.lit(0)), k))
    return F.length(d).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0)


def ssn_valid(match: Column) -> Column:
    return match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def phone_valid(match: Column) -> Column:
    return F.length(digits(match)).between(7, 15)


VALID = {card_ok: card_valid, ssn_ok: ssn_valid, phone_ok: phone_valid}


def swapped(text: Column, found: Column, pattern: str, kind: str, valid: Callable[[Column], Column]) -> Column:
    """text with the valid ones of a pattern's matches (`found`) replaced and the others left: pieces and matches, put together again."""
    said = lambda k: let(F.get(found, k), lambda m: F.when(valid(m), F.lit(placeholder(kind))).otherwise(m))
    return F.array_join(F.transform(F.split(text, pattern, -1), lambda p, k: F.concat(p, F.coalesce(said(k), F.lit("")))), "")


def after_rule(state: Column, kind: str, pattern: str, ok: Callable[[str], bool] | None) -> Column:
    """state, a struct(text, n), after one more rule; n holds how many matches of each rule so far were replaced."""
    text, java = state["text"], BEGINS.get(kind, "") + spelled(pattern)
    step = lambda new, n: F.struct(new.alias("text"), F.concat(state["n"], F.array(n.cast("long"))).alias("n"))
    if ok is None:
        changed = step(F.regexp_replace(text, java, placeholder(kind)), F.regexp_count(text, F.lit(java)))
    else:
        changed = let(F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda m: step(F.when(F.size(m) > 0, swapped(text, m, java, kind, VALID[ok])).otherwise(text), F.size(F.filter(m, VALID[ok]))))
    return F.when(text.rlike(HOLDS[kind]), changed).otherwise(step(text, F.lit(0)))


def after_token_rule(text: Column, kind: str) -> Column:
    """text after one of the rules without a validator, which looks only at texts that hold what its matches hold."""
    pattern = next(p for k, p, ok in RULES if k == kind and ok is None)
    swap = lambda t: F.when(t.rlike(HOLDS[kind]), F.regexp_replace(t, BEGINS.get(kind, "") + spelled(pattern), placeholder(kind))).otherwise(t)
    return let(text, swap)


def redacted(df: DataFrame, column: str, counts: str | None = None) -> DataFrame:
    """df with `column` redacted and, if named, a map of the counts by kind (OP-47, OP-48, OP-49). Null stays null.

    All rules are one column expression, each over what the rule before it left. A rule looks at a text only if the text holds
    what every match of the rule holds; a text that holds none of these passes as it is.
    """

    def rules(text: Column) -> Column:
        state = F.struct(text.alias("text"), F.array().cast("array<bigint>").alias("n"))
        for kind, pattern, ok in RULES:
            state = let(state, lambda s: after_rule(s, kind, pattern, ok))  # noqa: B023  called at once
        none = F.struct(text.alias("text"), F.array(*[F.lit(0).cast("long")] * len(RULES)).alias("n"))
        return F.when(reduce(or_, [text.rlike(mark) for mark in HOLDS.values()]), state).otherwise(none)

    state = let(F.col(column).cast("string"), rules)
    df = df.withColumn("_redacted", state)
    done = {column: F.col("_redacted.text")}
    if counts:
        # one use of the column: a filter that the optimizer moves below it repeats all rules for each use
        kinds = F.array(*[F.lit(kind) for kind, _, _ in RULES])
        numbers = F.transform("_redacted.n", lambda n, k: F.struct(F.get(kinds, k).alias("k"), n.alias("n")))
        done[counts] = F.map_from_entries(F.filter(numbers, lambda x: x["n"] > 0))
    return df.withColumns(done).drop("_redacted")


def audit(df: DataFrame, counts: str, *by: str) -> DataFrame:
    """Redactions by kind and the given columns (OP-50).

    Exploded as outer, as the optimizer puts a test of the map's size before a plain explode, where all rules would run again.
    """
    return df.select(*by, F.explode_outer(counts).alias("kind", "n")).where("kind IS NOT NULL").groupBy(*by, "kind").agg(F.sum("n").alias("n"))


def redact_spans(text: Column, spans: Column, least: float = 0.5) -> Column:
    """struct(text, n): detected spans array<struct<text,class,prob>> replaced by [class], longest first (OP-51).

    Spans below `least` or of fewer than three characters when trimmed are left; every occurrence counts.
    """
    good = F.filter(spans, lambda s: (s["prob"] >= least) & (F.length(F.trim(s["text"])) >= 3))
    ordered = F.array_sort(F.transform(good, lambda s: F.struct((-F.length(F.trim(s["text"]))).alias("k"), F.trim(s["text"]).alias("t"), s["class"].alias("c"))))
    start = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        gone = F.length(acc["text"]) - F.length(F.replace(acc["text"], s["t"], F.lit("")))
        tag = F.concat(F.lit("["), s["c"], F.lit("]"))
        return F.struct(F.replace(acc["text"], s["t"], tag).alias("text"), (acc["n"] + F.floor(gone / F.length(s["t"]))).cast("long").alias("n"))

    return F.aggregate(ordered, start, step)


def gated_turns(turns: DataFrame) -> DataFrame:
    """Turns as they may be written: text redacted (OP-49)."""
    return redacted(turns, "redacted_text")


def gated_actions(actions: DataFrame) -> DataFrame:
    """Actions as they may be written: the target redacted first, then cut to one line (OP-49)."""
    from turnlake.functions.text import preview

    return redacted(actions, "target_redacted").withColumn("target_redacted", preview(F.col("target_redacted")))
