"""Text and time helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What command noise starts with, and the heading of an inbound message.
NOISE = ["<local-command-caveat>", "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>"]
INBOUND = "## Inbound user message"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it; an optimizer that moves the whole doesn't multiply it."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_noise(text: Column) -> Column:
    """Whether a user turn is a command's echo (OP-18)."""
    return text.rlike(r"(?U)^\s*(?:" + "|".join(NOISE) + ")")


def inbound(text: Column) -> Column:
    """What an inbound envelope holds: the text after its heading up to the next heading, trimmed; null if blank (OP-19)."""
    at = F.instr(text, INBOUND)
    inner = F.when(at > 0, F.substring(text, at + len(INBOUND), F.length(text))).otherwise(text)
    return F.nullif(trimmed(F.substring_index(inner, "\n##", 1)), F.lit(""))


def preview(text: Column, most: int = 120) -> Column:
    """One line of at most `most` characters, cut with an ellipsis (OP-44)."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.left(line, F.lit(most - 1)), F.lit("…")))


def hook_preview(text: Column, most: int = 120) -> Column:
    """As preview, but with line ends kept and the ellipsis after `most` characters."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def first_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most `most` bytes of UTF-8."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(cut, F.lit("�")))


def proposal_id(proposal: Column, facet: Column) -> Column:
    """A proposal beside `other` as an id of 1 to 48 characters; else null."""
    low = F.regexp_replace(F.translate(trimmed(proposal), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]", "_")
    bare = F.regexp_replace(low, "^_+|_+$", "")
    return F.when((facet == "other") & F.length(bare).between(1, 48), bare)


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


STAMP = r"^\s*([+-]?\d+)-(\d+)-(\d+)[Tt ](\d+):(\d+)(?::(\d+)(?:\.(\d*))?)?([Zz]|[+-]\d\d:?\d\d)?\s*$"


def epoch_ms(stamp: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 stamp (OP-41).

    A separator T, t or space is required; the zone may be absent (UTC); seconds may be; fractions are cut to milliseconds;
    days to 31 are taken in every month and roll over; anything else gives null.
    """
    fields_of = lambda s: F.split(F.regexp_replace(s, STAMP, "|".join(f"${k}" for k in range(1, 9))), r"\|")

    def of_fields(f: Column) -> Column:
        num = lambda k: F.get(f, k).try_cast("int")
        year, month, day, hour, minute, second = num(0), num(1), num(2), num(3), num(4), F.coalesce(num(5), F.lit(0))
        frac = F.rpad(F.substring(F.get(f, 6), 1, 3), 3, "0").try_cast("int")
        zone = F.replace(F.get(f, 7), F.lit(":"), F.lit(""))
        minutes = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(0)
        days = F.unix_date(F.make_date(year, month, F.lit(1))).cast("long") + day - 1
        ok = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
        return F.when(ok, days * 86_400_000 + (hour * 3600 + minute * 60 + second).cast("long") * 1000 + frac - minutes.cast("long") * 60_000)

    # one pass of the pattern for all fields, however large the expression of the stamp is
    return let(stamp, lambda s: F.when(s.rlike(STAMP), let(fields_of(s), of_fields)))


def utc_day(ms: Column) -> Column:
    """YYYY-MM-DD of an instant in UTC, whatever the session's zone (OP-42)."""
    return F.date_format(F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")


def local_day(ms: Column, offset_minutes: Column) -> Column:
    """YYYY-MM-DD on a device whose clock is this many minutes ahead of UTC."""
    return utc_day(ms + offset_minutes * 60_000)


def local_hour(ms: Column, offset_minutes: Column) -> Column:
    return F.floor(F.pmod(ms + offset_minutes * 60_000, F.lit(86_400_000)) / 3_600_000).cast("int")


def week_start(day: Column) -> Column:
    """The Monday of a day's week, as a string (OP-43)."""
    return F.date_format(F.date_trunc("week", day.cast("date")), "yyyy-MM-dd")


def week_label(start: Column) -> Column:
    """Mon d – Mon d, yyyy."""
    first = start.cast("date")
    last = F.date_add(first, 6)
    return F.concat(F.date_format(first, "MMM d"), F.lit(" – "), F.date_format(last, "MMM d, yyyy"))


def last_full_week(today: Column) -> Column:
    """The Monday of the last week that has ended by a day."""
    return F.date_format(F.date_add(F.date_trunc("week", today.cast("date")).cast("date"), -7), "yyyy-MM-dd")


def percent(x: Column, total: Column) -> Column:
    """Whole percent, 0 of nothing (OP-46)."""
    return F.coalesce(F.round(F.lit(100.0) * x / F.nullif(total, F.lit(0))), F.lit(0.0)).cast("long")


def weight(turns: Column, sessions: Column) -> Column:
    return F.when(turns > 0, turns).otherwise(F.greatest(sessions, F.lit(1)))


def row_key(*parts: Column) -> Column:
    """A key of parts, always delimited; null counts as empty (OP-45)."""
    return F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
