"""Filters by pause, week, and time of change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def outside_pauses(rows: DataFrame, pauses: DataFrame, at: str = "ts_ms", bucket_ms: int = 24 * HOUR_MS) -> DataFrame:
    """Rows that fall in no pause [from_ms, until_ms) of their device (OP-23, OP-31).

    An interval anti-join as an equi-join on device and time bucket: each pause is spread over the buckets it covers, so
    neither side has to be small.
    """
    spread = pauses.where("until_ms > from_ms").select("device", "from_ms", "until_ms", F.explode(F.sequence(F.expr(f"from_ms div {bucket_ms}"), F.expr(f"(until_ms - 1) div {bucket_ms}"))).alias("_bucket"))
    keyed = rows.withColumn("_bucket", F.expr(f"{at} div {bucket_ms}"))
    inside = (keyed["device"] == spread["device"]) & (keyed["_bucket"] == spread["_bucket"]) & (keyed[at] >= spread["from_ms"]) & (keyed[at] < spread["until_ms"])
    return keyed.join(spread, inside, "left_anti").drop("_bucket")


def in_week(rows: DataFrame, start: str, day: str = "day") -> DataFrame:
    """Rows whose day is in the week from this Monday on (OP-24)."""
    return rows.where(F.col(day).between(F.lit(start), F.date_format(F.date_add(F.lit(start).cast("date"), 6), "yyyy-MM-dd")))


def changed_since(files: DataFrame, mark_ms: int | None, now_ms: int, floor_days: int = 16) -> DataFrame:
    """Files modified at or after the mark; without one, in the last `floor_days` days (OP-22). files has modified_ms."""
    return files.where(F.col("modified_ms") >= (mark_ms if mark_ms is not None else now_ms - floor_days * 24 * HOUR_MS))
