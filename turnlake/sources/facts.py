"""Fact rows: reading interleaved NDJSON of many devices, and making the rows of a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import classify as cl
from turnlake.functions import taxonomy as tx
from turnlake.functions.text import row_key
from turnlake.operators.dedupe import union_sources

SCHEMA = "usage/3"
KINDS = ["analytics_cell", "session_span", "delegation", "connector", "shortcut"]
TEXTS = {"device": "", "person": "unknown", "device_name": "", "day": "", "tool": "other", "provider": "", "surface": "", "intent": "other", "shape": "other", "domain": "other", "delegation": "none", "delegate_tool": "none", "driven_tool": "other", "name": "", "detail": ""}
NUMBERS = {"hour": 0, "depth": 1, "turns": 0, "sessions": 0, "chars": 0, "total_minutes": 0, "longest_minutes": 0, "runs": 0}


def read_fact_rows(lines: DataFrame) -> DataFrame:
    """Typed rows of NDJSON lines (column value); `bad` marks those that are no JSON object (OP-11).

    Missing texts and non-finite or missing numbers take their defaults; a usage row's person defaults to ''.
    """
    v = F.try_parse_json("value")
    rows = lines.where(F.col("value").rlike(r"\S")).withColumn("v", v)
    of = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    kind = of("kind", "string")
    texts = [F.coalesce(of(k, "string"), F.when(kind.isin("connector", "shortcut"), "").otherwise(default) if k == "person" else F.lit(default)).alias(k) for k, default in TEXTS.items()]
    numbers = []
    for k, default in NUMBERS.items():
        x = of(k, "double")
        numbers.append(F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e15), x.cast("long")).otherwise(default).alias(k))
    name = F.coalesce(of("tool_name", "string"), of("tool", "string"), F.lit("other")).alias("tool_name")
    bad = ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return rows.select(kind.alias("kind"), *texts, name, of("model", "string").alias("model"), *numbers, bad.alias("bad"))


def read_fact_files(spark: SparkSession, *paths: str) -> DataFrame:
    return read_fact_rows(spark.read.text(list(paths)))


def key_of_row() -> Column:
    """The identity of a fact row: kind and its dimensions, always delimited; null for kinds that aren't merged (OP-45)."""
    c = F.col
    cell = row_key(*[c(k) for k in ("kind", "device", "person", "day", "hour", "tool", "provider", "surface", "model", "intent", "domain", "depth", "delegation", "delegate_tool")])
    return (
        F.when(c("kind") == "analytics_cell", cell)
        .when(c("kind") == "session_span", row_key(*[c(k) for k in ("kind", "device", "person", "day", "tool")]))
        .when(c("kind") == "delegation", row_key(*[c(k) for k in ("kind", "device", "person", "day", "tool", "driven_tool")]))
        .when(c("kind").isin("connector", "shortcut"), row_key(*[c(k) for k in ("kind", "device", "person", "day", "name", "detail")]))
    )


def fact_rows(cells: DataFrame, spans: DataFrame, connectors: DataFrame, shortcuts: DataFrame, drives: DataFrame, devices: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """All kinds of fact rows in one table with the device's person and name (OP-14). devices is small: one row each."""
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    named = lambda df: df.withColumn("tool_name", cl.tool_name(F.col("tool")))
    full = cells.withColumns({"shape": cl.shape(F.col("intent")), "taxonomy_version": F.lit(tx.TAXONOMY_VERSION).cast("long")})
    parts = [kind(named(full), "analytics_cell"), kind(named(spans), "session_span"), kind(connectors, "connector"), kind(shortcuts, "shortcut"), kind(named(drives), "delegation")]
    if candidates is not None:
        parts.append(kind(candidates.withColumn("device", F.lit(None).cast("string")), "label_candidate"))
    return union_sources(*parts).join(devices.select("device", "person", "device_name"), "device", "left").withColumn("schema", F.lit(SCHEMA))
