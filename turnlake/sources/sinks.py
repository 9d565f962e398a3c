"""Flat exports and the store of fact rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.text import utc_day
from turnlake.operators.dedupe import SESSION, last_wins
from turnlake.operators.filters import in_week
from turnlake.sources.facts import key_of_row


def interactions(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """One flat row for each turn (OP-12)."""
    rows = turns.join(sessions.select(*SESSION, "provider", "surface", "model"), SESSION)
    return rows.select(
        F.lit("interaction/1").alias("schema"), F.concat_ws(":", "device", "external_id", F.col("seq").cast("string")).alias("event_id"), "device", utc_day(F.col("ts_ms")).alias("day"), "ts_ms", "provider", "tool", "surface", "model",
        F.col("external_id").alias("session_id"), F.col("seq").alias("turn_index"), "role", F.col("redacted_text").alias("text"), F.length("redacted_text").cast("long").alias("text_chars"),
    )


def flat_actions(actions: DataFrame) -> DataFrame:
    """One flat row for each action (OP-13)."""
    return actions.select(F.lit("action/1").alias("schema"), F.concat_ws(":", "device", "source", "ext_id").alias("event_id"), utc_day(F.col("ts_ms")).alias("day"), *actions.columns)


def landing(spark: SparkSession, name: str) -> str:
    """A new folder for a written export: under spark.checkpoint.dir, which all executors share; in local mode, where that may be unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/turnlake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to a folder and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_day(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines by day; null fields are left out; each file is ordered, no global sort (OP-86).

    Ranges of days, of about equal rows: a day's file is split only where a range ends, so files grow with days or with rows, not with both.
    """
    ranges = rows.repartitionByRange("day", F.xxhash64("event_id"))
    by_folder(ranges.sortWithinPartitions("day", *order), path, "day")


def by_folder(rows: DataFrame, path: str, *folders: str, form: str = "json") -> None:
    """Rewrite the folders that rows has rows for, as JSON lines (form text: lines as they are).

    Tasks put their files into the staging folder of the write as they end, which is moved into place at the end (the committer's
    second form): the driver would move the files of all tasks one after the other.
    """
    staged = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    staged.partitionBy(*folders).format(form).save(path)


def has_folders(spark: SparkSession, path: str, name: str) -> bool:
    """Whether a folder holds folders of a partition column."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def write_fact_rows(rows: DataFrame, path: str) -> None:
    """NDJSON of all kinds by kind and month, in files ordered by day (OP-14). Days of a kind that rows has rows for are rewritten, others stay.

    A day of a kind is a few rows, so files grow with months or with rows, not with days. A line holds its row's kind and day, for
    read_fact_files; what else a rewritten month holds is carried over as the lines that it is.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    lines = rows.select(text(F.col("kind")).alias("kind"), text(F.substring("day", 1, 7)).alias("month"), text(F.col("day")).alias("day"), F.to_json(F.struct(*rows.columns)).alias("value"))
    if has_folders(spark := rows.sparkSession, path, "kind"):
        stored = spark.read.schema("value string, kind string, month string").text(path)
        stored = stored.select(*[text(F.col(k)).alias(k) for k in ("kind", "month")], text(F.get_json_object("value", "$.day")).alias("day"), "value")
        days = lines.select("kind", "month", "day").distinct()
        others = stored.join(days.select("kind", "month").distinct(), ["kind", "month"], "left_semi").join(days, ["kind", "month", "day"], "left_anti")
        lines = lines.unionByName(others)
    ranges = lines.repartitionByRange("kind", "month", "day", F.xxhash64("value"))
    by_folder(ranges.sortWithinPartitions("kind", "month", "day").select("value", "kind", "month"), path, "kind", "month", form="text")


def merge_snapshot(stored: DataFrame, push: DataFrame) -> DataFrame:
    """The store after a push (OP-15, OP-55): rows of devices that pushed a keyed row are replaced by the push's last row for each key; other devices stay.

    Rows without a key or day are skipped. Both have received_ms.
    """
    keyed = push.withColumn("_key", key_of_row()).where(F.col("_key").isNotNull() & (F.coalesce("day", F.lit("")) != ""))
    fresh = last_wins(keyed, ["device", "_key"], F.col("received_ms")).drop("_key")
    return stored.join(keyed.select("device").distinct(), "device", "left_anti").unionByName(fresh)


def merge_counts(stored: DataFrame, push: DataFrame) -> DataFrame:
    """stored, skipped and pruned of a push."""
    keyed = push.withColumn("_key", key_of_row())
    good = F.col("_key").isNotNull() & (F.coalesce("day", F.lit("")) != "")
    kept = keyed.where(good).select("device", "_key").distinct()
    gone = stored.withColumn("_key", key_of_row()).join(kept.select("device").distinct(), "device", "left_semi").join(kept, ["device", "_key"], "left_anti")
    return kept.agg(F.count("*").alias("stored")).join(keyed.agg(F.count_if(~good).alias("skipped"))).join(gone.agg(F.count("*").alias("pruned")))


def week_rows(rows: DataFrame, start: str) -> DataFrame:
    """Rows of one week, by day (OP-16)."""
    return in_week(rows, start).orderBy("day")


def archive_week(rows: DataFrame, start: str, path: str) -> None:
    """Rewrite one week's archive, so that late uploads fold in (OP-17)."""
    in_week(rows, start).withColumn("week_start", F.lit(start)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").json(path)
