"""A kept index of files: which of them are new or have changed, and which wait because they are still growing (OP-22)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.sources.versions import Conflict, Versions

COOLDOWN_MS, BYTES_PER_MS = 30_000, 256  # a file that was parsed waits this long, longer if it is large
SCHEMA = "file string, size bigint, modified_ms bigint, parsed_ms bigint"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, size and modified_ms of all matching files; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


class FileIndex:
    """Size and time of every file as it was when it was last parsed, in versions that are put in place whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def known(self) -> DataFrame:
        at = self.versions.latest()[1].get("data")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], SCHEMA)

    def changed(self, files: DataFrame, now_ms: int, since_ms: int = 0, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
        """Files at or after the mark that aren't known as they are, but for those parsed too short a time ago.

        The wait is the larger of cooldown_ms and a millisecond for each 256 bytes; with a cooldown of 0 nothing waits. A file that
        is back to the state it was parsed in is unchanged; one whose time goes backwards has changed.
        """
        seen = self.known().select("file", F.col("size").alias("_size"), F.col("modified_ms").alias("_modified"), "parsed_ms")
        wait = F.greatest(F.lit(cooldown_ms), F.floor(F.col("size") / BYTES_PER_MS)) if cooldown_ms else F.lit(0)
        fresh = F.col("parsed_ms").isNull()
        moved = (F.col("size") != F.col("_size")) | (F.col("modified_ms") != F.col("_modified"))
        ready = F.lit(now_ms) - F.col("parsed_ms") >= wait
        return files.where(F.col("modified_ms") >= since_ms).join(seen, "file", "left").where(fresh | (moved & ready)).select("file", "size", "modified_ms")

    def parsed(self, files: DataFrame, now_ms: int) -> None:
        """Keep these files as they are. Another writer's version is merged, the later parse of a file stays."""
        mine = files.select("file", "size", "modified_ms", F.lit(now_ms).cast("long").alias("parsed_ms"))
        while True:
            number, _ = self.versions.latest()
            latest = F.max_by(F.struct("size", "modified_ms", "parsed_ms"), F.col("parsed_ms")).alias("x")
            merged = self.known().unionByName(mine).groupBy("file").agg(latest).select("file", "x.*")
            at = f"data/{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.path}/{at}")
            try:
                return self.versions.commit(number + 1, {"data": at})
            except Conflict:
                self.versions.remove(at)
