"""The store of fact rows: pushes of devices as transactions, laid out by device bucket and week, with totals of each week.

A push writes one part: a folder for each bucket, whose files are sorted by week, so their number follows buckets and bytes and not the
weeks a device spans. A version maps each (bucket, week) to the part that holds its rows and totals; a push writes the pairs that it
changes into a new part, then commits a version that points to it. Rows of a part that no longer are its bucket's and week's are left
out when it is read; a bucket spread over more than PARTS parts is written together again by the next push that changes it. Until
the commit readers see the version before; a run that dies leaves folders that no version names, which vacuum() clears.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnlake.functions.text import week_start
from turnlake.operators.dedupe import last_wins
from turnlake.sources.facts import key_of_row
from turnlake.sources.versions import Conflict, Versions

BUCKETS = 64
PARTS = 8  # of one bucket, before they are written together
SENT = 100_000  # entries of a version, about 10 MB, that are sent to every task
NO_WEEK = "none"  # of rows whose day is no date
TOTALS = ["kind", "person", "tool"]
SUMS = ["turns", "sessions", "chars", "total_minutes", "runs"]


class SnapshotStore:
    """Fact rows of all devices (OP-15, OP-17, OP-91). Each push is the whole of its devices: rows it doesn't repeat go."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.buckets = buckets

    # --- reading ---

    def manifest(self) -> tuple[int, dict]:
        number, found = self.versions.latest()
        return number, {"entries": {}, "applied": {}, "schema": None, "buckets": self.buckets} | found

    def _read(self, manifest: dict, what: str, wanted: list[str]) -> DataFrame | None:
        """`rows` or `totals` of the given entries, with bucket and week; folders that hold none of them are never listed."""
        if not wanted:
            return None
        live = [(manifest["entries"][e], *_pair(e)) for e in wanted]
        paths = sorted({f"{self.path}/{part}/{what}/bucket={b}" for part, b, _ in live})
        at = lambda k: F.regexp_extract("_metadata.file_path", rf"/(data/[^/]+/[^/]+)/{what}/bucket=(\d+)/[^/]*$", k)
        schema = manifest["schema" if what == "rows" else "totals_schema"]
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        weeks = {w for *_, w in live}
        found = found.where(F.col("week").between(min(weeks), max(weeks))).withColumns({"_part": at(1), "bucket": at(2).cast("int")})
        named = self.spark.createDataFrame(live, "_part string, bucket int, week string")
        return found.join(named.hint("broadcast") if len(live) <= SENT else named, ["_part", "bucket", "week"], "left_semi").drop("_part")

    def _entries(self, manifest: dict, weeks: list[str] | None = None, buckets: list[int] | None = None) -> list[str]:
        out = []
        for e in sorted(manifest["entries"]):
            b, w = _pair(e)
            if (weeks is None or w in weeks) and (buckets is None or b in buckets):
                out.append(e)
        return out

    def rows(self, weeks: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of the last or a given version, of all weeks or some (each named by its Monday); None if there are none."""
        manifest = self.manifest()[1] if version is None else self.versions.read(version)
        found = self._read(manifest, "rows", self._entries(manifest, weeks))
        return None if found is None else found.drop("bucket", "week")

    def week_totals(self, weeks: list[str] | None = None) -> DataFrame | None:
        """Sums, the longest session and the devices of each week, kind, person and tool, from the totals of the buckets alone."""
        manifest = self.manifest()[1]
        parts = self._read(manifest, "totals", self._entries(manifest, weeks))
        if parts is None:
            return None
        return parts.groupBy("week", *TOTALS).agg(*[F.sum(c).alias(c) for c in (*SUMS, "devices", "rows")], F.max("longest_minutes").alias("longest_minutes"))

    # --- writing ---

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("device"), F.lit(buckets)).cast("int")

    def _reached(self, step: str) -> None:
        """Between two steps of a push; tests stop it here."""

    def apply(self, push: DataFrame, source: str = "", batch: int = -1) -> dict:
        """Commit a push: rows with device, day, received_ms and the columns of facts. Counts of stored, skipped and pruned rows, and the weeks changed.

        Rows without a key or day are skipped; of rows with one key the last by received_ms stays. A device counts as pushed if it
        sent a row with a key and day. With a source name, a batch number that the source has had already changes nothing, so
        that a retried stream batch is applied once. Where another writer commits first, the push is merged again on its version.
        """
        if (done := self._applied(self.manifest()[1], source, batch)) is not None:
            return done
        txn = uuid.uuid4().hex
        buckets = self.manifest()[1]["buckets"]
        keyed = push.withColumn("_key", key_of_row())
        good = F.col("_key").isNotNull() & (F.coalesce("day", F.lit("")) != "")
        fresh = last_wins(keyed.where(good), ["device", "_key"], F.col("received_ms")).drop("_key")
        placed = fresh.withColumns({"bucket": self._bucket(buckets), "week": F.coalesce(week_start(F.col("day").try_cast("date")), F.lit(NO_WEEK))})
        placed.write.parquet(f"{self.path}/data/{txn}/push")
        self._reached("push written")
        skipped = keyed.agg(F.count_if(~good)).first()[0]
        pushed = self.spark.read.schema(placed.schema).parquet(f"{self.path}/data/{txn}/push")
        mine = [(r.bucket, r.week) for r in pushed.select("bucket", "week").distinct().collect()]  # at most buckets x weeks
        stored = pushed.count()
        while True:
            number, base = self.manifest()
            if (done := self._applied(base, source, batch)) is not None:
                return done
            entries, pruned, weeks, schemas = self._merged(base, pushed, mine, txn)
            self._reached("rows written")
            next_version = base | schemas | {"entries": entries, "buckets": buckets}
            if batch >= 0:
                next_version["applied"] = base["applied"] | {source: {"batch": batch, "weeks": weeks}}
            try:
                self.versions.commit(number + 1, next_version)
            except Conflict:
                continue
            self._reached("committed")
            self.versions.remove(f"data/{txn}/push")
            return {"stored": stored, "skipped": skipped, "pruned": pruned, "weeks": weeks}

    def _applied(self, manifest: dict, source: str, batch: int) -> dict | None:
        """What a batch that has been applied gives: its weeks again, so that what hangs on them can be made again."""
        last = manifest["applied"].get(source, {"batch": -1, "weeks": []})
        return {"stored": 0, "skipped": 0, "pruned": 0, "weeks": last["weeks"]} if 0 <= batch <= last["batch"] else None

    def _merged(self, base: dict, pushed: DataFrame, mine: list[tuple[int, str]], txn: str) -> tuple[dict, int, list[str], dict]:
        """Entries of the next version, how many rows of the last one are gone, the weeks changed and the schemas; writes the changed (bucket, week) pairs."""
        devices = pushed.select("bucket", "device").distinct()
        old = self._entries(base, buckets={b for b, _ in mine})
        held = self._read(base, "rows", old)
        changed, pruned = {_entry(b, w) for b, w in mine}, 0
        if held is not None:
            # only the device column of the push's own buckets is read to find the weeks that lose rows
            gone = held.select("bucket", "week", "device").join(devices, ["bucket", "device"], "left_semi").groupBy("bucket", "week").count().collect()
            changed |= {_entry(r.bucket, r.week) for r in gone}
        moved = changed | self._crowded(base, old)
        part = f"data/{txn}/{uuid.uuid4().hex}"
        keep = self._read(base, "rows", [e for e in old if e in moved])
        rows = pushed
        if keep is not None:
            lost = keep.join(devices, ["bucket", "device"], "left_semi").withColumn("_key", key_of_row())
            pruned = lost.join(pushed.withColumn("_key", key_of_row()).select("device", "_key"), ["device", "_key"], "left_anti").count()
            rows = keep.join(devices, ["bucket", "device"], "left_anti").unionByName(pushed, allowMissingColumns=True)
        self._write(rows, f"{part}/rows")
        self._reached("half written")
        body = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part}/rows")
        totals = week_parts(body)
        self._write(totals, f"{part}/totals")
        there = {_entry(r.bucket, r.week) for r in body.select("bucket", "week").distinct().collect()}
        entries = {e: x for e, x in base["entries"].items() if e not in moved} | dict.fromkeys(there, part)
        weeks = sorted({_pair(e)[1] for e in changed})
        return entries, pruned, weeks, {"schema": _schema(rows, base["schema"]), "totals_schema": _schema(totals)}

    def _write(self, rows: DataFrame, relative: str) -> None:
        """A folder for each bucket, files sorted by week, so that readers of some weeks skip row groups; a hot bucket is split over tasks."""
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "week").write.partitionBy("bucket").parquet(f"{self.path}/{relative}")

    def _crowded(self, base: dict, old: list[str]) -> set[str]:
        """All entries of the buckets that lie in more than PARTS parts."""
        parts: dict[int, set[str]] = {}
        for e in old:
            parts.setdefault(_pair(e)[0], set()).add(base["entries"][e])
        return {e for e in old if len(parts[_pair(e)[0]]) > PARTS}

    def vacuum(self, keep: int = 2, older_than_ms: int = 24 * 3_600_000) -> int:
        """Clear what only versions before the last `keep` name, and what no version names and is older than the age; how many folders."""
        numbers = self.versions.numbers()
        kept = [self.versions.read(n) for n in numbers[-keep:]]
        named = {x.split("/")[1] for m in kept for x in m["entries"].values()}
        limit = int(time.time() * 1000) - older_than_ms
        gone = [name for name, at in self.versions.folders("data") if name not in named and at <= limit]
        self.versions.remove(*[f"data/{name}" for name in gone], *[f"_versions/{n:012d}.json" for n in numbers[:-keep]])
        return len(gone)


def _entry(bucket: int, week: str) -> str:
    return f"bucket={bucket}/week={week}"


def _pair(entry: str) -> tuple[int, str]:
    bucket, week = (x.split("=")[1] for x in entry.split("/"))
    return int(bucket), week


def _schema(rows: DataFrame, before: str | None = None) -> str:
    """Columns of the files as DDL; those of the versions before stay, also where a push doesn't send them."""
    fields = {f.name: f for f in StructType.fromDDL(before).fields} if before else {}
    fields = {f.name: f for f in rows.schema if f.name != "bucket"} | fields
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.values())


def week_parts(rows: DataFrame) -> DataFrame:
    """Totals of each bucket and week. A changed bucket's totals are made anew from its own rows, so maxima shrink too when rows go."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)).cast("long").alias(c) for c in SUMS]
    longest = F.max("longest_minutes") if "longest_minutes" in rows.columns else F.lit(None)
    return rows.groupBy("bucket", "week", *TOTALS).agg(*sums, F.count_distinct("device").alias("devices"), F.count("*").alias("rows"), longest.cast("long").alias("longest_minutes"))
