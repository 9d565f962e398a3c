"""Versions of a table as small manifests, each put in place by one atomic rename that fails if the version exists."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed the version."""


class Versions:
    """Manifests below path/_versions on any file system that Spark opens. Whole or absent: a reader never sees half of one.

    A manifest is written aside and renamed to the number that it claims. Stores whose rename isn't atomic need a file
    system layer that makes it so, as Structured Streaming's own logs do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.base = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        self.fs = self.base.getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.base):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.base)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def read(self, number: int) -> dict:
        at = self.jvm.org.apache.hadoop.fs.Path(self.base, f"{number:012d}.json")
        stream = self.fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and manifest of the last version; 0 and an empty one before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, manifest: dict) -> None:
        """Put version `number` in place, or raise Conflict if it is there."""
        path = self.jvm.org.apache.hadoop.fs.Path
        aside, at = path(self.base, f".{uuid.uuid4().hex}.tmp"), path(self.base, f"{number:012d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest | {"committed_ms": int(time.time() * 1000)}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, at, options)
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(at):
                raise Conflict(number) from e
            raise

    def remove(self, *relative: str) -> None:
        for r in relative:
            self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r}"), True)

    def folders(self, relative: str) -> list[tuple[str, int]]:
        """Names below a folder and when each was last changed (epoch ms)."""
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}")
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
