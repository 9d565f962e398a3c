"""Labels, candidates and failures laid out by version, so that superseded versions go without a row being read (OP-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnlake.functions import taxonomy as tx

VERSIONS = {"labels": ["taxonomy_version", "prompt_version"], "candidates": ["taxonomy_version", "prompt_version"], "failures": ["prompt_version"]}


def append(rows: DataFrame, path: str, kind: str) -> None:
    """Add rows of a kind to its table below path; rows without a version get a folder of their own."""
    rows.write.mode("append").partitionBy(*VERSIONS[kind]).parquet(f"{path}/{kind}")


def read(spark: SparkSession, path: str, kind: str, schema: str, taxonomy_version: int = tx.TAXONOMY_VERSION, prompt_version: int = tx.PROMPT_VERSION) -> DataFrame:
    """Rows of one version: a filter on folders. schema names all columns; a kind that has no table yet is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    wanted = {"taxonomy_version": taxonomy_version, "prompt_version": prompt_version}
    rows = spark.read.schema(schema).parquet(f"{path}/{kind}")
    for name in VERSIONS[kind]:
        rows = rows.where(rows[name] == wanted[name])
    return rows


def purge(spark: SparkSession, path: str, taxonomy_version: int = tx.TAXONOMY_VERSION, prompt_version: int = tx.PROMPT_VERSION) -> list[str]:
    """Delete the folders of all other versions, of every kind; which these were. Only folders are listed, no file is opened.

    A purge that is cut off leaves whole folders, and the next one goes on.
    """
    wanted = {"taxonomy_version": str(taxonomy_version), "prompt_version": str(prompt_version)}
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    gone: list[str] = []

    def look(at: object, relative: str, names: list[str]) -> None:
        for s in fs.listStatus(at):
            name, mark, value = s.getPath().getName().partition("=")
            if not names or not mark or name != names[0]:
                continue
            if value == wanted[name]:
                look(s.getPath(), f"{relative}/{name}={value}", names[1:])
            else:
                fs.delete(s.getPath(), True)
                gone.append(f"{relative}/{name}={value}")

    for kind, names in VERSIONS.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(base, kind)
        if fs.exists(at):
            look(at, kind, names)
    return sorted(gone)
