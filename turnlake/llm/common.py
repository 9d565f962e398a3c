"""What the operators share: tables in the shared folder, the fixed train/held-out split, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, local mode (tests) takes a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="turnlake-"))
    return f"file://{_own_dir[0]}"


class Scratch:
    """Intermediate tables of one job, written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/turnlake-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of ids that no model may learn from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def bounded_sample(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most about 1.25 * per_class rows of each non-null label value, one for each key drawn by its hash.

    One aggregate estimates the distinct keys of each class (sketches of fixed size, merged on the map side); a hash threshold
    per class then thins the keys, so that no class is gathered anywhere. Of rows that share label and key the least one
    stays. Neither the size nor the number of keys drawn follows how often a key is repeated, and a class of few
    keys keeps all of them. A null key counts as one key.
    """
    h = F.xxhash64(F.lit("sample"), F.col(key))
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(h, 0.02)).collect()}
    if not counts:
        return df.where(F.lit(False))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * per_class / max(n, 1)))])
    draw = F.pmod(h, F.lit(1_000_003)) / 1_000_003.0
    picked = df.where(F.col(label).isNotNull() & (draw < F.try_element_at(share, F.col(label))))
    others = [c for c in df.columns if c not in (label, key)]
    if not others:
        return picked.distinct()
    least = free_name(df, "least")
    return picked.groupBy(label, key).agg(F.min(F.struct(*others)).alias(least)).select(label, key, f"{least}.*").select(df.columns)
