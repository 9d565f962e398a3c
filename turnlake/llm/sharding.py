"""Sharding by histogram sort: shards of nearly equal bytes, cut from one global order.

Documents are ordered by a hash of their text, then of their id, then by their row, so equal texts stand together. Splitters
are found without a sort of the table: each round counts, in every partition, the exact bytes and rows below candidate keys, and
puts new candidates between the two that enclose a wanted position, until a splitter's place is exact (boundaries of shards) or
near enough (boundaries of the parts that a shard is sorted in). Then one exchange brings every row to its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch, free_name

SHARDS = 40
ROW_BYTES = 16  # counted for each document beside its text
TOLERANCE = 0.01  # of a shard: a group of equal texts up to this size isn't cut
PART_BYTES = 32 << 20  # sorted in one task, on average
LEAST_PARTS, MOST_PARTS = 4, 512  # parts of a shard
PROBES = 64  # candidates between two keys in a round
BYTES = 20  # of a key: 8 of the text's hash, 4 of the id's, 8 of the row
SPACE = 1 << (8 * BYTES)


def key_bytes(k: int) -> bytes:
    return k.to_bytes(BYTES, "big")


def keyed(docs: DataFrame, text: str, doc_id: str, group: str, size: str) -> DataFrame:
    """docs with `size` and `group`, the first twelve bytes of the key: hashes of text and id."""
    hashed = lambda c, n: F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, 2 * n)
    bytes_ = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES
    return docs.withColumns({group: F.unhex(F.concat(hashed(text, 8), hashed(doc_id, 4))), size: bytes_})


def numbered(table: DataFrame, group: str, key: str) -> DataFrame:
    """A written table with `key`: the hashes and the row's place, file and row number, which no other row has."""
    file = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    place = F.lpad(F.hex(F.shiftleft(file, 40) + F.col("_metadata.row_index")), 16, "0")
    return table.withColumn(key, F.concat(F.col(group), F.unhex(place))).drop(group)


def counted(keys: DataFrame, probes: np.ndarray) -> dict[int, tuple[int, int, bytes, bytes]]:
    """Bytes, rows, least and greatest key of the rows between each two neighbouring probes; bucket k lies below probe k.

    Each partition counts for itself; one row for each bucket that has rows comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = as_keys(b.column(0))
            order = np.argsort(key, kind="stable")
            key, size = key[order], b.column(1).to_numpy()[order]
            cut = np.searchsorted(key, probes)  # rows below each probe
            first, last = np.append(0, cut), np.append(cut, len(key))
            full = np.flatnonzero(last > first)
            total = np.append(0, np.cumsum(size))
            low, high = first[full], last[full]
            ends = [pa.array([key[i].ljust(BYTES, b"\0") for i in x], pa.binary()) for x in (low, high - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[high] - total[low], pa.int64()), pa.array(high - low, pa.int64()), *ends], ["k", "bytes", "rows", "least", "most"])

    found = keys.mapInArrow(run, "k bigint, bytes bigint, rows bigint, least binary, most binary")
    sums = found.groupBy("k").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r.k: (r.bytes, r.rows, bytes(r.least), bytes(r.most)) for r in sums.collect()}


def as_keys(column: pa.Array) -> np.ndarray:
    """Keys of equal length as fixed-width byte strings, which compare like their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), f"S{BYTES}")


@dataclass
class Splitters:
    """Keys where all parts but the first begin, ascending; each part's shard and the rows of its shard in front of it."""

    keys: np.ndarray
    shard: np.ndarray
    before: np.ndarray


@dataclass
class Search:
    """A wanted position in bytes, and the keys that enclose its splitter with the bytes and rows below each."""

    goal: int
    slack: int
    low: tuple[int, int, int]
    high: tuple[int, int, int]
    found: tuple[int, int, int] | None = None


def find_splitters(keys: DataFrame, total: tuple[int, int], goals: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each (position, slack) in ascending order: a key, and the bytes and rows below it.

    With a slack of 0 it is exact: the first row with `position` or more bytes in front of it is the first one not below the key.
    Otherwise the bytes below differ from the position by at most the slack, if keys allow it.
    """
    open_ = [Search(g, s, (0, 0, 0), (SPACE - 1, *total)) for g, s in goals]
    edges = {(0, SPACE - 1): (0, SPACE - 1)}
    while True:
        todo = [s for s in open_ if s.found is None]
        for s in todo:
            near = min((s.low, s.high), key=lambda x: abs(x[1] - s.goal))
            if s.high[2] - s.low[2] <= 1:
                s.found = s.high if s.goal > s.low[1] else s.low
            elif s.slack and abs(near[1] - s.goal) <= s.slack:
                s.found = near
        spans = sorted({(s.low[0], s.high[0]) for s in open_ if s.found is None})
        if not spans:
            return [s.found for s in open_]
        probes = sorted({p for lo, hi in spans for p in between(*edges.get((lo, hi), (lo, hi)), lo, hi)} - {0, SPACE - 1})
        found = counted(keys, np.array([key_bytes(p) for p in probes], f"S{BYTES}"))
        marks, b, n = [(0, 0, 0)], 0, 0
        for k, p in enumerate([*probes, SPACE - 1]):
            got = found.get(k, (0, 0, b"", b""))
            b, n = b + got[0], n + got[1]
            marks.append((p, b, n))
            if got[1]:
                edges[marks[-2][0], p] = (int.from_bytes(got[2], "big"), int.from_bytes(got[3], "big"))
        at = np.array([m[1] for m in marks])
        for s in open_:
            if s.found is None:
                k = max(1, int(np.searchsorted(at, s.goal, "left")))
                s.low, s.high = marks[k - 1], marks[k]


def between(least: int, most: int, low: int, high: int) -> list[int]:
    """PROBES keys spread over [least, most], the least and greatest key of the rows in the span, and the span's ends, which keep it closed."""
    step = max(1, (most - least) // (PROBES - 1))
    return [low, *(p for p in (*range(least, most + 1, step), most, most + 1) if low < p < high), high]


def split(keys: DataFrame, shards: int, tolerance: float, part_bytes: int) -> Splitters:
    """The parts: shards by exact bytes, moved behind a group of equal texts that is within the tolerance, and parts within shards."""
    row = keys.agg(F.sum("size"), F.count("*")).first()
    total, rows = row[0] or 0, row[1]
    if not rows:
        return Splitters(np.zeros(0, f"S{BYTES}"), np.zeros(1, np.int64), np.zeros(1, np.int64))
    exact = find_splitters(keys, (total, rows), [(-(-i * total // shards), 0) for i in range(1, shards)])
    moved = whole_groups(keys, exact, (total, rows), int(total / shards * tolerance))
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, -(-total // shards // part_bytes))))
    ends = [(0, 0, 0), *moved, (SPACE - 1, total, rows)]
    goals = [(lo[1] + (hi[1] - lo[1]) * j // parts, max(1, (hi[1] - lo[1]) // parts // 4)) for lo, hi in zip(ends, ends[1:], strict=False) for j in range(1, parts)]
    inner = iter(find_splitters(keys, (total, rows), goals))
    out, shard, before = [], [], []
    for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        own = sorted({lo, *(x for x in [next(inner) for _ in range(parts - 1)] if lo[0] < x[0] < hi[0])})
        if hi[0] > lo[0]:
            out += [key_bytes(k) for k, _, _ in own]
            shard += [i] * len(own)
            before += [n - lo[2] for _, _, n in own]
    return Splitters(np.array(out[1:], f"S{BYTES}"), np.array(shard), np.array(before))


def whole_groups(keys: DataFrame, exact: list[tuple[int, int, int]], total: tuple[int, int], slack: int) -> list[tuple[int, int, int]]:
    """Splitters behind the group of equal texts that they would cut, where the whole group has at most `slack` bytes."""
    unit = 1 << (8 * (BYTES - 8))
    # the row in front of a splitter, at most, shares its group with the row behind: look at the groups of both keys
    starts = sorted({p for k, _, _ in exact for g in ((k - 1) // unit, k // unit) for p in (g * unit, (g + 1) * unit) if 0 < p < SPACE - 1})
    found = counted(keys, np.array([key_bytes(p) for p in sorted({*starts, *(k for k, _, _ in exact)})], f"S{BYTES}"))
    marks, b, n = {0: (0, 0, 0)}, 0, 0
    for k, p in enumerate([*sorted({*starts, *(k for k, _, _ in exact)}), SPACE - 1]):
        got = found.get(k, (0, 0))
        b, n = b + got[0], n + got[1]
        marks[p] = (p, b, n)
    out = []
    for k, b, n in exact:
        group = (k - 1) // unit  # of rows in front of the splitter that rows behind it may belong to
        lo, hi = marks[group * unit], marks.get((group + 1) * unit, (SPACE - 1, *total))
        cuts = lo[2] < n < hi[2]
        out.append(hi if cuts and hi[1] - lo[1] <= slack else (k, b, n))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and ROW_BYTES), shard (0 .. shards - 1) and slot (gapless from 0 in each shard).

    Shard i begins with the first row that has i / shards of all bytes in front of it. Where that would cut a group of equal
    texts of at most `tolerance` of a shard, the group stays in the shard that it begins in; a larger one is cut, so no
    text, however often it occurs, outgrows a shard. Null and empty texts count ROW_BYTES and equal one another; null ids, ties
    and repeated rows are told apart by the row's place in the table that is written once to the shared folder; a text longer
    than a shard leaves others empty. An empty table gives an empty one; columns named size, shard and slot, in any case, are
    replaced, all others stay.
    """
    made = ("size", "shard", "slot")
    kept = [c for c in docs.columns if c.lower() not in made]
    group, key, place = (free_name(docs, n) for n in ("group_key", "row_key", "place"))
    source = keyed(docs, text, doc_id, group, "size_" + group).select(*kept, F.col("size_" + group).alias("size"), group)
    table = numbered(Scratch(docs.sparkSession, "sharding").table(source, "rows"), group, key)
    s = split(table.select(F.col(key).alias("key"), "size"), shards, tolerance, part_bytes)

    @F.pandas_udf("part int, shard int, before long")
    def part_of(column: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(s.keys, as_keys(pa.array(column, pa.binary())), "right")
        return pd.DataFrame({"part": part.astype(np.int32), "shard": s.shard[part].astype(np.int32), "before": s.before[part].astype(np.int64)})

    placed = table.withColumn(place, part_of(F.col(key)))
    part = F.col(place)["part"]
    dealt = placed.repartitionById(len(s.shard), part)  # a partition for each part: the one exchange
    within = F.row_number().over(Window.partitionBy(part).orderBy(key)).cast("long") - 1
    return dealt.withColumn("slot", F.col(place)["before"] + within).select(*kept, "size", F.col(place)["shard"].alias("shard"), "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return done.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
