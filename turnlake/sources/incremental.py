"""Sources that read only what is new: lines of growing files by byte offset, hook events by event id.

Both are Python data sources for batches and streams. A stream's checkpoint holds the cursors (a map of files or devices), so a
restarted query goes on where the last committed batch ended. Register them with `register(spark)`; paths may be anything that
pyarrow's filesystems open, on the driver and on executors alike.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINES = "device string, file string, line bigint, value string"
EVENTS = "device string, event_id bigint, source_ref string, session_id string, ts bigint, tool string, args_json string"
BLOCK, TAIL = 8 << 20, 1 << 16  # bytes read at once: of a range, and backwards from a file's end
LISTERS = 16  # files looked at side by side on the driver


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def listed(path: str, pattern: str) -> list[pafs.FileInfo]:
    """Files below a folder whose name matches, in the order of their paths."""
    fs, base = opened(path)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(base) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not hidden(f.path)), key=lambda f: f.path)


def device_of(path: str) -> str:
    part = re.search("device=([^/]+)/", path)
    return part[1] if part else "unknown"


# --- growing lines ---------------------------------------------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in [low, high); begin and end are where the whole range begins and ends, both between lines."""

    file: str
    begin: int
    low: int
    high: int
    end: int


def last_line_end(fs: pafs.FileSystem, file: str, size: int) -> int:
    """The offset behind the last line break: what follows is half a line and is held back."""
    with fs.open_input_file(file) as f:
        high = size
        while high > 0:
            low = max(0, high - TAIL)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return 0


def whole_lines(f: pa.NativeFile, s: Stretch) -> Iterator[tuple[int, bytes]]:
    """Offsets and bytes of the stretch, in blocks of whole lines."""
    at = s.low
    if s.low > s.begin:  # the line that the byte in front of `low` belongs to is another stretch's
        at = s.low - 1
        f.seek(at)
        while chunk := f.read(min(TAIL, s.end - at)):
            cut = chunk.find(b"\n")
            at += cut + 1 if cut >= 0 else len(chunk)
            if cut >= 0:
                break
    f.seek(at)
    rest = b""
    while at < s.high:
        chunk = f.read(min(BLOCK, s.end - at - len(rest)))
        if not chunk:
            return  # the file has shrunk meanwhile
        data = rest + chunk
        cut = data.rfind(b"\n") + 1
        if cut and at + cut > s.high:
            yield at, data[: data.find(b"\n", s.high - 1 - at) + 1]
            return
        if cut:
            yield at, data[:cut]
        at, rest = at + cut, data[cut:]


def as_text(lines: list[bytes]) -> pa.Array:
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


class Lines:
    """What batch and stream readers of growing lines share."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("glob", "*")
        self.start, self.shrunk = options.get("start", "begin"), options.get("shrunk", "begin")
        if {self.start, self.shrunk} - {"begin", "end"}:
            raise ValueError("start and shrunk are begin or end")
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.known: dict[str, tuple[tuple[int, int], int, int]] = {}  # file: size and time, end of its lines, where it is begun

    def ends(self) -> dict[str, dict[str, int]]:
        """For each file where its whole lines end, and where a reader that doesn't know the file begins."""
        fs, _ = opened(self.path)
        files = listed(self.path, self.pattern)
        seen = {f.path: (f.size, f.mtime_ns or 0) for f in files}
        fresh = [p for p, mark in seen.items() if p not in self.known or self.known[p][0] != mark]
        with ThreadPoolExecutor(LISTERS) as pool:
            for p, end in zip(fresh, pool.map(lambda p: last_line_end(fs, p, seen[p][0]), fresh), strict=True):
                self.known[p] = (seen[p], end, self.known[p][2] if p in self.known else (end if self.start == "end" else 0))
        return {p: {"begin": self.known[p][2], "to": self.known[p][1]} for p in seen}

    def stretches(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for file, mark in end.items():
            low = start[file]["to"] if file in start else mark["begin"]
            if mark["to"] < low:  # the file was cut off or begun anew
                low = 0 if self.shrunk == "begin" else mark["to"]
            out += [Stretch(file, low, at, min(at + self.split_bytes, mark["to"]), mark["to"]) for at in range(low, mark["to"], self.split_bytes)]
        return out

    def batches(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        device = device_of(s.file)
        with fs.open_input_file(s.file) as f:
            for at, data in whole_lines(f, s):
                lines = data[:-1].split(b"\n")
                size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
                offsets = at + np.cumsum(size) - size
                n = len(lines)
                values = as_text([x.removesuffix(b"\r") for x in lines])
                yield pa.RecordBatch.from_arrays([pa.array([device] * n), pa.array([s.file] * n), pa.array(offsets), values], ["device", "file", "line", "value"])


class LinesReader(Lines, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.stretches({}, {f: m | {"begin": 0} for f, m in self.ends().items()})

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        return self.batches(partition) if partition else iter(())  # without partitions Spark reads one of None


class LinesStream(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.stretches(start, end)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class GrowingLines(DataSource):
    """Lines of files that grow: device (from a path part), file, line (the byte offset where it begins) and value.

    Options: path, glob, split_bytes; start (begin, or end: what a file holds when it is first seen is passed over); shrunk
    (begin: a file shorter than its cursor is read anew; end: it goes on from its end). The last line is held back until its line
    break is there. A batch reads all whole lines. A file is split into stretches, so one large file is read by many tasks, and
    `line` keeps its order.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> LinesStream:  # noqa: N802
        return LinesStream(self.options)


# --- hook events ------------------------------------------------------------------------------------------------------


@dataclass
class IdRange(InputPartition):
    """Row groups of a file, and the ids (above low, up to high) wanted of them."""

    file: str
    groups: list[int]
    low: int
    high: int


class Events:
    """What batch and stream readers of hook events share."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("groups", 8))
        after = json.loads(options.get("after", "{}"))
        self.after = after if isinstance(after, dict) else {"*": int(after)}
        self.footers: dict[str, list[tuple[int, int]]] = {}  # least and greatest id of each row group

    def footer(self, fs: pafs.FileSystem, file: str) -> list[tuple[int, int]]:
        with fs.open_input_file(file) as f:
            meta = pq.read_metadata(f)
            at = meta.schema.to_arrow_schema().names.index("event_id")
            stats = [meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups)]
            if all(s is not None and s.has_min_max for s in stats):
                return [(s.min, s.max) for s in stats]
            ids = [pq.ParquetFile(f).read_row_group(k, ["event_id"]).column(0) for k in range(meta.num_row_groups)]
            return [(min(x.to_pylist()), max(x.to_pylist())) for x in ids]

    def latest(self) -> dict[str, int]:
        """The greatest id of each device, of all its rows, whether a reader keeps them or not. Only footers of new files are read."""
        fs, _ = opened(self.path)
        files = [f.path for f in listed(self.path, "*.parquet")]
        fresh = [p for p in files if p not in self.footers]
        with ThreadPoolExecutor(LISTERS) as pool:
            self.footers |= zip(fresh, pool.map(lambda p: self.footer(fs, p), fresh), strict=True)
        out: dict[str, int] = {}
        for p in files:
            for _, most in self.footers[p]:
                out[device_of(p)] = max(most, out.get(device_of(p), most))
        return out

    def ranges(self, start: dict, end: dict) -> list[IdRange]:
        out = []
        for p, groups in sorted(self.footers.items()):
            device = device_of(p)
            low, high = start.get(device, self.after.get(device, self.after.get("*", -1))), end.get(device, -1)
            wanted = [k for k, (least, most) in enumerate(groups) if most > low and least <= high]
            out += [IdRange(p, wanted[k : k + self.size], low, high) for k in range(0, len(wanted), self.size)]
        return out

    def batches(self, part: IdRange) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        columns = [c.split()[0] for c in EVENTS.split(", ")][1:]
        with fs.open_input_file(part.file) as f:
            for b in pq.ParquetFile(f).iter_batches(row_groups=part.groups, columns=columns):
                ids = b.column(b.schema.get_field_index("event_id")).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array((ids > part.low) & (ids <= part.high)))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([device_of(part.file)] * b.num_rows), *[b.column(b.schema.get_field_index(c)) for c in columns]], ["device", *columns])


class EventsReader(Events, DataSourceReader):
    def partitions(self) -> list[IdRange]:
        return self.ranges({}, self.latest())

    def read(self, partition: IdRange | None) -> Iterator[pa.RecordBatch]:
        return self.batches(partition) if partition else iter(())


class EventsStream(Events, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {d: n for d, n in self.after.items() if d != "*"}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        if not self.footers:
            self.latest()
        return self.ranges(start, end)

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class HookEvents(DataSource):
    """Rows of a landed hook table (Parquet below device=... folders) with an event id above the cursor of their device.

    Options: path; after, the first cursors (a number, or JSON of numbers by device); groups, row groups a task reads. Row
    groups without a new id aren't read. The cursor follows the greatest id, also of rows that readers drop; rows that
    land later with an id at or below it are never read. Ids mustn't be null.
    """

    @classmethod
    def name(cls) -> str:
        return "hook_events"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> EventsReader:
        return EventsReader(self.options)

    def streamReader(self, schema) -> EventsStream:  # noqa: N802
        return EventsStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (GrowingLines, HookEvents):
        spark.dataSource.register(source)


def growing_lines(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    """Lines of growing files, of all that is there or as a stream (OP-87, OP-88)."""
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("growing_lines").options(path=path, **options).load()


def hook_table(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    """Rows of the hook table behind the cursors, or a stream of them (OP-05, OP-88)."""
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("hook_events").options(path=path, **options).load()
