"""A data source of line-delimited logs in one folder, for batches and streams.

A line is ``<time> <level> user=<number> id=<number> value=<number> <text>``, with the time as in ISO 8601. Files are named
in order of their time as ``<yyyy-mm-dd>[-<anything>].log``, hold lines of that day, and only the last one grows.
Any file system that Arrow knows will do; nothing is opened by the driver but the folder's list.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "day string, ts timestamp_ntz, level string, user_id long, event_id long, value double, message string"
_ARROW = pa.schema([("day", pa.string()), ("ts", pa.timestamp("us")), ("level", pa.string()), ("user_id", pa.int64()), ("event_id", pa.int64()), ("value", pa.float64()), ("message", pa.string())])
_LINE = re.compile(r"(\S+) (\S+) user=(-?\d+) id=(-?\d+) value=(\S+) ?(.*)")
#: Bytes of a file that one task reads, and rows that it hands over at a time.
SPLIT = 32 << 20
ROWS = 10_000


class Piece(InputPartition):
    """The lines of a file that begin from ``start`` up to ``end``."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _files(folder: str) -> list[tuple[str, int]]:
    """Names and sizes, in order."""
    fs, base = pafs.FileSystem.from_uri(folder)
    return sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.base_name.endswith(".log"))


def _pieces(folder: str, name: str, start: int, end: int, split: int) -> list[Piece]:
    return [Piece(f"{folder}/{name}", lo, min(end, lo + split)) for lo in range(start, end, split)]


def _rows(piece: Piece, level: str | None) -> Iterator[pa.RecordBatch]:
    """The rows of a piece, of one level if it is given. A line belongs to the piece in which it begins; a line that is none is an error."""
    fs, path = pafs.FileSystem.from_uri(piece.path)
    day = path.rpartition("/")[2][:10]
    out: list[tuple] = []
    with io.BufferedReader(fs.open_input_file(path), 1 << 20) as f:
        f.seek(max(0, piece.start - 1))
        at = piece.start
        if piece.start:
            at = piece.start - 1 + len(f.readline())  # the rest of a line that began before, or its end mark alone
        while at < piece.end and (line := f.readline()):
            at += len(line)
            m = _LINE.fullmatch(line.decode().rstrip("\n"))
            if m is None:
                raise ValueError(f"{piece.path}: no log line: {line[:80]!r}")
            if level is None or m[2] == level:
                out.append((day, datetime.fromisoformat(m[1]), m[2], int(m[3]), int(m[4]), float(m[5]), m[6]))
            if len(out) >= ROWS:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _BatchReader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split, self.level = folder, split, None
        self.days: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``day`` leave files out, an equality of ``level`` lines; both hold exactly. Other filters stay with Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("day",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                self.days.append(f)
            elif name == ("level",) and isinstance(f, EqualTo) and self.level is None:
                self.level = f.value
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        tests = {EqualTo: str.__eq__, LessThan: str.__lt__, LessThanOrEqual: str.__le__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__}
        return all(tests[type(f)](name[:10], f.value) for f in self.days)

    def partitions(self) -> list[Piece]:
        return [p for name, size in _files(self.folder) if self._wanted(name) for p in _pieces(self.folder, name, 0, size, self.split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.path is not None:
            yield from _rows(partition, self.level)


class _StreamReader(DataSourceStreamReader):
    """An offset is the last file read from and how many of its bytes: all files before it are done."""

    def __init__(self, folder: str, split: int, files_per_batch: int) -> None:
        self.folder, self.split, self.files_per_batch = folder, split, files_per_batch
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def latestOffset(self) -> dict:
        """The end of what is there, or of the next ``files_per_batch`` files."""
        files = _files(self.folder)
        at = self.at or self.initialOffset()
        left = [f for f in files if f[0] > at["file"] or (f[0] == at["file"] and f[1] > at["bytes"])][: self.files_per_batch or None]
        if left:
            self.at = {"file": left[-1][0], "bytes": left[-1][1]}
        return self.at or at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = max((start, end, self.at or start), key=lambda o: (o["file"], o["bytes"]))
        out = []
        for name, size in _files(self.folder):
            lo = start["bytes"] if name == start["file"] else 0
            hi = end["bytes"] if name == end["file"] else size
            if start["file"] <= name <= end["file"] and lo < hi:
                out += _pieces(self.folder, name, lo, hi, self.split)
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, None)

    def commit(self, end: dict) -> None:
        self.at = max((end, self.at or end), key=lambda o: (o["file"], o["bytes"]))


class LogSource(DataSource):
    """``spark.read.format("lines_log").load(folder)``; options: path, split (bytes of a task), filesPerBatch (of a stream; all if absent)."""

    @classmethod
    def name(cls) -> str:
        return "lines_log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        folder = self.options.get("path", "").rstrip("/")
        return (folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)), int(self.options.get("split", SPLIT))

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._options(), int(self.options.get("filesperbatch", self.options.get("filesPerBatch", 0))))


def register_logs(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def write_logs(events: DataFrame, folder: str) -> None:
    """Write events (event_id, ts, user_id, event_type, value, props) as log files, one for each day and task; only Spark writes."""
    from pyspark.sql import functions as F

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat_ws(" ", stamp, "event_type", F.concat(F.lit("user="), "user_id"), F.concat(F.lit("id="), "event_id"), F.concat(F.lit("value="), "value"), "props")
    days = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", line.alias("value"))
    days.repartition("day").sortWithinPartitions("day", "ts").select("day", "value").write.partitionBy("day").text(f"{folder}.by_day")
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for f in fs.globStatus(path(f"{folder}.by_day/day=*/part-*")) or []:
        day = f.getPath().getParent().getName().removeprefix("day=")
        fs.rename(f.getPath(), path(f"{folder}/{day}-{f.getPath().getName()[:10]}.log"))
    fs.delete(path(f"{folder}.by_day"), True)
