"""Capture files as a data source, for batches and streams, read by byte ranges.

A range begins somewhere in a file. Its first record is the first place in it from which a
chain of records follows: each head has sizes within the file's limit and a fraction below a
second, and times that do not leap, up to ``CHAIN`` heads or the end of the file. It is looked for
two records' length before the range and followed up to it, so that what looks like a record
inside a packet is left behind. A range takes the records whose heads begin in it, reading on into
the next for the last one. Packets are yielded as they are read; no task holds a file.

Files are listed and opened by Arrow's file systems (local, HDFS, S3), as the source runs in
Python. Files of another kind give no packets, a record that is cut off at the end is left out.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowloom.sources.files import MAGIC

SCHEMA = "file string, offset long, ts_us long, wire_len long, caplen int, bytes binary"
#: Heads that must follow each other, the time in seconds that they may leap, and the most a record holds.
CHAIN, LEAP, MOST = 8, 86_400, 1 << 18
#: Bytes of a range, of a read, and packets handed on together.
RANGE, READ, ROWS = 32 << 20, 4 << 20, 4096


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, by name."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    base = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((base + f.path, f.size) for f in found if f.type == pafs.FileType.File)


class Records:
    """The records of a file whose heads begin in a range."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size = file, size
        self.data, self.at = b"", 0
        head = self.take(0, 24)
        order, self.ticks = MAGIC.get(head[:4], ("<", 0))
        self.head = struct.Struct(order + "IIII")
        self.most = min(struct.unpack(order + "I", head[16:20])[0] or MOST, MOST) if len(head) == 24 and self.ticks else 0

    def take(self, at: int, n: int) -> bytes:
        """``n`` bytes from a place on, fewer at the end; reads come in large pieces."""
        if not self.at <= at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.data, self.at = self.file.read(max(READ, n)), at
        return self.data[at - self.at : at - self.at + n]

    def plausible(self, at: int) -> bool:
        """Whether a chain of records begins here."""
        before = None
        for _ in range(CHAIN):
            if at == self.size:
                return True
            head = self.take(at, 16)
            if len(head) < 16:
                return before is not None
            seconds, fraction, kept, wire = self.head.unpack(head)
            if fraction >= self.ticks or kept > self.most or kept > wire or wire > MOST or (before is not None and abs(seconds - before) > LEAP):
                return False
            before, at = seconds, at + 16 + kept
        return True

    def between(self, begin: int, end: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(offset, microseconds, wire length, bytes) of each record with its head from ``begin`` to ``end``."""
        if not self.most:
            return
        at = max(begin - 2 * (self.most + 16), 24)
        if at > 24:
            while at < end and not self.plausible(at):
                at += 1
        while at < begin and at + 16 <= self.size:
            at += 16 + self.head.unpack(self.take(at, 16))[2]
        while at < end and at + 16 <= self.size:
            seconds, fraction, kept, wire = self.head.unpack(self.take(at, 16))
            data = self.take(at + 16, kept)
            if len(data) < kept:
                return
            yield at, seconds * 1_000_000 + fraction * 1_000_000 // self.ticks, wire, data
            at += 16 + kept


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    fs, inner = pafs.FileSystem.from_uri(part.path) if "://" in part.path else (pafs.LocalFileSystem(), part.path)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("ts_us", pa.int64()), ("wire_len", pa.int64()), ("caplen", pa.int32()), ("bytes", pa.binary())])
    with fs.open_input_file(inner) as file:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for offset, ts, wire, data in Records(file, file.size()).between(part.begin, part.end):
            rows.append((part.path, offset, ts, wire, len(data), data))
            if len(rows) >= ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


def _ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(path, a, min(a + size, total)) for path, total in files for a in range(0, total, size)]


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return _ranges(_listed(self.path), self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.path else iter(())


class CaptureStreamReader(DataSourceStreamReader):
    """Files are taken in the order of their names; the offset is the last one that was taken."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([f for f in _listed(self.path) if start["last"] < f[0] <= end["last"]], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(path)``, or ``readStream``; option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rangeBytes", RANGE))

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(*self._args())

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(*self._args())


def register(spark: SparkSession) -> None:
    """Make the format known; its code goes with it, as planning runs in a process of its own."""
    for name in (__name__, "flowloom.sources.files"):
        cloudpickle.register_pickle_by_value(sys.modules[name])
    spark.dataSource.register(CaptureSource)
