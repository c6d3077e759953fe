"""File sources: packet captures, JSON lines, configuration, log tails."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowloom.functions.labels import CLASSES
from flowloom.session import ship_package

#: Byte order and ticks of a second by a capture file's first four bytes.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}


def capture_records(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, wire length, bytes) of each packet; a cut-off end is left out."""
    order, ticks = MAGIC[content[:4]]
    head = struct.Struct(order + "IIII")
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, kept, wire = head.unpack_from(content, at)
        if at + 16 + kept > len(content):
            return
        yield seconds * 1_000_000 + fraction * 1_000_000 // ticks, wire, content[at + 16 : at + 16 + kept]
        at += 16 + kept


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Frames of capture files: file, number, ts_us, wire_len, caplen, bytes. A task takes
    whole files, whose size the capturing side bounds; files of another kind are left out."""
    ship_package(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                if content[:4] in MAGIC:
                    rows = [(name, i, ts, wire, len(data), data) for i, (ts, wire, data) in enumerate(capture_records(content))]
                    for i in range(0, len(rows), 50_000):
                        yield pd.DataFrame(rows[i : i + 50_000], columns=["file", "number", "ts_us", "wire_len", "caplen", "bytes"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, number long, ts_us long, wire_len long, caplen int, bytes binary")


def packet_filter(protocol: int | None = None, host: str | None = None, port: int | None = None) -> Column:
    """A capture filter on decoded packets: of a protocol, and from or to a host and port."""
    from flowloom.sources.packets import ip_text

    found = F.lit(True)
    if protocol is not None:
        found = found & (F.col("protocol") == protocol)
    if host is not None:
        found = found & ((ip_text("src_ip") == host) | (ip_text("dst_ip") == host))
    if port is not None:
        found = found & ((F.col("src_port") == port) | (F.col("dst_port") == port))
    return found


FLOW_LINE = "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, start_time_us long, end_time_us long, features map<string,string>, interface string, net_interface string, __bad string"


def parse_flow_lines(lines: DataFrame, line: str = "value", keep: list[str] | None = None, all_lines: bool = False) -> DataFrame:
    """Flows from JSON lines, batch or stream, with the columns ``keep`` of ``lines``.

    A malformed line has only its text, in ``malformed``. Lines that do not begin with a brace
    are other output and go, or if ``all_lines`` are malformed too; so is a null line then.
    """
    flow = F.from_json(line, FLOW_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    begins = F.coalesce(F.ltrim(line).startswith("{"), F.lit(False))
    rows = (lines if all_lines else lines.where(begins)).select(*(keep or []), flow.alias("f"), F.when(~begins, F.coalesce(line, F.lit(""))).alias("__other"))
    interface = F.coalesce(F.nullif("f.interface", F.lit("")), F.nullif("f.net_interface", F.lit("")))
    names = [x.split()[0] for x in FLOW_LINE.split(", ")][:9]
    return rows.select(*(keep or []), *[F.col(f"f.{n}").alias(n) for n in names], interface.alias("interface"), F.coalesce("__other", "f.__bad").alias("malformed"))


def tail(lines: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """The last ``n`` lines that are not blank, of all or of each file."""
    some = lines.where(F.trim("value") != "")
    if not by:
        return some.orderBy(*[F.desc(c) for c in order]).limit(n)
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return some.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def read_classes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Class names by number from a JSON label map; the standard ones if there is none."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json(F.get_json_object("value", "$.id_to_label"), "map<string,string>").alias("m")).limit(1).collect()
    if not rows or not rows[0]["m"]:
        return CLASSES
    return tuple(name for _, name in sorted(rows[0]["m"].items(), key=lambda x: int(x[0])))


def read_by_name(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of different columns in one scan, by name, with ``file``, the folder each row
    is from; a column that a file lacks is null there. Spark merges the schemas."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Files of one kind together; a column that some lack is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
