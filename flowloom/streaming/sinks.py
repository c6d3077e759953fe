"""Sinks: JSON lines and Parquet, for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def stream_json_lines(rows: DataFrame, path: str, checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
    """Append a stream's rows as JSON lines, in batches of the given interval."""
    out = rows.select(F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(processingTime=interval).start(path)


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Snappy Parquet, with a folder for each value of ``by``: later reads prune by them."""
    writer = rows.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
