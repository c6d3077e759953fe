"""Admission of flow lines from a stream: by size or time, with poison lines put aside and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.sources.files import parse_flow_lines

#: Rows that make a batch, and the time after which fewer do.
BATCH_ROWS = 100
FLUSH = "500 milliseconds"


@dataclass
class Admission:
    """Writes the lines of each micro-batch in one pass, flows and poison lines apart, and what
    was counted on the way. Folders are named by the batch and written anew if it is tried again."""

    folder: str

    def lines(self, spark: SparkSession, path: str, files: int | None = None, size: int | None = None) -> DataFrame:
        """A stream of the lines below ``path``; at most so many files, or bytes, make a batch."""
        reader = spark.readStream
        for key, value in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)):
            if value is not None:
                reader = reader.option(key, value)
        return reader.text(path)

    def take(self, lines: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        spark = lines.sparkSession
        seen = Observation(f"admission-{batch}")
        parsed = parse_flow_lines(lines, all_lines=True).withColumn("kind", F.when(F.col("malformed").isNull(), "flow").otherwise("poison"))
        counted = parsed.observe(seen, F.count("*").alias("lines"), F.count_if(F.col("kind") == "poison").alias("poison"))
        counted.write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/lines/batch={batch}")
        found = seen.get
        spark.createDataFrame([(batch, found["lines"], found["poison"])], "batch long, lines long, poison long").write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")

    def start(self, lines: DataFrame, interval: str | None = FLUSH) -> StreamingQuery:
        """Every ``interval``, or without one for what is there now."""
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return lines.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()

    def _lines(self, spark: SparkSession, kind: str) -> DataFrame:
        columns = parse_flow_lines(spark.createDataFrame([], "value string")).schema
        return spark.read.schema(columns.add("kind", "string").add("batch", "long")).parquet(f"{self.folder}/lines").where(F.col("kind") == kind)

    def flows(self, spark: SparkSession) -> DataFrame:
        return self._lines(spark, "flow").drop("malformed", "kind")

    def poison(self, spark: SparkSession) -> DataFrame:
        return self._lines(spark, "poison").select("batch", "malformed")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("lines long, poison long, batch long").parquet(f"{self.folder}/counts")
