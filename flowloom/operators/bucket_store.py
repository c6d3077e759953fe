"""A table with one row for each key, in hash buckets, that a batch changes in part.

A batch is merged into the buckets that its keys fall into; these are written anew under the
next version, all others stay as they are. A manifest, written last and put in place by a
rename, says which version each bucket has and which batch came last: a batch that is tried
again, before or after that, gives the same table. Then the replaced versions go.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.session import forget, keep


@dataclass
class BucketStore:
    """One writer at a time. ``buckets`` is fixed for a table: choose it so that one fits a task."""

    folder: str
    schema: str
    key: str = "flow_id"
    order: str = "seq"
    buckets: int = 64

    def _files(self, spark: SparkSession) -> tuple[Any, Any]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifest(self, spark: SparkSession) -> dict[str, Any]:
        """The newest manifest: number, last batch, and the version of each bucket."""
        fs, path = self._files(spark)
        folder = path(f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "batch": -1, "buckets": {}}
        return json.loads(spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{max(numbers)}.json").first()[0])

    def _commit(self, spark: SparkSession, manifest: dict[str, Any]) -> None:
        fs, path = self._files(spark)
        made, place = (path(f"{self.folder}/manifests/{manifest['number']}.{end}") for end in ("new", "json"))
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(made, place):
            raise OSError(f"another writer made version {manifest['number']} of {self.folder}")

    def _place(self, bucket: str, version: int) -> str:
        return f"{self.folder}/data/version={version}/bucket={bucket}"

    def _read(self, spark: SparkSession, places: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*places) if places else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, [self._place(b, v) for b, v in self._manifest(spark)["buckets"].items()])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def has(self, spark: SparkSession, batch: int) -> bool:
        """Whether a batch, or a later one, was merged."""
        return batch <= self._manifest(spark)["batch"]

    def merge(self, rows: DataFrame, batch: int, replace: bool = True, kept: bool = False) -> list[int]:
        """Takes a batch's rows in; the buckets that were rewritten. Of equal keys the last by
        ``order`` stays if ``replace``, else what is there, or the batch's first. ``kept`` says that
        the rows come from a kept table, and need not be written before they are read twice."""
        spark = rows.sparkSession
        now = self._manifest(spark)
        if batch <= now["batch"]:
            return []
        new = rows.where(F.col(self.key).isNotNull()).withColumns({"__bucket": self.bucket(), "__new": F.lit(1)})
        new = new if kept else keep(new, "batch")
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())
        old = self._read(spark, [self._place(str(b), now["buckets"][str(b)]) for b in touched if str(b) in now["buckets"]])
        both = old.withColumns({"__bucket": self.bucket(), "__new": F.lit(0)}).unionByName(new)
        order = F.struct("__new", self.order)
        chosen = F.max_by(F.struct("*"), order) if replace else F.min_by(F.struct("*"), order)
        one = both.repartition("__bucket").groupBy("__bucket", F.col(self.key).alias("__key")).agg(chosen.alias("__row"))
        number = now["number"] + 1
        columns = [f for f in old.columns]
        one.select("__row.*", F.col("__bucket").alias("bucket")).select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={number}")
        if not kept:
            forget(new)
        self._commit(spark, {"number": number, "batch": batch, "buckets": now["buckets"] | {str(b): number for b in touched}})
        self.vacuum(spark)
        return touched

    def vacuum(self, spark: SparkSession) -> None:
        """Removes what no manifest entry names: replaced buckets, and what a failed batch left."""
        fs, path = self._files(spark)
        now = self._manifest(spark)
        used = {self._place(b, v) for b, v in now["buckets"].items()}
        for version in fs.listStatus(path(f"{self.folder}/data")):
            buckets = [f.getPath() for f in fs.listStatus(version.getPath()) if f.isDirectory()]
            gone = [p for p in buckets if self._place(p.getName().removeprefix("bucket="), int(version.getPath().getName().removeprefix("version="))) not in used]
            for p in [version.getPath()] if len(gone) == len(buckets) else gone:
                fs.delete(p, True)
        for f in fs.listStatus(path(f"{self.folder}/manifests")):
            if f.getPath().getName() != f"{now['number']}.json":
                fs.delete(f.getPath(), True)
