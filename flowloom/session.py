"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "flowloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each Spark application.

    Tasks import the modules that their functions come from, and an executor
    need not have the repository on its path.
    """
    context = spark.sparkContext
    if getattr(context, "_flowloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="flowloom-"), "flowloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    context._flowloom_shipped = True


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (local tests) one is made and set, in the
    temporary folder of the single machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_flowloom_shared", None)
        if base is None:
            if not spark.sparkContext.master.partition("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="flowloom-shared-")
            spark.sparkContext._flowloom_shared = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def keep(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it again: this cuts
    its lineage and survives the loss of any executor. The folder goes by ``forget``, or with the driver."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if not _KEPT:
        atexit.register(lambda: [_remove(s, p) for p, s in list(_KEPT.items())])
    _KEPT[path] = spark
    df.write.options(**options).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._flowloom_path = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Remove the folders of kept tables that nothing is to read any more; others stay.

    The shuffles that made them can go too: Spark's cleaner takes them as soon as the driver
    collects its garbage, which it may else not do for long."""
    for df in frames:
        path = getattr(df, "_flowloom_path", None)
        if path in _KEPT:
            _remove(_KEPT[path], path)
    gc.collect()
    if frames and frames[0].sparkSession.sparkContext._jvm is not None:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffles of finished jobs taken from the disks before a large one begins. Spark
    hears of what Python has dropped only a moment later, so ``forget`` leaves the latest one."""
    for _ in range(2):
        gc.collect()
        time.sleep(1)
        spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    _KEPT.pop(path, None)
    remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    context = spark.sparkContext
    if context._jsc is not None:  # else the session has ended
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Folders of kept tables, with the session that wrote each.
_KEPT: dict[str, SparkSession] = {}
