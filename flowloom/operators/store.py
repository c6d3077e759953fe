"""The serving store: queue states, idempotent writes, the alert view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEASE_S = 60.0


def reclaim_stale(queue: DataFrame, now: Column, lease_s: float = LEASE_S) -> DataFrame:
    """Claims older than the lease are pending again."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - lease_s)
    stale = F.coalesce(stale, F.lit(False))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at"))})


def claim(queue: DataFrame, now: Column, limit: int = 500, lease_s: float = LEASE_S) -> DataFrame:
    """The next pending rows by id, stale claims included, as claimed now."""
    pending = reclaim_stale(queue, now, lease_s).where("status = 'pending'").orderBy("id").limit(limit)
    return pending.withColumns({"status": F.lit("processing"), "claimed_at": now})


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue after the rows with the ids in ``done`` were stored."""
    ids = done.select("id").distinct().withColumn("__done", F.lit(True))
    return queue.join(ids, "id", "left").withColumn("status", F.when(F.col("__done"), "processed").otherwise(F.col("status"))).drop("__done")


def first_wins(rows: DataFrame, key: str = "flow_id", order: str = "seq") -> DataFrame:
    """Of rows with an equal key the first: a pre-aggregated grouping, no sort of the key's rows."""
    return _one(rows, key, F.min_by(F.struct("*"), F.col(order)))


def last_wins(rows: DataFrame, key: str = "flow_id", order: str = "seq") -> DataFrame:
    return _one(rows, key, F.max_by(F.struct("*"), F.col(order)))


def _one(rows: DataFrame, key: str, chosen: Column) -> DataFrame:
    return rows.groupBy(F.col(key).alias("__key")).agg(chosen.alias("__row")).select("__row.*")


def insert_new(target: DataFrame, batch: DataFrame, key: str = "flow_id", order: str = "seq") -> DataFrame:
    """Rows of a batch that an insert which ignores known keys would add to ``target``."""
    return first_wins(batch, key, order).join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: str = "flow_id", order: str = "seq") -> DataFrame:
    """``target`` after the batch's rows replaced those of equal key."""
    new = last_wins(batch, key, order)
    return target.join(new.select(key), key, "left_anti").unionByName(new)


def security_alerts(flows: DataFrame, detections: DataFrame) -> DataFrame:
    """Malicious detections with their flows."""
    bad = detections.where("is_malicious = 1").select("flow_id", "attack_type", "confidence", "severity", F.col("inserted_at").alias("detected_at"))
    return flows.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "interface", "flow_pkts_s").join(bad, "flow_id")
