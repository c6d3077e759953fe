"""Dashboard queries over flows and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Seconds of the named time ranges; other names do not filter.
RANGES = {"15m": 900, "1h": 3_600, "24h": 86_400, "7d": 604_800}


def conditions(params: dict[str, str], now: Column) -> Column:
    """What a row of flows joined with detections must fulfil."""
    found: list[Column] = []
    if (span := RANGES.get(params.get("time_range", ""))) is not None:
        found.append(F.col("created_at") >= now - span)
    for side in ("src_ip", "dst_ip"):
        if params.get(side):
            found.append(F.col(side).ilike(f"%{params[side]}%"))
    if params.get("category") == "threats":
        found.append(F.col("is_malicious") == 1)
    elif params.get("category") == "benign":
        found.append(F.col("is_malicious").isNull() | (F.col("is_malicious") == 0))
    if params.get("interface", "all") not in ("", "all"):
        found.append(F.col("interface") == params["interface"])
    return reduce(lambda a, b: a & b, found, F.lit(True))


def joined(flows: DataFrame, detections: DataFrame, params: dict[str, str], now: Column) -> DataFrame:
    return flows.join(detections.drop("seq"), "flow_id", "left").where(conditions(params, now))


def stats(flows: DataFrame, detections: DataFrame, params: dict[str, str], now: Column) -> DataFrame:
    """All totals in one pass; flows without a detection count as benign."""
    bad = F.count_if(F.col("is_malicious") == 1)
    total = joined(flows, detections, params, now).agg(F.count("*").alias("total_flows"), bad.alias("total_attacks"))
    return total.select("total_flows", (F.col("total_flows") - F.col("total_attacks")).alias("benign_flows"), "total_attacks", F.col("total_attacks").alias("security_alerts"))


def attack_distribution(flows: DataFrame, detections: DataFrame, params: dict[str, str], now: Column) -> DataFrame:
    return joined(flows, detections, params, now).where("is_malicious = 1").groupBy("attack_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "attack_type")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a total order: a top-k, not a sort of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def training_stats(flows: DataFrame, detections: DataFrame, least: float = 0.7) -> DataFrame:
    """How many scored flows of each class are confident, and when the newest was stored."""
    both = flows.select("flow_id", "created_at").join(detections.select("flow_id", "attack_type", "confidence"), "flow_id")
    sure = F.col("confidence") >= least
    return both.groupBy("attack_type").agg(F.count_if(sure).alias("samples"), F.max("created_at").alias("latest")).where("samples > 0")
