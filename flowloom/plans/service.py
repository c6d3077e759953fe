"""What a dashboard asks for, as functions that return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.operators import dashboard, store
from flowloom.operators.ml import Registry, Retraining
from flowloom.plans.store_queries import physical_interfaces
from flowloom.sources.files import tail


@dataclass
class Service:
    """Flows and detections as tables; ``now`` stands for the clock, in seconds."""

    spark: SparkSession
    flows: DataFrame
    detections: DataFrame
    now: float
    registry: Registry | None = None
    retraining: Retraining | None = None

    @property
    def _now(self) -> Column:
        return F.lit(float(self.now))

    def health(self) -> DataFrame:
        """Whether the store can be read, and how far it goes."""
        return self.flows.agg(F.lit("ok").alias("status"), F.max("created_at").alias("latest"))

    def stats(self, **params: str) -> DataFrame:
        return dashboard.stats(self.flows, self.detections, params, self._now)

    def attack_distribution(self, **params: str) -> DataFrame:
        return dashboard.attack_distribution(self.flows, self.detections, params, self._now)

    def alerts(self, limit: int = 50, offset: int = 0, **params: str) -> DataFrame:
        kept = self.flows.join(self.detections.select("flow_id", "is_malicious"), "flow_id").where(dashboard.conditions(params, self._now)).select(self.flows["*"])
        return dashboard.page(store.security_alerts(kept, self.detections), [F.desc("detected_at"), "flow_id"], limit, offset)

    def flows_page(self, limit: int = 50, offset: int = 0, **params: str) -> DataFrame:
        return dashboard.page(dashboard.joined(self.flows, self.detections, params, self._now), [F.desc("seq")], limit, offset)

    def interfaces(self, rows: DataFrame) -> DataFrame:
        return physical_interfaces(rows)

    def logs(self, lines: DataFrame, n: int = 200, by_file: bool = False) -> DataFrame:
        """The last lines of (file, n, value), of all logs or of each."""
        return tail(lines, ["n"], n, ["file"] if by_file else None)

    def training_stats(self) -> DataFrame:
        return dashboard.training_stats(self.flows, self.detections)

    def models(self) -> DataFrame:
        if self.registry is None:
            raise ValueError("no registry")
        return self.registry.versions(self.spark)

    def retraining_status(self) -> DataFrame:
        r = self.retraining
        row = (r.status, r.progress, r.error) if r else ("idle", 0, "")
        return self.spark.createDataFrame([row], "status string, progress int, error string")
