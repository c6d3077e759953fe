"""The scoring job: flows to vectors, scaling, ensemble, detections, store, acknowledgement."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.functions.labels import CLASSES, SEVERITIES, class_label, severity
from flowloom.functions.rounding import round_exact
from flowloom.functions.vectors import argmax, bound, feature_vector, scaled, softmax
from flowloom.operators import boosting
from flowloom.operators.bucket_store import BucketStore
from flowloom.operators.features import FEATURES
from flowloom.session import forget, keep
from flowloom.sources.files import parse_flow_lines


@dataclass
class Bundle:
    """What a model needs to score: feature names in order, scaler, class names, severities, trees."""

    ensemble: boosting.Ensemble
    means: list[float]
    deviations: list[float]
    names: tuple[str, ...] = tuple(FEATURES)
    classes: tuple[str, ...] = CLASSES
    severities: dict[str, str] = field(default_factory=lambda: dict(SEVERITIES))
    version: str = "v0"

    def save(self, spark: SparkSession, folder: str) -> str:
        """Writes the parts below ``folder``/version, nodes as a table and the rest as JSON."""
        place = f"{folder}/{self.version}"
        parts = {
            "spec": {"feature_names": list(self.names)},
            "scaler": {"means": self.means, "deviations": self.deviations},
            "labels": {"id_to_label": {str(i): c for i, c in enumerate(self.classes)}, "severity_mapping": self.severities},
            "model": {"classes": self.ensemble.classes, "base": self.ensemble.base, "version": self.version},
        }
        for name, value in parts.items():
            spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/{name}")
        boosting.node_table(spark, self.ensemble).write.mode("overwrite").parquet(f"{place}/nodes")
        return place

    @staticmethod
    def load(spark: SparkSession, place: str) -> Bundle:
        """The bundle at a place. Missing labels and a missing or empty spec are replaced by the
        standard ones; a missing scaler or model is an error."""
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def part(name: str) -> dict | None:
            if not fs.exists(fs_path(f"{place}/{name}")):
                return None
            return json.loads(spark.read.option("wholetext", True).text(f"{place}/{name}").first()[0])

        scaler, model, spec, labels = (part(x) for x in ("scaler", "model", "spec", "labels"))
        if scaler is None or model is None or not fs.exists(fs_path(f"{place}/nodes")):
            raise FileNotFoundError(f"no model and scaler at {place}")
        named = {int(k): v for k, v in (labels or {}).get("id_to_label", {}).items()}
        classes = tuple(named.get(i, f"Class_{i}") for i in range(max(named) + 1)) if named else CLASSES
        return Bundle(
            boosting.from_nodes(spark.read.parquet(f"{place}/nodes"), model["classes"], model["base"]),
            scaler["means"], scaler["deviations"], tuple((spec or {}).get("feature_names") or FEATURES), classes,
            (labels or {}).get("severity_mapping", {}) if labels else dict(SEVERITIES), model["version"],
        )


def vector_of(flows: DataFrame, names: tuple[str, ...]) -> Column:
    """The vector of a row's ``features`` map; where that is null, of the row's own columns."""
    own = [c for c in flows.columns if c != "features"]
    fallback = F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]) if own else None
    return feature_vector(F.col("features"), list(names), fallback)


def score(flows: DataFrame, bundle: Bundle, made: str | None = None) -> DataFrame:
    """``flows`` with class_id, confidence, is_malicious, attack_type, severity and probabilities
    (a map by label): expressions only. Confidence and probabilities have 4 decimals.

    A scaler that does not fit the names leaves the vector as it is. ``made`` names a column that
    has the vectors already.
    """
    fits = len(bundle.means) == len(bundle.deviations) == len(bundle.names)
    vector = F.col(made) if made else vector_of(flows, bundle.names)
    ready = scaled(vector, bundle.means, bundle.deviations) if fits else vector.cast("array<double>")
    margins = boosting.margins(bundle.ensemble, ready)
    out = flows.withColumn("__p", bound(margins, softmax)).withColumn("class_id", argmax(F.col("__p")))
    label = class_label(F.col("class_id"), bundle.classes)
    labels = F.array(*[F.lit(bundle.classes[i] if i < len(bundle.classes) else f"Class_{i}") for i in range(bundle.ensemble.classes)])
    return out.withColumns({
        "confidence": round_exact(F.get("__p", F.col("class_id")), 4),
        "is_malicious": (F.col("class_id") != 0).cast("int"),
        "attack_type": label,
        "severity": severity(label, F.col("class_id"), bundle.severities),
        "probabilities": F.map_from_arrays(labels, F.transform("__p", lambda p: round_exact(p, 4))),
    }).drop("__p")


def detection_lines(scored: DataFrame) -> DataFrame:
    """Each scored flow as one JSON line with a nested detection."""
    nested = ("is_malicious", "attack_type", "class_id", "confidence", "severity", "probabilities")
    detection = F.struct(*[(F.col(c) == 1).alias(c) if c == "is_malicious" else F.col(c) for c in nested]).alias("detection")
    return scored.select(F.to_json(F.struct(*[c for c in scored.columns if c not in nested], detection)).alias("value"))


FLOWS = "seq long, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, start_time_us long, end_time_us long, features map<string,string>, interface string"
DETECTIONS = "seq long, flow_id string, class_id int, is_malicious int, attack_type string, confidence double, severity string, probabilities map<string,double>"


@dataclass
class ScoringJob:
    """Takes batches of queued lines (id, flow_json): poison lines to quarantine, flows and their
    detections to stores, and then the ids to the acknowledged ones.

    Every step is named by the batch and idempotent: after a failure between any two of them
    the batch, tried again, gives the same tables. A flow is stored once, the first time; its
    detection is replaced by a later one.
    """

    folder: str
    bundle: Bundle
    buckets: int = 64

    @property
    def flows(self) -> BucketStore:
        return BucketStore(f"{self.folder}/flows", FLOWS, buckets=self.buckets)

    @property
    def detections(self) -> BucketStore:
        return BucketStore(f"{self.folder}/detections", DETECTIONS, buckets=self.buckets)

    def take(self, lines: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        self.store(lines, batch)
        self.acknowledge(lines, batch)

    def store(self, lines: DataFrame, batch: int) -> None:
        """Lines are parsed and scored once, and kept for the three tables. The detections are the
        last of these: a batch that they have is in all."""
        if self.detections.has(lines.sparkSession, batch):
            return
        parsed = parse_flow_lines(lines.withColumn("value", F.col("flow_json")), keep=["id"], all_lines=True)
        scored = keep(score(parsed.withColumn("seq", F.col("id")), self.bundle), "scored")
        bad = scored.where("malformed is not null")
        bad.select("id", F.col("malformed").alias("flow_json")).write.mode("overwrite").parquet(f"{self.folder}/poison/batch={batch}")
        good = scored.where("malformed is null")
        columns = lambda schema: [x.split()[0] for x in schema.split(", ")]
        self.flows.merge(good.select(*columns(FLOWS)), batch, replace=False, kept=True)
        self.detections.merge(good.select(*columns(DETECTIONS)), batch, kept=True)
        forget(scored)

    def acknowledge(self, lines: DataFrame, batch: int) -> None:
        lines.select("id").write.mode("overwrite").parquet(f"{self.folder}/processed/batch={batch}")

    def processed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long").parquet(f"{self.folder}/processed")

    def poison(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, flow_json string").parquet(f"{self.folder}/poison")
