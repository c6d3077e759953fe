"""Training and retraining: forests, evaluation, versions and their registry.

Spark has no multiclass gradient boosting and no warm start, so a random forest takes
the place of both, and fine-tuning trains again on old and new rows together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from flowloom.operators import prep


def as_vectors(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


def train_forest(df: DataFrame, label: str, features: str = "features", trees: int = 100, depth: int = 15, share: float = 0.3, seed: int = 42, weight: str | None = None) -> RandomForestClassificationModel | None:
    """A random forest; none without rows."""
    if df.select(label).limit(1).count() == 0:
        return None
    forest = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, subsamplingRate=share, seed=seed)
    return (forest.setWeightCol(weight) if weight else forest).fit(df)


def importances(spark: SparkSession, model: RandomForestClassificationModel | None) -> DataFrame:
    """(place, importance) of each feature; empty without a model."""
    found = model.featureImportances.toArray() if model else []
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(found)], "place int, importance double")


def predict(model: RandomForestClassificationModel | None, df: DataFrame) -> DataFrame:
    """``df`` with probabilities array<double> and class_id; both are null without a model."""
    if model is None:
        return df.withColumns({"probabilities": F.lit(None).cast("array<double>"), "class_id": F.lit(None).cast("int")})
    out = model.transform(df)
    return out.withColumns({"probabilities": vector_to_array("probability"), "class_id": F.col("prediction").cast("int")}).drop("probability", "rawPrediction", "prediction")


def explained_variance(df: DataFrame, features: str = "features", k: int = 2) -> list[float]:
    """Shares of the variance along the first principal axes; none without rows."""
    if df.select(features).limit(1).count() == 0:
        return []
    return [float(x) for x in PCA(k=k, inputCol=features, outputCol="__pca").fit(df).explainedVariance]


#: The steps of a retraining, with the progress that each begins at.
STEPS = {"idle": 0, "preparing": 5, "loading": 10, "extracting": 20, "splitting": 30, "training": 50, "evaluating": 80, "promoting": 90, "completed": 100}


def version_name(name: str | None, at: datetime) -> str:
    """A version from the time and a name made of letters, digits, hyphens and underscores."""
    safe = "".join(c for c in name or "" if c.isalnum() or c in "-_") or ("model" if name else "")
    return f"v{at:%Y%m%d_%H%M%S}" + f"_{safe}" * bool(safe)


@dataclass
class Registry:
    """Model versions below one folder, of which one is active; rows are append-only."""

    folder: str

    def record(self, spark: SparkSession, version: str, accuracy: float, at: datetime, active: bool = True) -> None:
        row = Row(version=version, accuracy=float(accuracy), at=at.timestamp(), active=active)
        spark.createDataFrame([row]).write.mode("append").parquet(f"{self.folder}/versions")

    def versions(self, spark: SparkSession) -> DataFrame:
        """All versions, newest first; active is the one that was last recorded as such."""
        rows = spark.read.parquet(f"{self.folder}/versions")
        last = rows.where("active").agg(F.max_by("version", "at").alias("__active"))
        one = rows.groupBy("version").agg(F.max_by("accuracy", "at").alias("accuracy"), F.max("at").alias("at"))
        return one.join(F.broadcast(last)).select("version", "accuracy", "at", (F.col("version") == F.col("__active")).alias("active")).orderBy(F.desc("at"))

    def switch(self, spark: SparkSession, version: str, at: datetime) -> None:
        known = self.versions(spark).where(F.col("version") == version).first()
        if known is None:
            raise ValueError(f"no version {version}")
        self.record(spark, version, known["accuracy"], at)


@dataclass
class Retraining:
    """Runs a retraining through its steps; ``stop`` takes effect before the next one."""

    registry: Registry
    status: str = "idle"
    progress: int = 0
    error: str = ""
    stopping: bool = False
    history: list[str] = field(default_factory=list)

    def _step(self, status: str) -> None:
        if self.stopping:
            self.status = "stopped"
            raise InterruptedError
        self.status, self.progress = status, STEPS[status]
        self.history.append(status)

    def stop(self) -> None:
        self.stopping = True

    def run(self, rows: DataFrame, key: str, vector: str, label: str, name: str, at: datetime, older: DataFrame | None = None, trees: int = 20, depth: int = 8) -> str | None:
        """The new version's name, or None if stopped or failed. With ``older`` rows the model is tuned on both."""
        spark = rows.sparkSession
        try:
            self._step("preparing")
            self._step("loading")
            data = rows if older is None else rows.unionByName(older)
            self._step("extracting")
            data = as_vectors(data, vector).withColumn("__label", F.col(label).cast("double"))
            self._step("splitting")
            parts = prep.stratified_split(data, label, key)
            self._step("training")
            model = train_forest(parts.where("part = 'train'"), "__label", trees=trees, depth=depth)
            self._step("evaluating")
            tested = predict(model, parts.where("part = 'validation'"))
            accuracy = prep.report(tested, label, "class_id").where("class = 'accuracy'").first()["f1"]
            self._step("promoting")
            version = version_name(name, at)
            model.write().overwrite().save(f"{self.registry.folder}/{version}")
            self.registry.record(spark, version, accuracy, at)
            self._step("completed")
            return version
        except InterruptedError:
            return None
        except Exception as error:
            self.status, self.error = "failed", str(error)
            raise

