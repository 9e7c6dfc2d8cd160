"""Numbered versions of models in a folder, and which version a micro-batch uses."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning
from .online import enrichment


class Registry:
    """Models below `path`, one folder a version. A version counts once its description is there,
    which is written after the model, so one that is being published is not seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._loaded: dict[int, object] = {}

    def versions(self) -> list[int]:
        try:
            found = self.spark.read.option("basePath", self.path).text(f"{self.path}/version=*/config")
        except AnalysisException:
            return []
        number = F.regexp_extract(F.input_file_name(), r"version=(\d+)", 1).cast("int")
        # one line per version
        return sorted(r[0] for r in found.select(number.alias("n")).distinct().collect())

    def publish(self, model, name: str, scores: dict | None = None) -> int:
        """Save a model as the next version and return its number. One writer at a time."""
        version = max(self.versions(), default=0) + 1
        learning.save_bundle(model, f"{self.path}/version={version}", name, scores or {})
        return version

    def load(self, version: int):
        if version not in self._loaded:
            self._loaded[version], _ = learning.load_bundle(self.spark, f"{self.path}/version={version}")
        return self._loaded[version]

    def pinned(self, pins: str, batch_id: int) -> int | None:
        """The version of a micro-batch: the newest when it is first asked for, and the same one
        whenever the batch is run again. None (kept as 0) while there is no version."""
        path = f"{pins}/batch_id={batch_id}"
        try:
            kept = self.spark.read.schema("version int").parquet(path).first()
        except AnalysisException:
            kept = None
        if kept is None:
            kept = (max(self.versions(), default=0),)
            self.spark.createDataFrame([kept], "version int").coalesce(1).write.mode("overwrite").parquet(path)
        return kept[0] or None


def versioned_enrichment(registry: Registry, pins: str):
    """Enrichment of a micro-batch by its version of the model, for `sinks.streams.enrichment_patch`.
    `pins` belongs to one checkpoint."""

    def prepare(batch: DataFrame, batch_id: int) -> DataFrame:
        version = registry.pinned(pins, batch_id)
        model = None if version is None else registry.load(version)
        return enrichment(batch, model).withColumn("model_version", F.lit(version).cast("int"))

    return prepare
