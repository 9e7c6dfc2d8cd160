"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.normalise import clean


def dataset_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Dataset files with a header. Columns are read as text unless a schema is given, so
    there is no pass over the data just to guess types."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def clean_dataset(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return clean(dataset_csv(spark, path))
