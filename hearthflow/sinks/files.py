"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MASTER_COLUMNS


def master_csv(df: DataFrame, path: str, fmt: str = "csv", files: int | None = None) -> None:
    """Exactly the 18 master columns, ordered over all files by (timestamp, push id).

    Range partitioning keeps the order without a single-task sort; pass `files=1` for one
    file where the data is known to be small.
    """
    keyed = df.withColumn("timestamp", F.coalesce("timestamp", F.lit("")))
    by = ("timestamp", "push_id")
    spread = (
        keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)
    ).sortWithinPartitions(*by)
    writer = spread.select(*MASTER_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def calibrated(df: DataFrame, path: str, time: str = "event_time", fmt: str = "parquet") -> None:
    """Enriched readings by day. The rebalance hint gathers a day in few files and splits a
    day that is too large for one task."""
    (
        df.withColumn("event_date", F.to_date(time))
        .hint("rebalance", "event_date")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .format(fmt)
        .save(path)
    )


def session_bucket(session: str = "session_id"):
    name = F.upper(session)
    return (
        F.when(name.contains("FLAME"), F.lit("flame_tests"))
        .when(name.contains("RECOVERY"), F.lit("recovery"))
        .otherwise(F.lit("normal"))
    )


def session_partitioned(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Session rows below bucket=<kind>/session_id=<id>, a session in few files."""
    (
        df.withColumn("bucket", session_bucket())
        .hint("rebalance", "bucket", "session_id")
        .write.mode("overwrite")
        .partitionBy("bucket", "session_id")
        .format(fmt)
        .save(path)
    )
