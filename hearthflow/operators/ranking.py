"""Sort, top-k, latest state and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .timeline import ORDER, latest_rows, sorted_by_time

__all__ = [
    "champion", "dedup", "device_history", "latest_per_device", "positions",
    "recent_per_device", "sort_chronological", "sort_export", "top_features", "union_devices",
]

def sort_chronological(
    df: DataFrame, order: Sequence[str] = ORDER, position: str | None = None
) -> DataFrame:
    """Chronological order with unknown times last; on request with each row's place as a column."""
    if position is None:
        return sorted_by_time(df, order)
    return positions(df, [F.col(order[0]).asc_nulls_last(), *order[1:]], position).orderBy(position)


def sort_export(df: DataFrame, position: str | None = None) -> DataFrame:
    """Order of the master export: timestamp text with blanks first, then push id; on request
    with each row's place as a column."""
    order = [F.coalesce("timestamp", F.lit("")), F.col("push_id")]
    if position is None:
        return df.orderBy(*order)
    return positions(df, order, position).orderBy(position)


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """All rows with their place, from 1, in the order of the whole table.

    Rows are range-partitioned and sorted by Spark; a row's place is its place in its partition
    plus the rows of the partitions before it, a running sum over one row per partition. No task
    sees more than its partition. The partitioner reads its input twice, so stage costly input.
    Rows that agree in all of `order` take their places in any order."""
    at = _unused(df, "_at")
    part = F.shiftright(at, 33)  # the id holds the partition above 33 bits of the place in it
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ordered.withColumn(at, F.monotonically_increasing_id()), "positions")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    before = sizes.select(F.col("_part").alias("_of"), earlier.alias("_before"))
    joined = placed.join(F.broadcast(before), part == F.col("_of"))
    place = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.select(*df.columns, place.alias(name))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def recent_per_device(df: DataFrame, rows: int = 10, key: str = "device_id") -> DataFrame:
    return latest_rows(df, rows, key, [F.desc("reading_id")])


def device_history(df: DataFrame, rows: int = 50, key: str = "device_id") -> DataFrame:
    """The newest readings of each device, oldest first, with their `position`."""
    newest = latest_rows(df, rows, key, [F.desc("event_time"), F.desc("reading_id")]).drop("rank")
    oldest_first = Window.partitionBy(key).orderBy("event_time", "reading_id")
    kept = newest.withColumn("position", F.row_number().over(oldest_first))
    return kept.sortWithinPartitions(key, "position")


def latest_per_device(
    df: DataFrame,
    key: str = "device_id",
    order: Sequence[str] = ("event_time", "reading_id"),
) -> DataFrame:
    """Newest row per device as an aggregate, so only one row per device and task shuffles."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_latest"))
        .select(key, "_latest.*")
    )


def union_devices(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup(df: DataFrame, key: str = "reading_id", arrival: str = "arrival_time") -> DataFrame:
    """First arrival of every reading; equal arrivals are settled by content."""
    rest = [c for c in df.columns if c != key]
    first = F.struct(arrival, F.xxhash64(*rest))
    return (
        df.groupBy(key).agg(F.min_by(F.struct(*rest), first).alias("_first")).select(key, "_first.*")
    )


def champion(scores: DataFrame) -> DataFrame:
    """Best weighted F1; the earlier candidate wins a tie."""
    return scores.orderBy(F.desc("weighted_f1"), F.asc("candidate")).limit(1)


def top_features(importances: DataFrame, rows: int = 8) -> DataFrame:
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(rows)
