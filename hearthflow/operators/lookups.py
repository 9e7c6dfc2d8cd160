"""Key lookups written as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col
from ..schema import CLASS_NAMES, DANGER
from .folds import RoomBaselineWalk

PROFILE = RoomBaselineWalk.state_names


def room_profile(readings: DataFrame, profiles: DataFrame, key: str = "room_id") -> DataFrame:
    """Each reading with the saved profile of its room, or the default profile.

    No broadcast hint: the profile table grows with the rooms. The planner broadcasts it
    when it is small and splits a hot room's readings when it is not.
    """
    fresh = F.struct(
        *[F.lit(float(v)).alias(n) for n, v in zip(PROFILE, RoomBaselineWalk.start)]
    )
    saved = profiles.select(
        key, F.struct(*[F.col(n).cast("double").alias(n) for n in PROFILE]).alias("profile")
    )
    return readings.join(saved, key, "left").withColumn("profile", F.coalesce("profile", fresh))


def alert_ack(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    done = acks.select("alert_id").distinct().withColumn("_acked", F.lit(True))
    return (
        alerts.join(done, "alert_id", "left")
        .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_acked", F.lit(False)))
        .drop("_acked")
    )


def _cleared(actions: DataFrame) -> DataFrame:
    return actions.filter(F.upper("action") == "CLEARED")


def verify_clear(docs: DataFrame, actions: DataFrame, scope: str = "all") -> DataFrame:
    """Reset the status of devices an operator cleared; readings themselves stay as they are.

    With scope "all" one clear covers every device, with "device" only its own.
    """
    if scope == "all":
        latest = _cleared(actions).agg(F.max("action_time")).scalar()
        docs = docs.withColumn("_cleared_at", latest)
    else:
        latest = _cleared(actions).groupBy("device_id").agg(
            F.max("action_time").alias("_cleared_at")
        )
        docs = docs.join(latest, "device_id", "left")
    reset = F.coalesce(F.col("event_time") <= F.col("_cleared_at"), F.lit(False))
    # The state a cleared device shows.
    return docs.withColumns(
        {
            "fire_state": F.when(reset, F.lit("SAFE")).otherwise(F.col("fire_state")),
            "risk_score": F.when(reset, F.lit(5.0)).otherwise(F.col("risk_score")),
            "response_status": F.when(reset, F.lit("CLEARED")).otherwise(
                F.col("response_status")
            ),
            "shown_temperature": F.when(reset, F.lit(24.5)).otherwise(F.col("temperature")),
            "shown_flame": F.when(reset, F.lit(860)).otherwise(F.col("flame_raw")),
        }
    ).drop("_cleared_at")


def clear_alerts(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """A clear also acknowledges every alert raised up to then."""
    latest = _cleared(actions).agg(F.max("action_time")).scalar()
    covered = F.coalesce(F.col("event_time") <= latest, F.lit(False))
    return alerts.withColumn("acknowledged", F.col("acknowledged") | covered)


def unprocessed(readings: DataFrame, enriched: DataFrame, key: str = "reading_id") -> DataFrame:
    return readings.join(enriched.select(key), key, "left_anti")


def label_name(label: Column | str) -> Column:
    pairs = [F.lit(x) for pair in CLASS_NAMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), as_col(label))


def in_danger(state: Column | str) -> Column:
    return as_col(state).isin(*DANGER)
