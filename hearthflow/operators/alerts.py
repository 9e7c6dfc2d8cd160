"""Alert stream, alert rows, feeds and the audit trail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, micros, one_decimal
from ..schema import DANGER, FIRE_STATES
from .folds import AlertWalk, walk_series
from .series import Series, over_series


def level(state: Column | str) -> Column:
    """Position of a state among SAFE, WARNING, HIGH_RISK, FIRE."""
    return (
        F.array_position(F.array(*[F.lit(s) for s in FIRE_STATES]), as_col(state)) - 1
    ).cast("int")


def rate_limit(
    df: DataFrame,
    reminder: float = 60.0,
    state: str = "fire_state",
    key: str = "device_id",
    order: Sequence[str] = ("event_time", "reading_id"),
    **limits,
) -> DataFrame:
    """`alert_kind` per reading: TRANSITION, REMINDER, ALL_CLEAR or null. An unknown state counts
    as WARNING."""
    known = F.coalesce(level(state), F.lit(1))
    df = df.withColumns({"at_us": micros("event_time"), "alert_level": known})

    def step(s: Series) -> DataFrame:
        return walk_series(s, AlertWalk(reminder))

    return (
        over_series(df, key, order, step, **limits)
        .drop("at_us", "alert_level")
        .withColumn("should_alert", F.col("alert_kind").isNotNull())
    )


def build(df: DataFrame) -> DataFrame:
    """Alert rows from decisions that should alert."""
    danger = F.col("fire_state").isin(*DANGER)
    # Titles and message wording.
    title = F.concat(
        F.when(danger, F.lit("🔥 FIRE ALERT: ")).otherwise(F.lit("✅ ALL CLEAR: ")), "room_id"
    )
    message = F.concat(
        F.lit("Severity: "), "fire_state",
        F.lit(" | Risk Score: "), one_decimal("risk_score"),
        F.lit("% | Detected Angle: "), F.col("servo_angle").cast("string"),
        F.lit("° | Device: "), "device_id",
    )
    return df.select(
        F.sha2(
            F.concat_ws("|", "device_id", micros("event_time").cast("string"), "reading_id"), 256
        ).alias("alert_id"),
        "reading_id",
        "device_id",
        "room_id",
        F.when(danger, F.lit("critical")).otherwise(F.lit("info")).alias("severity"),
        title.alias("title"),
        message.alias("message"),
        "fire_state",
        "risk_score",
        F.col("servo_angle").alias("fire_angle"),
        "event_time",
        F.lit(False).alias("acknowledged"),
    )


def dispatch_log(requests: DataFrame) -> DataFrame:
    """Audit rows of notification requests, with the defaults of missing fields."""
    return requests.select(
        F.sha2(
            F.concat_ws("|", F.lit("dispatch"), "reading_id", micros("event_time").cast("string")),
            256,
        ).alias("alert_id"),
        F.lit("USER_NOTIFICATION_DISPATCH").alias("type"),
        F.coalesce("email", F.lit("")).alias("email_sent_to"),
        F.coalesce("phone", F.lit("")).alias("sms_sent_to"),
        F.coalesce("room_id", F.lit("General Room")).alias("room_id"),
        F.coalesce("temperature", F.lit(25.0)).alias("temperature"),
        F.coalesce("fire_angle", F.lit(90)).alias("fire_angle"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        "event_time",
        "reading_id",
    )


def audit_trail(alerts: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Alerts and notification requests in one trail, told apart by `event_kind`."""
    return alerts.withColumn("event_kind", F.lit("ALERT")).unionByName(
        dispatches.withColumn("event_kind", F.lit("DISPATCH")), allowMissingColumns=True
    )


def view(alerts: DataFrame) -> DataFrame:
    """Feed rows as the console shows them."""
    critical = (F.coalesce("severity", F.lit("")) == "critical") | (
        F.coalesce("fire_state", F.lit("")) == "FIRE"
    )
    shown = F.nullif("severity", F.lit(""))
    return alerts.select(
        "alert_id",
        "event_time",
        critical.alias("is_critical"),
        F.coalesce(shown, F.when(critical, F.lit("critical")).otherwise(F.lit("info"))).alias(
            "severity"
        ),
        F.coalesce(
            F.nullif("room_id", F.lit("")), F.nullif("device_id", F.lit("")), F.lit("Kitchen")
        ).alias("place"),
        F.coalesce(F.nullif("message", F.lit("")), "title").alias("text"),
        F.coalesce(F.concat(F.col("fire_angle").cast("string"), F.lit("°")), F.lit("N/A")).alias(
            "angle"
        ),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"),
    )


def recent(alerts: DataFrame, rows: int = 50) -> DataFrame:
    """Newest alerts; planned as a top-k, never as a full sort."""
    return alerts.orderBy(F.desc("event_time"), F.desc("alert_id")).limit(rows)


def feed(alerts: DataFrame, rows: int = 8) -> DataFrame:
    return view(recent(alerts, rows))
