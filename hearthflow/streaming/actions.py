"""What operators do to alerts, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import alert_ack

WAIT = "1 hour"


def acknowledgements(alerts: DataFrame, acks: DataFrame, wait: str = WAIT) -> DataFrame:
    """What becomes of each alert and each acknowledgement (both streams with `alert_id`): alert_id,
    outcome, raised_at, acked_at.

    * ACKED: the acknowledgement came within `wait` of the alert, before or after it; one row
      for each, at once.
    * OPEN: an alert that nobody acknowledged in that time, when the time is over.
    * LATE: an acknowledgement without an alert in that time, when the time is over.

    Null ids meet nothing and end as OPEN and LATE. Times are those of arrival, which the batch fixes, so no row is ever behind the watermark and every
    alert and acknowledgement gives at least one row; what is stored is what came in the last `wait`.
    """
    raised = alerts.select("alert_id", F.current_timestamp().alias("raised_at"))
    given = acks.select(F.col("alert_id").alias("ack_of"), F.current_timestamp().alias("acked_at"))
    # in stream-stream outer joins nulls meet as equal keys
    near = F.expr(
        f"alert_id = ack_of AND alert_id IS NOT NULL AND acked_at >= raised_at - INTERVAL {wait} "
        f"AND acked_at <= raised_at + INTERVAL {wait}"
    )
    met = raised.withWatermark("raised_at", "0 seconds").join(
        given.withWatermark("acked_at", "0 seconds"), near, "full_outer"
    )
    outcome = F.when(F.col("raised_at").isNull(), "LATE").when(F.col("acked_at").isNull(), "OPEN")
    return met.select(
        F.coalesce("alert_id", "ack_of").alias("alert_id"),
        outcome.otherwise("ACKED").alias("outcome"),
        "raised_at",
        "acked_at",
    )


def acknowledged(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The stored alerts with the acknowledgements known so far, late ones included."""
    return alert_ack(alerts, outcomes.where("outcome <> 'OPEN'"))
