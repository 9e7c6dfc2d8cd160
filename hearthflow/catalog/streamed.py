"""Streaming queries, run over everything that is there and checked like their batch twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans.models import Registry, versioned_enrichment
from ..session import staging_path
from ..sinks import streams
from ..sources import wire
from ..sources.fixture import reading_stream, readings
from ..streaming import actions, jobs, processors, windows
from . import inputs
from .inputs import POSTED, rounded
from .intake import POST_COLUMNS
from . import timed  # noqa: F401  (its checks hold for the streaming twins)
from .registry import ORACLES, query
from .sql import DECIDED_BY_MODEL, ROOM_WALK, STATED, alert_walk, check

POSTED_COLUMNS = [c for c in POST_COLUMNS if c != "reason"]


@query(check(f"SELECT {', '.join(POSTED_COLUMNS)} FROM posted WHERE reason IS NULL", POSTED))
def stream_ingest(spark, sf):
    accepted, _ = jobs.ingest(inputs.telemetry_posts(reading_stream(spark, sf)))
    return jobs.drain(accepted, "ingest").select(*POSTED_COLUMNS)


@query(check("SELECT reading_id, reason FROM posted WHERE reason IS NOT NULL", POSTED))
def stream_poll_trigger(spark, sf):
    """Polling job with the reject stream as its input; the trigger is the only difference
    to a 2-second poll."""
    rejected = wire.split_rejects(wire.telemetry_json(inputs.telemetry_posts(reading_stream(spark, sf))))[1]
    return jobs.drain(rejected.select("reading_id", "reason"), "poll")


@query(check("SELECT reading_id AS alert_id, k < 5 OR k >= 60 AS acknowledged FROM readings"))
def stream_alert_ack(spark, sf):
    """Alerts and their acknowledgements as two streams, joined, and the stored alerts with them."""
    jobs.use_state_store(spark)
    alert_id = F.col("reading_id").alias("alert_id")
    raised = reading_stream(spark, sf).select(alert_id)
    acks = reading_stream(spark, sf).filter("k >= 60").select(alert_id)
    outcomes = jobs.drain(actions.acknowledgements(raised, acks), "acks")
    stored = readings(spark, sf).select(alert_id, (F.col("k") < 5).alias("acknowledged"))
    return actions.acknowledged(stored, outcomes)


@query(check("SELECT reading_id, device_id FROM readings"))
def stream_dedup(spark, sf):
    jobs.use_state_store(spark)
    r = reading_stream(spark, sf).select("reading_id", "device_id", "event_time")
    sent = r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy")
    return jobs.drain(jobs.dedup(sent), "dedup").drop("event_time")


CLASSIFIED = (
    "SELECT reading_id, verdict, temp_mean, gas_z, seen FROM classified"
)


def _classified(rows):
    return rows.select("reading_id", "verdict", "temp_mean", "gas_z", "seen")


@query(check(CLASSIFIED, ROOM_WALK))
def stream_room_baseline(spark, sf):
    jobs.use_state_store(spark)
    on_time, _ = jobs.split_late(processors.room_baseline(reading_stream(spark, sf)))
    return _classified(jobs.drain(on_time, "rooms"))


@query(ORACLES["win_history_50"])
def stream_history_50(spark, sf):
    """The last 50 readings of each device as live state."""
    jobs.use_state_store(spark)
    out = jobs.drain(windows.history(reading_stream(spark, sf)), "history")
    return rounded(out, 9, "temperature_mean", "gas_raw_mean").select(
        "reading_id", "history_rows", "temperature_mean", "temperature_min", "temperature_max",
        "gas_raw_mean", "gas_raw_min", "gas_raw_max",
    )


@query(ORACLES["feat_rolling"])
def stream_rolling(spark, sf):
    """Rolling features of each device on a stream."""
    jobs.use_state_store(spark)
    out = jobs.drain(windows.rolling_features(reading_stream(spark, sf)), "rolling")
    out = rounded(out, 9, "temperature_mean")
    return rounded(out, 7, "temperature_std", "temperature_z").select(
        "reading_id", "temperature_mean", "temperature_std", "temperature_z", "gas_raw_anomaly",
        "flame_raw_anomaly",
    )


#: Every stretch of a room's readings without a silence of more than 30 s is a room of its own.
SESSIONS = """
sessions AS (
  SELECT * REPLACE (room_id || '/' || session AS room_id) FROM (
    SELECT *, sum(anew) OVER (PARTITION BY room_id ORDER BY t_sec, reading_id) AS session FROM (
      SELECT *, CASE WHEN t_sec - lag(t_sec) OVER (PARTITION BY room_id
                       ORDER BY t_sec, reading_id) > 30 THEN 1 ELSE 0 END AS anew
      FROM readings)))"""


@query(check(CLASSIFIED, SESSIONS, re.sub(r"\breadings\b", "sessions", ROOM_WALK)))
def stream_state_ttl(spark, sf):
    """Room state that is forgotten after 30 seconds without readings."""
    jobs.use_state_store(spark)
    rows = processors.room_baseline(reading_stream(spark, sf), forget_ms=30_000)
    return _classified(jobs.drain(rows, "ttl"))


@query(check("SELECT reading_id, alert_kind FROM alerted", STATED, alert_walk()))
def stream_alert_state(spark, sf):
    jobs.use_state_store(spark)
    rows = processors.alert_state(inputs.stated(reading_stream(spark, sf)))
    return jobs.drain(rows.select("reading_id", "alert_kind"), "alerts")


@query(
    check(
        """SELECT device_id AS device, (t_sec + 1704067200) * 1000 AS silent_since_ms
           FROM (SELECT device_id, t_sec,
                   lead(t_sec) OVER (PARTITION BY device_id ORDER BY t_sec) AS next,
                   max(t_sec) OVER () AS newest FROM readings)
           WHERE coalesce(next - t_sec > 1.5, t_sec + 1.501 <= newest - 30)"""
    )
)
def stream_watchdog(spark, sf):
    jobs.use_state_store(spark)
    return jobs.drain(processors.watchdog(reading_stream(spark, sf)), "watchdog")


@query(
    check(
        """SELECT reading_id, room_id FROM readings JOIN (
             SELECT room_id, max(t_sec) AS newest FROM readings WHERE event_type <> 'signup'
             GROUP BY room_id) USING (room_id)
           WHERE event_type = 'signup' AND t_sec < newest"""
    )
)
def stream_late_data(spark, sf):
    """Sign-up readings arrive after all others; those older than what their room has
    already seen go to the late table."""
    jobs.use_state_store(spark)
    base = staging_path(spark, "late")
    r = readings(spark, sf)
    for part in (r.filter("event_type <> 'signup'"), r.filter("event_type = 'signup'")):
        part.write.mode("append").parquet(f"{base}/in")
        source = jobs.file_stream(spark, f"{base}/in", r.schema)
        _, late = jobs.split_late(processors.room_baseline(source))
        jobs.to_table(
            late.select("reading_id", "room_id"), f"{base}/out", f"{base}/progress",
            jobs.available_now(),
        ).awaitTermination()
    return spark.read.schema("reading_id bigint, room_id string").parquet(f"{base}/out")


@query(
    check(
        "SELECT reading_id, device_id, ml_prediction AS prediction, round(p_fire, 9) AS confidence, "
        "round(risk_score, 6) AS risk_score, 1 AS model_version FROM decided "
        "WHERE event_type IN ('view', 'error')",
        ROOM_WALK,
        DECIDED_BY_MODEL,
    )
)
def stream_enrich_writeback(spark, sf):
    """Enrich the readings that wait for inference by the newest published model and write the
    answers back by id."""
    from ..operators.normalise import pending_inference

    jobs.use_state_store(spark)
    path = staging_path(spark, "writeback")
    registry = Registry(spark, f"{path}/models")
    registry.publish(inputs.given_model(), "BoostedTrees")
    kind = F.col("event_type")
    known = F.when(kind == "view", "PENDING_INFERENCE").when(kind != "error", "NORMAL")
    classified = processors.room_baseline(reading_stream(spark, sf))
    waiting = pending_inference(classified.withColumn("ml_prediction", known)).drop("ml_prediction")
    streams.enrichment_patch(
        waiting, f"{path}/rows", f"{path}/progress", jobs.available_now(),
        versioned_enrichment(registry, f"{path}/pins"),
    ).awaitTermination()
    out = streams.patched(readings(spark, sf), f"{path}/rows").filter("prediction is not null")
    return out.select(
        "reading_id", "device_id", "prediction", F.round("confidence", 9).alias("confidence"),
        F.round("risk_score", 6).alias("risk_score"), "model_version",
    )
