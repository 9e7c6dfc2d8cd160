"""Sinks: write, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts
from ..plans.calibrate import batch_calibrate
from ..plans.online import decide, enrichment
from ..schema import MASTER_COLUMNS
from ..session import staged, staging_path
from ..sinks import files, streams
from ..sources.fixture import reading_stream, readings
from ..streaming import jobs, processors
from . import inputs
from .inputs import TREED
from .intake import tree
from .registry import query
from .sql import DECIDED, ROOM_WALK, STATED, alert_walk, check

MASTER_TEXT = {
    "timestamp", "device_id", "zone_id", "experiment_id", "fire_state", "ml_prediction",
    "responder_status",
}
MASTER_TYPES = {"flame_digital": "int", "servo_angle": "int", **dict.fromkeys(MASTER_TEXT, "string")}
MASTER_SCHEMA = ", ".join(f"{c} {MASTER_TYPES.get(c, 'double')}" for c in MASTER_COLUMNS)


@query(
    check(
        "SELECT nullif(timestamp, '') AS timestamp, " + ", ".join(MASTER_COLUMNS[1:]) + " FROM treed",
        TREED,
    )
)
def sink_master_csv(spark, sf):
    path = staging_path(spark, "master")
    # Range partitioning reads its input twice, to find the ranges and to write.
    files.master_csv(staged(tree(readings(spark, sf)), "tree"), path)
    return spark.read.schema(MASTER_SCHEMA).option("header", True).csv(path)


@query(
    check(
        "SELECT strftime(make_timestamp((1704067200 + t_sec) * 1000000), '%Y-%m-%d') "
        "AS event_date, verdict, count(*) AS n FROM classified GROUP BY ALL",
        ROOM_WALK,
    )
)
def sink_calibrated(spark, sf):
    path = staging_path(spark, "calibrated")
    files.calibrated(batch_calibrate(readings(spark, sf)), path)
    return (
        spark.read.parquet(path)
        .groupBy(
            F.col("event_date").cast("string").alias("event_date"),
            F.col("ai_classification_verdict").alias("verdict"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    check(
        """SELECT reading_id, CASE event_type WHEN 'error' THEN 'flame_tests'
             WHEN 'purchase' THEN 'recovery' ELSE 'normal' END AS bucket,
             CASE event_type WHEN 'error' THEN 'flame_test_001' WHEN 'purchase' THEN 'Recovery_2'
             ELSE 'NORMAL_001' END AS session_id FROM readings"""
    )
)
def sink_session_partitioned(spark, sf):
    path = staging_path(spark, "sessions")
    kind = F.col("event_type")
    name = F.when(kind == "error", "flame_test_001").when(kind == "purchase", "Recovery_2")
    rows = readings(spark, sf).select(
        "reading_id", "flame_raw", name.otherwise("NORMAL_001").alias("session_id")
    )
    files.session_partitioned(rows, path)
    return spark.read.parquet(path).select("reading_id", "bucket", "session_id")


@query(
    check(
        """SELECT reading_id, risk_score, verdict AS prediction,
             CASE WHEN fire_state = 'FIRE' THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS confidence,
             verdict AS ai_classification_verdict FROM decided""",
        ROOM_WALK,
        DECIDED,
    )
)
def sink_enrichment_patch(spark, sf):
    jobs.use_state_store(spark)
    path = staging_path(spark, "patch")
    enriched = enrichment(processors.room_baseline(reading_stream(spark, sf)))
    streams.enrichment_patch(
        enriched, f"{path}/rows", f"{path}/progress", jobs.available_now()
    ).awaitTermination()
    return streams.patched(readings(spark, sf), f"{path}/rows").select(
        "reading_id", "risk_score", "prediction", "confidence",
        "ai_classification_verdict",
    )


@query(
    check(
        """SELECT device_id AS id, max(reading_id) AS reading_id,
             arg_max(fire_state, reading_id) AS fire_state, arg_max(verdict, reading_id) AS verdict
           FROM decided GROUP BY device_id""",
        ROOM_WALK,
        DECIDED,
    )
)
def sink_device_state(spark, sf):
    jobs.use_state_store(spark)
    path = staging_path(spark, "devices")
    docs = decide(processors.room_baseline(reading_stream(spark, sf))).select(
        F.col("device_id").alias("id"), "event_time", "reading_id", "fire_state", "verdict"
    )
    streams.device_state(
        docs, path, f"{path}/progress", jobs.available_now()
    ).awaitTermination()
    return streams.current_state(spark, path).drop("event_time")


@query(
    check(
        "SELECT reading_id, device_id, fire_state, CASE WHEN fire_state IN ('HIGH_RISK', 'FIRE') "
        "THEN 'critical' ELSE 'info' END AS severity FROM alerted WHERE alert_kind IS NOT NULL",
        STATED,
        alert_walk(),
    )
)
def sink_alerts(spark, sf):
    jobs.use_state_store(spark)
    path = staging_path(spark, "alerts")
    r = inputs.stated(reading_stream(spark, sf)).withColumn("risk_score", F.col("k").cast("double"))
    rows = alerts.build(processors.alert_state(r).filter("should_alert"))
    streams.alerts(rows, f"{path}/rows", f"{path}/progress", jobs.available_now()).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(
        "reading_id", "device_id", "fire_state", "severity"
    )
