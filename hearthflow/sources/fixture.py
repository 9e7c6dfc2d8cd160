"""Readings derived from the `events` table, the input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor reading per event on a 1 Hz clock; 10 rooms with 2 devices each."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("event_id").alias("t_sec"),
        F.timestamp_seconds(F.col("event_id") + EPOCH).alias("event_time"),
        F.concat(F.lit("dev_"), F.col("user_id") % 20).alias("device_id"),
        F.concat(F.lit("ROOM_"), F.col("user_id") % 10).alias("room_id"),
        (F.lit(22.0) + F.least(F.col("value"), F.lit(200.0)) * 0.08).alias("temperature"),
        (F.lit(40.0) + k * F.lit(0.4)).alias("humidity"),
        F.lit(1013.25).alias("pressure"),
        (
            F.lit(1400.0)
            + F.floor("value") * F.when(F.col("event_type") == "view", 0.0).otherwise(2.0)
        ).alias("gas_raw"),
        F.when(error & (k < 5), 0.8).otherwise(3.0).alias("flame_voltage"),
        F.when(error & (k < 3), 1).otherwise(0).alias("flame_digital"),
        (F.lit(1023) - F.least(F.floor(F.col("value") * 4), F.lit(1023)))
        .cast("int")
        .alias("flame_raw"),
        F.floor(k * 180 / F.lit(99)).cast("int").alias("servo_angle"),
        k.alias("k"),
        "event_type",
        "value",
    )


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as a streaming source over the table's file."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return _from_events(source.parquet(sf_dir))
