"""Streaming intake, dedup and the jobs built from the processors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import ROCKSDB, staging_path
from ..sources.wire import split_rejects, telemetry_json

REMEMBER = "1 hour"
# A micro-batch is sorted as a whole, so sources are read in bounded portions.
BATCH_BYTES = 8 * 1024**3
BATCH_OFFSETS = 20_000_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    if not {"maxFilesPerTrigger", "maxBytesPerTrigger"} & set(options):
        options["maxBytesPerTrigger"] = BATCH_BYTES
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def broker_stream(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Topic, value and time of broker messages (needs Spark's Kafka package)."""
    options.setdefault("maxOffsetsPerTrigger", BATCH_OFFSETS)
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(
        F.col("topic"), F.col("value").cast("string"), F.col("timestamp").alias("arrival_time")
    )


def ingest(posts: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted readings, rejected posts with reason) of a stream of telemetry posts."""
    return split_rejects(telemetry_json(posts, value))


def dedup(df: DataFrame, remember: str = REMEMBER, key: str = "reading_id") -> DataFrame:
    """Each reading once; an id is remembered for at least that long after it arrived. Time is that
    of arrival, so a reading is never too late, however old it is."""
    arrived = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def split_late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("not late").drop("late"), df.filter("late")


def every(seconds: float) -> dict:
    """Trigger of the polling job; tests use available_now()."""
    return {"processingTime": f"{seconds} seconds"}


def available_now() -> dict:
    return {"availableNow": True}


def to_table(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    mode: str = "append",
    fmt: str = "parquet",
) -> StreamingQuery:
    return (
        df.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every(2)))
        .start(path)
    )


def drain(df: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over everything that is there now and read its result back."""
    spark = df.sparkSession
    base = staging_path(spark, name)
    to_table(df, f"{base}/rows", f"{base}/progress", available_now()).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")
