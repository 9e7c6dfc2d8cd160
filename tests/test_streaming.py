"""Streams in several micro-batches give the rows of the batch twins."""

import uuid

import pytest
from pyspark.sql import functions as F

from hearthflow.catalog import inputs
from hearthflow.operators import alerts
from hearthflow.plans.calibrate import classify
from hearthflow.session import staging_path
from hearthflow.sinks import streams
from hearthflow.streaming import jobs, processors


@pytest.fixture
def folder(spark):
    jobs.use_state_store(spark)
    return staging_path(spark, f"test-{uuid.uuid4().hex}")


def in_batches(spark, parts, folder, build, name="out"):
    """Feed the parts one after another to a stream that keeps its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = jobs.file_stream(spark, f"{folder}/in", part.schema)
        rows = build(source)
        jobs.to_table(
            rows, f"{folder}/{name}", f"{folder}/progress", jobs.available_now()
        ).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")


def by_time(readings, *cuts):
    edges = [-1, *cuts, 10**9]
    return [
        readings.filter((F.col("t_sec") > a) & (F.col("t_sec") <= b))
        for a, b in zip(edges[:-1], edges[1:])
    ]


def test_room_baseline_in_three_batches(spark, readings, folder):
    keep = ("reading_id", "verdict", "temp_mean", "gas_z", "seen", "temp_rate")
    got = in_batches(
        spark, by_time(readings, 300, 301), folder, lambda s: processors.room_baseline(s)
    )
    assert got.filter("late").count() == 0
    want = classify(readings).select(*keep)
    assert got.select(*keep).exceptAll(want).count() == 0
    assert got.count() == readings.count()


def test_alerts_in_two_batches(spark, readings, folder):
    stated = inputs.stated(readings)
    got = in_batches(spark, by_time(stated, 450), folder, lambda s: processors.alert_state(s))
    want = alerts.rate_limit(stated).select("reading_id", "alert_kind")
    assert got.select("reading_id", "alert_kind").exceptAll(want).count() == 0
    assert got.count() == stated.count()


def test_late_rows_leave_the_state_alone(spark, readings, folder):
    first, second = by_time(readings, 500)
    late_part = first.filter("reading_id % 10 = 3")
    on_time = first.filter("reading_id % 10 <> 3")
    got = in_batches(
        spark, [on_time, late_part, second], folder, lambda s: processors.room_baseline(s)
    )
    late = got.filter("late")
    assert 0 < late.count() <= late_part.count()
    assert late.filter("verdict is not null and seen is not null").count() == 0
    applied = readings.join(late.select("reading_id"), "reading_id", "left_anti")
    keep = ("reading_id", "verdict", "temp_mean")
    assert got.filter("not late").select(*keep).exceptAll(classify(applied).select(*keep)).count() == 0


def test_silent_rooms_are_forgotten(spark, readings, folder):
    # Room A speaks at 0 s and again much later; B keeps the watermark moving.
    def at(room, *seconds):
        rows = spark.createDataFrame([(i, room, s) for i, s in enumerate(seconds)],
                                     "reading_id int, room_id string, s int")
        return rows.select("reading_id", "room_id", F.timestamp_seconds(F.col("s") + 1_704_067_200)
                           .alias("event_time"),
                           F.lit(20.0).alias("temperature"))

    parts = [at("A", 0, 1), at("B", 500), at("B", 2000), at("B", 2001), at("A", 2002)]
    got = in_batches(
        spark, parts, folder, lambda s: processors.room_baseline(s, forget_ms=100_000)
    )
    seen = [r["seen"] for r in got.filter("room_id = 'A'").orderBy("event_time").collect()]
    assert seen == [1, 2, 1]


def test_replayed_batches_change_nothing(spark, readings, folder):
    docs = readings.select(F.col("device_id").alias("id"), "event_time", "reading_id", "temperature")
    path = f"{folder}/state"
    for part in by_time(docs.withColumn("t_sec", F.col("reading_id")), 400, 800):
        part.drop("t_sec").write.mode("append").parquet(f"{folder}/in")
        source = jobs.file_stream(spark, f"{folder}/in", docs.schema)
        streams.device_state(
            source, path, f"{folder}/progress", jobs.available_now()
        ).awaitTermination()
    want = docs.groupBy("id").agg(F.max("reading_id").alias("reading_id"))
    got = streams.current_state(spark, path).select("id", "reading_id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    # A fresh checkpoint replays everything as batch 0 onto the same tables.
    source = jobs.file_stream(spark, f"{folder}/in", docs.schema)
    for run in ("again", "and-again"):
        streams.device_state(
            source, f"{folder}/{run}", f"{folder}/progress-{run}", jobs.available_now()
        ).awaitTermination()
        again = streams.current_state(spark, f"{folder}/{run}").select("id", "reading_id")
        assert again.exceptAll(want).count() == 0


def test_every_row_comes_out_of_a_stream(spark, readings, folder):
    """Late, undated and keyless rows are passed on; nothing is lost and nothing stops."""
    first, second = by_time(readings, 500)
    undated = second.limit(3).withColumn("event_time", F.lit(None).cast("timestamp"))
    undated = undated.withColumn("reading_id", F.col("reading_id") + 10**6)
    keyless = second.limit(2).withColumn("room_id", F.lit(None).cast("string"))
    keyless = keyless.withColumn("reading_id", F.col("reading_id") + 2 * 10**6)
    late = first.limit(5).withColumn("event_time", F.expr("event_time - interval 91 seconds"))
    late = late.withColumn("reading_id", F.col("reading_id") + 3 * 10**6)
    parts = [first, second.unionByName(undated).unionByName(keyless), late, undated]
    got = in_batches(
        spark, parts, folder, lambda s: processors.room_baseline(s, forget_ms=50_000)
    )
    want = sum(p.count() for p in parts)
    assert got.count() == want
    aside = got.filter("late").select("reading_id")
    assert aside.filter("reading_id >= 1000000").count() == 3 + 2 + 5 + 3
    assert got.filter("late and seen is not null").count() == 0


def test_late_ids_are_not_lost_by_dedup(spark, folder):
    def at(*rows):
        made = spark.createDataFrame(list(rows), "reading_id int, s int")
        return made.select("reading_id", F.timestamp_seconds("s").alias("event_time"))

    parts = [at((1, 1000)), at((2, 1100)), at((3, 1009), (1, 1000)), at((4, 1200), (5, 1))]
    got = in_batches(spark, parts, folder, lambda s: jobs.dedup(s))
    assert sorted(r["reading_id"] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_watchdog_reports_every_silence(spark, folder):
    def at(*seconds):
        rows = [("d", float(s)) for s in seconds] + [(None, 1.0), ("d", None)]
        made = spark.createDataFrame(rows, "device_id string, s double")
        return made.select("device_id", F.timestamp_seconds("s").alias("event_time"))

    parts = [at(0, 1, 20), at(25, 26, 25.5), at(200), at(201)]
    got = in_batches(spark, parts, folder, lambda s: processors.watchdog(s))
    assert sorted(r["silent_since_ms"] for r in got.collect()) == [1000, 20000, 26000]


def test_dedup_over_batches(spark, readings, folder):
    slim = readings.select("reading_id", "event_time", "t_sec")
    first, second = by_time(slim, 500)
    again = first.filter("t_sec > 480").union(second)
    got = in_batches(spark, [first, again], folder, lambda s: jobs.dedup(s))
    assert got.count() == slim.count()


def test_enrichment_is_idempotent(spark, readings, folder):
    from hearthflow.plans.online import enrichment

    readings.write.parquet(f"{folder}/in")
    for run in ("a", "b"):
        source = jobs.file_stream(spark, f"{folder}/in", readings.schema)
        streams.enrichment_patch(
            enrichment(processors.room_baseline(source)), f"{folder}/patch",
            f"{folder}/progress-{run}", jobs.available_now(),
        ).awaitTermination()
    got = streams.patched(readings, f"{folder}/patch")
    assert got.count() == readings.count()
    assert got.filter("prediction is null").count() == 0
