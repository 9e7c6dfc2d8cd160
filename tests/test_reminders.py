"""Reminders of a danger that lasts over many chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthflow.operators import alerts, reminders
from hearthflow.operators.folds import AlertWalk
from hearthflow.operators.series import CHUNK, Series

SECOND = 1_000_000


def series(spark, rows, per_chunk):
    """A chunked series of (device, at in microseconds, level) rows, several chunks in a task."""
    named = [(d, t, v, i, i // per_chunk) for i, (d, t, v) in enumerate(rows)]
    schema = f"device_id string, at_us bigint, alert_level int, reading_id bigint, {CHUNK} int"
    df = spark.createDataFrame(named, schema).repartitionByRange(4, CHUNK)
    df = df.sortWithinPartitions("device_id", "reading_id")
    return Series(df, ("device_id",), ("at_us", "reading_id"), len(rows), chunked=True)


def plain_starts(rows, per_chunk, wait):
    walk, state, device, out = AlertWalk(wait / SECOND), (0, 0), object(), {}
    for i, (d, t, v) in enumerate(rows):
        if d != device:
            device, state = d, (0, 0)
        if ((d,), i // per_chunk) not in out:
            out[(d,), i // per_chunk] = state
        state = walk.walk(state, [[t], [v]])[0]
    return out


def same(got, want):
    # the last alert matters in a danger only
    return {k: v if v[0] >= 2 else (v[0], 0) for k, v in got.items()} == {
        k: v if v[0] >= 2 else (v[0], 0) for k, v in want.items()
    }


def test_a_thousand_chunks_of_danger_take_ten_rounds(spark):
    rng, t, rows = random.Random(2), 0, []
    for _ in range(70_000):
        t += rng.choice([1, 1, 1, 2, 7]) * SECOND // 2
        rows.append(("d", t, 3))
    rounds = []
    got = reminders.alert_starts(series(spark, rows, 70), 60 * SECOND, rounds)
    assert len(got) == 1000 and len(rounds) <= 10
    assert got == plain_starts(rows, 70, 60 * SECOND)


@pytest.mark.parametrize("per_chunk", [3, 40, 100])
def test_many_devices_levels_and_short_chunks(spark, per_chunk):
    rng, rows = random.Random(per_chunk), []
    for d in ["a", "b", None]:
        t, level = 0, 0
        for _ in range(400):
            t += rng.choice([0, 1, 5, 30, 90]) * SECOND
            if rng.random() < 0.03:
                level = rng.choice([0, 1, 2, 3])
            rows.append((d, t, level))
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or ""))
    got = reminders.alert_starts(series(spark, rows, per_chunk), 60 * SECOND)
    assert same(got, plain_starts(rows, per_chunk, 60 * SECOND))


def test_equal_times_and_no_danger(spark):
    rows = [("a", 0, 3)] * 50 + [("a", 60 * SECOND, 3)] * 50 + [("b", 5, 0)] * 30
    got = reminders.alert_starts(series(spark, rows, 20), 60 * SECOND)
    assert same(got, plain_starts(rows, 20, 60 * SECOND))


def test_last_alerts():
    at = np.array([0, 10, 59, 60, 61, 119, 120, 300])
    assert reminders.last_alerts(at, 60).tolist() == [300] * 8
    assert reminders.last_alerts(at[:6], 60).tolist() == [60, 119, 119, 60, 61, 119]


def test_unknown_states_count_as_warnings(readings):
    state = F.when(F.col("k") < 30, "FIRE").when(F.col("k") < 60, "SAFE")
    given = readings.withColumn("fire_state", state)
    named = readings.withColumn("fire_state", F.coalesce(state, F.lit("WARNING")))
    key = ("reading_id", "alert_kind")
    whole = alerts.rate_limit(given).select(*key)
    assert whole.exceptAll(alerts.rate_limit(named).select(*key)).count() == 0
    cut = alerts.rate_limit(given, max_rows=15).select(*key)
    assert whole.exceptAll(cut).count() == 0
