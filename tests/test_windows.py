"""Rings of rows on streams against the batch windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import by_time, folder, in_batches  # noqa: F401

from hearthflow.operators import timeline
from hearthflow.streaming import windows

HISTORY = ["history_rows", "temperature_mean", "temperature_min", "gas_raw_max"]
ROLLING = ["temperature_mean", "temperature_std", "gas_raw_std", "flame_raw_z", "fusion_confidence"]


def close(got, want, names):
    got = {r["reading_id"]: r for r in got.select("reading_id", *names).collect()}
    want = {r["reading_id"]: r for r in want.select("reading_id", *names).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        for n in names:
            assert got[i][n] == (None if row[n] is None else pytest.approx(row[n], abs=1e-9)), (i, n)


def test_history_over_four_batches(spark, readings, folder):  # noqa: F811
    some = readings.withColumn("temperature", F.when(F.col("k") > 5, F.col("temperature")))
    got = in_batches(spark, by_time(some, 100, 101, 700), folder, windows.history)
    assert got.filter("late").count() == 0
    close(got, timeline.history(some), HISTORY)


def test_rolling_features_over_two_batches(spark, readings, folder):  # noqa: F811
    one = readings.withColumn("device_id", F.lit("d"))
    got = in_batches(spark, by_time(one, 400), folder, windows.rolling_features)
    close(got, timeline.rolling_features(one), ROLLING)


def test_late_rows_and_rows_without_time_leave_the_ring_alone(spark, readings, folder):  # noqa: F811
    first, second = by_time(readings, 500)
    odd = first.limit(7).unionByName(
        readings.limit(3).withColumn("event_time", F.lit(None).cast("timestamp"))
    )
    got = in_batches(spark, [first, odd.unionByName(second)], folder, windows.history)
    assert got.filter("late").count() == 10 and got.count() == readings.count() + 10
    close(got.filter("not late"), timeline.history(readings), HISTORY)


class Ring:
    def __init__(self):
        self.rows, self.value = [], None

    def get(self):
        return iter(self.rows) if self.value is None else self.value

    def put(self, rows):
        self.rows = list(rows)

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value


def test_state_is_bounded_and_a_long_stream_does_not_drift():
    import pandas as pd

    p = windows.RingProcessor(
        50, ["x"], ["at_us"], windows.spread_summary, ["x_mean", "x_std"]
    )
    p.ring, p.newest = Ring(), Ring()
    rng = np.random.default_rng(1)
    x = 1e9 + rng.normal(size=1_000_000)
    out = []
    for lo in range(0, len(x), 70_000):
        part = pd.DataFrame({"at_us": np.arange(lo, min(lo + 70_000, len(x))), "x": x[lo : lo + 70_000]})
        out += list(p.handleInputRows(("d",), iter([part]), None))
        assert len(p.ring.rows) <= 49
    got = pd.concat(out)
    for i in (0, 1, 48, 49, 50, 69_999, 70_000, 500_000, 999_999):
        window = x[max(0, i - 49) : i + 1]
        assert got["x_mean"].iloc[i] == pytest.approx(window.mean(), abs=1e-6)
        if i:
            assert got["x_std"].iloc[i] == pytest.approx(window.std(ddof=1), abs=1e-9)
