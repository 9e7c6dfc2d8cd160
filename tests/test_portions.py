"""A micro-batch of one key is taken portion by portion, however many rows it has."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthflow.operators.folds import AlertWalk
from hearthflow.plans.calibrate import classify
from hearthflow.session import staging_path
from hearthflow.streaming import jobs, processors, windows


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def update(self, value):
        self.value = value

    put = update


class Handle:
    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        pass


def portions(taken, n=6, rows=100):
    for i in range(n):
        taken.append(i)
        at = np.arange(i * rows, (i + 1) * rows, dtype="int64") * 2_000_000
        yield pd.DataFrame({"at_us": at, "at_ms": at // 1000, "alert_level": at // 2_000_000 % 4, "x": at / 1e6})


def made(kind):
    if kind == "walk":
        p = processors.WalkProcessor(AlertWalk(60.0))
        p.state = Value()
    elif kind == "ring":
        p = windows.RingProcessor(50, ["x"], ["at_us"], windows.history_summary, ["history_rows", "x_mean"])
        p.ring, p.newest = Value(), Value()
    else:
        p = processors.WatchdogProcessor(1500)
        p.last, p.handle = Value(), Handle()
    return p


@pytest.mark.parametrize("kind", ["walk", "ring", "watchdog"])
def test_a_portion_is_done_before_the_next_is_read(kind):
    taken, seen = [], []
    out = []
    for part in made(kind).handleInputRows(("a",), portions(taken), None):
        seen.append(len(taken))
        out.append(part)
    assert seen == [1, 2, 3, 4, 5, 6]
    whole = pd.concat(portions([]), ignore_index=True)
    want = pd.concat(list(made(kind).handleInputRows(("a",), iter([whole]), None)))
    got = pd.concat(out)
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True))


def test_rows_out_of_order_are_an_error():
    parts = list(portions([]))[::-1]
    with pytest.raises(RuntimeError, match="out of order"):
        list(made("walk").handleInputRows(("a",), iter(parts), None))


def test_rows_that_arrive_in_any_order_are_sorted(spark, readings):
    jobs.use_state_store(spark)
    base = staging_path(spark, "shuffled")
    readings.repartition(3, F.md5(F.col("reading_id").cast("string"))).write.parquet(f"{base}/in")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = jobs.drain(processors.room_baseline(jobs.file_stream(spark, f"{base}/in", readings.schema)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    keep = ("reading_id", "verdict", "temp_mean", "gas_z", "seen")
    want = classify(readings).select(*keep)
    assert got.filter("late").count() == 0 and got.count() == want.count()
    assert got.select(*keep).exceptAll(want).count() == 0
