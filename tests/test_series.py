"""Keys cut into chunks give the same rows as keys worked in one piece."""

import math

import pytest
from pyspark.sql import functions as F

from hearthflow.operators import alerts, timeline
from hearthflow.operators.folds import PersistenceWalk, chunk_starts
from hearthflow.operators.series import CHUNK, Series, over_series
from hearthflow.plans.calibrate import classify
from hearthflow.plans.online import decisions



def fire_state(d):
    v = F.col("value")
    state = F.when(v > 60, "FIRE").when(v > 30, "HIGH_RISK").otherwise("SAFE")
    return d.withColumn("fire_state", state)


def hit():
    return F.col("k") < 25


OPERATORS = {
    "history": lambda d, **k: timeline.history(d, **k),
    "rolling": lambda d, **k: timeline.rolling_features(d, **k),
    "rate_of_change": lambda d, **k: timeline.rate_of_change(d, **k),
    "calibrated_flag": lambda d, **k: timeline.calibrated_flag(d, **k),
    "edge_thermal": lambda d, **k: timeline.edge_thermal(d, **k),
    "confirm_hold": lambda d, **k: timeline.confirm_hold(fire_state(d), status="fire_state", **k),
    "persistence": lambda d, **k: timeline.persistence(d, threshold=950, **k),
    "persistence_cap": lambda d, **k: timeline.persistence(d, threshold=950, cap=4, **k),
    "debounce": lambda d, **k: timeline.debounce(d, hit(), **k),
    "fire_episodes": lambda d, **k: timeline.fire_episodes(d, hit(), **k),
    "alert_transition": lambda d, **k: timeline.alert_transition(fire_state(d), **k),
    "alert_rate_limit": lambda d, **k: alerts.rate_limit(fire_state(d), **k),
    "long_reminders": lambda d, **k: alerts.rate_limit(
        d.withColumn("fire_state", F.lit("FIRE")), **k
    ),
    "watchdog_gap": lambda d, **k: timeline.watchdog_gap(d, **k),
    "response_intervals": lambda d, **k: timeline.response_intervals(
        d, timeout_ms=20_000, fire=F.col("k") < 60, **k
    ),
    "sweep_segment": lambda d, **k: timeline.sweep_segment(d, **k),
    "classify": lambda d, **k: classify(d, **k),
}


def comparable(df):
    rows = []
    for r in df.select(*sorted(df.columns)).collect():
        rows.append(
            tuple(
                round(v, 7) if isinstance(v, float) and not math.isnan(v) else str(v) for v in r
            )
        )
    return sorted(rows, key=str)


# 1000 readings, about 50 per device and 100 per room: 17 rows cut every key, 80 only rooms.
@pytest.mark.parametrize("max_rows", [17, 55])
@pytest.mark.parametrize("name", list(OPERATORS))
def test_chunks_match_whole_keys(readings, name, max_rows):
    run = OPERATORS[name]
    assert comparable(run(readings, max_rows=max_rows)) == comparable(run(readings))


def test_one_key_holds_everything(readings):
    hot = readings.withColumns({"room_id": F.lit("A"), "device_id": F.lit("d")})
    for run in (OPERATORS["classify"], OPERATORS["history"], OPERATORS["sweep_segment"]):
        assert comparable(run(hot, max_rows=60)) == comparable(run(hot))


def test_equal_times_are_split_by_id(readings):
    same = readings.withColumns({"event_time": F.lit("2024-01-01").cast("timestamp")})
    run = OPERATORS["rate_of_change"]
    assert comparable(run(same, max_rows=20)) == comparable(run(same))


def test_chunks_are_small(readings):
    hot = readings.withColumn("room_id", F.lit("A"))
    seen = []

    def step(series: Series):
        if series.chunked:
            seen.extend(series.df.groupBy(CHUNK).count().collect())
        return series.df

    over_series(hot, "room_id", ("event_time", "reading_id"), step, max_rows=100).count()
    assert len(seen) >= 8
    assert max(r["count"] for r in seen) <= 300


def test_start_states_of_a_counter(readings):
    """Worked-out starts equal a plain loop."""
    hot = readings.withColumns({"room_id": F.lit("A"), "flame_hit": F.col("k") < 50})
    order = ("event_time", "reading_id")
    got = {}

    def step(series):
        if series.chunked:
            starts = chunk_starts(series, PersistenceWalk(cap=6))
            firsts = series.df.groupBy(CHUNK).agg(F.min("reading_id").alias("first")).collect()
            got.update({r["first"]: starts[("A",), r[CHUNK]] for r in firsts})
        return series.df

    over_series(hot, "room_id", order, step, max_rows=90)
    count, want = 0, {}
    for r in hot.orderBy(*order).select("reading_id", "flame_hit").collect():
        want[r["reading_id"]] = count
        count = min(count + 1, 6) if r["flame_hit"] else max(count - 1, 0)
    assert got and all(want[first] == start[0] for first, start in got.items())


def test_decisions_then_alerts_in_chunks(readings):
    whole = alerts.rate_limit(decisions(readings))
    cut = alerts.rate_limit(decisions(readings, max_rows=40), max_rows=15, sized_by=readings)
    keep = ("reading_id", "alert_kind", "fire_state")
    assert comparable(whole.select(*keep)) == comparable(cut.select(*keep))
