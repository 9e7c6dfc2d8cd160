"""Operators over the ordered readings of a room or a device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, micros, seconds_between
from ..schema import DANGER
from .folds import EdgeThermalWalk, PersistenceWalk, walk_series
from .rules import thermal_risk, thermal_status
from .series import Series, over_series

ORDER = ("event_time", "reading_id")


def history(
    df: DataFrame,
    rows: int = 50,
    key: str = "device_id",
    channels: Sequence[str] = ("temperature", "gas_raw"),
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Summary of the last `rows` readings of the device, this one included."""

    def step(s: Series) -> DataFrame:
        def build(d, w):
            frame = w.rowsBetween(-(rows - 1), 0)
            out = {"history_rows": F.count("*").over(frame)}
            for c in channels:
                out[f"{c}_mean"] = F.avg(c).over(frame)
                out[f"{c}_min"] = F.min(c).over(frame)
                out[f"{c}_max"] = F.max(c).over(frame)
            return d.withColumns(out)

        return s.bounded(build, before=rows - 1).df

    return over_series(df, key, order, step, **limits)


def rolling_features(
    df: DataFrame,
    rows: int = 50,
    z: float = 3.0,
    key: str = "device_id",
    channels: Sequence[str] = ("temperature", "gas_raw", "flame_raw", "humidity"),
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Rolling mean, sample deviation, z-score and anomaly flag per channel, and the
    share of channels that are anomalous (`fusion_confidence`)."""

    def step(s: Series) -> DataFrame:
        def build(d, w):
            frame = w.rowsBetween(-(rows - 1), 0)
            return d.withColumns(
                {f"{c}_mean": F.avg(c).over(frame) for c in channels}
                | {f"{c}_std": F.stddev_samp(c).over(frame) for c in channels}
            )

        return s.bounded(build, before=rows - 1).df

    return anomalies(over_series(df, key, order, step, **limits), channels, z)


def anomalies(out: DataFrame, channels: Sequence[str], z: float = 3.0) -> DataFrame:
    """z-score and flag of each channel from its mean and deviation, and `fusion_confidence`."""
    out = out.withColumns(
        {
            f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_std"), F.lit(0.0))
            for c in channels
        }
    )
    out = out.withColumns(
        {f"{c}_anomaly": F.coalesce(F.abs(f"{c}_z") > z, F.lit(False)) for c in channels}
    )
    hits = sum((F.col(f"{c}_anomaly").cast("int") for c in channels), F.lit(0))
    return out.withColumn("fusion_confidence", hits / F.lit(float(len(channels))))


def rate_of_change(
    df: DataFrame,
    low: float = 0.1,
    high: float = 30.0,
    fallback: float = 1.0,
    key: str = "room_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Change per second since the previous reading of the room; gaps that are not
    trusted count as `fallback` seconds, the first reading as no change."""

    def step(s: Series) -> DataFrame:
        def build(d, w):
            gap = seconds_between("event_time", F.lag("event_time").over(w))
            d = d.withColumn(
                "gap_seconds", F.when(gap.between(low, high), gap).otherwise(F.lit(fallback))
            )
            rates = {
                name: F.coalesce(
                    (F.col(c) - F.lag(c).over(w)) / F.col("gap_seconds"), F.lit(0.0)
                )
                for name, c in (
                    ("temp_rate", "temperature"),
                    ("gas_rate", "gas_raw"),
                    ("flame_rate", "flame_voltage"),
                )
            }
            return d.withColumns(rates)

        return s.bounded(build, before=1).df

    return over_series(df, key, order, step, **limits)


def calibrated_flag(
    df: DataFrame,
    min_samples: int = 15,
    key: str = "room_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    def step(s: Series) -> DataFrame:
        def build(d, w):
            seen = F.count("*").over(w.rowsBetween(-(min_samples - 1), 0))
            return d.withColumn("calibrated", seen >= min_samples)

        return s.bounded(build, before=min_samples - 1).df

    return over_series(df, key, order, step, **limits)


def edge_thermal(
    df: DataFrame,
    fast: float = 0.25,
    slow: float = 0.02,
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Fast average, rate per minute, slow baseline and deviation of the temperature."""
    df = df.withColumn("at_us", micros("event_time"))

    def step(s: Series) -> DataFrame:
        return walk_series(s, EdgeThermalWalk(fast, slow))

    out = over_series(df, key, order, step, **limits).drop("at_us")
    return out.withColumns(
        {
            "deviation": F.col("ema") - F.col("slow_baseline"),
            "status": thermal_status("ema", "rate_per_min"),
            "thermal_risk": thermal_risk("ema", "rate_per_min"),
        }
    )


def confirm_hold(
    df: DataFrame,
    hold_seconds: float = 10.0,
    status: str = "status",
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """A status other than SAFE counts once it has held for `hold_seconds`."""

    def step(s: Series) -> DataFrame:
        s = s.bounded(
            lambda d, w: d.withColumn(
                "_since",
                F.when(
                    F.col(status) != F.lag(status, 1, "SAFE").over(w), F.col("event_time")
                ),
            ),
            before=1,
        )
        return s.running(_held_from=("last", F.col("_since"))).df

    out = over_series(df, key, order, step, **limits)
    held = seconds_between("event_time", "_held_from") >= hold_seconds
    confirmed = (F.col(status) == "SAFE") | F.coalesce(held, F.lit(False))
    return out.withColumns(
        {
            "confirmed": confirmed,
            "reported": F.when(confirmed, F.col(status)).otherwise(F.lit("SAFE")),
        }
    ).drop("_since", "_held_from")


def persistence(
    df: DataFrame,
    threshold: int = 400,
    required: int = 3,
    cap: int = 255,
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Counter of readings at or below the flame threshold against readings above it."""
    df = df.withColumn("flame_hit", F.coalesce(F.col("flame_raw") <= threshold, F.lit(False)))

    def step(s: Series) -> DataFrame:
        return walk_series(s, PersistenceWalk(cap))

    out = over_series(df, key, order, step, **limits).drop("flame_hit")
    return out.withColumn("flame_confirmed", F.col("persistence") >= required)


def debounce(
    df: DataFrame,
    flag: Column | str = "flag",
    need: int = 2,
    of: int = 3,
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """`detected` when at least `need` of the last `of` readings carry the flag."""
    df = df.withColumn("_flag", F.coalesce(as_col(flag).cast("int"), F.lit(0)))

    def step(s: Series) -> DataFrame:
        def build(d, w):
            hits = F.sum("_flag").over(w.rowsBetween(-(of - 1), 0))
            return d.withColumn("detected", hits >= need)

        return s.bounded(build, before=of - 1).df

    return over_series(df, key, order, step, **limits).drop("_flag")


def fire_episodes(
    df: DataFrame,
    hit: Column | str = "detected",
    angle: str = "servo_angle",
    misses: int = 2,
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """One row per latched detection: from the first hit until `misses` misses in a row."""
    df = df.select(key, *order, angle, as_col(hit).cast("boolean").alias("_hit"))

    def step(s: Series) -> DataFrame:
        def marks(d, w):
            recent = F.max(F.col("_hit").cast("int")).over(w.rowsBetween(-(misses - 1), 0))
            return d.withColumn("_mark", F.when(F.col("_hit"), 1).when(recent == 0, 0))

        def starts(d, w):
            begun = (F.col("_latched") == 1) & (F.lag("_latched", 1, 0).over(w) == 0)
            return d.withColumn("_begun", begun.cast("int"))

        s = s.bounded(marks, before=misses - 1).running(_mark_held=("last", F.col("_mark")))
        s = s.with_df(s.df.withColumn("_latched", F.coalesce("_mark_held", F.lit(0))))
        s = s.bounded(starts, before=1).running(episode=("sum", F.col("_begun")))
        return s.df.filter("_latched = 1")

    latched = over_series(df, key, order, step, **limits)
    when_ = F.struct(*order)
    return latched.groupBy(key, "episode").agg(
        F.min(order[0]).alias("started"),
        F.max(order[0]).alias("ended"),
        F.min_by(angle, when_).alias("angle"),
        F.count("*").alias("rows"),
    )


def alert_transition(
    df: DataFrame,
    state: str = "fire_state",
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """`alert_kind` for a change into danger or an all-clear; null where there is none."""

    def step(s: Series) -> DataFrame:
        def build(d, w):
            now, before = F.col(state), F.lag(state, 1, "SAFE").over(w)
            return d.withColumn(
                "alert_kind",
                F.when(now.isin(*DANGER) & (now != before), F.lit("TRANSITION")).when(
                    (now == "SAFE") & before.isin(*DANGER), F.lit("ALL_CLEAR")
                ),
            )

        return s.bounded(build, before=1).df

    return over_series(df, key, order, step, **limits)


def watchdog_gap(
    df: DataFrame,
    timeout_ms: int = 1500,
    at: str = "event_time",
    key: str = "device_id",
    order: Sequence[str] = ("reading_id",),
    **limits,
) -> DataFrame:
    """Silence after each packet in arrival order; a clock that steps back is no timeout."""

    def step(s: Series) -> DataFrame:
        def build(d, w):
            gap = F.floor((micros(F.lead(at).over(w)) - micros(at)) / 1000)
            return d.withColumn("gap_ms", gap)

        return s.bounded(build, after=1).df

    out = over_series(df, key, order, step, **limits)
    return out.withColumn("timed_out", F.coalesce(F.col("gap_ms") > timeout_ms, F.lit(False)))


def response_intervals(
    df: DataFrame,
    timeout_ms: int = 1500,
    fire: Column | str = "fire",
    at: str = "event_time",
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Times the actuator was on: from a fire packet to a clear packet or a timeout."""
    limit = timeout_ms * 1000
    df = df.select(key, *order, micros(at).alias("_at"), as_col(fire).alias("_on"))

    def step(s: Series) -> DataFrame:
        def build(d, w):
            after, before = F.lead("_at").over(w), F.lag("_at").over(w)
            follows = F.coalesce(
                F.lag("_on").over(w) & (F.col("_at") - before <= limit), F.lit(False)
            )
            in_time = F.coalesce(after - F.col("_at") <= limit, F.lit(False))
            return d.withColumns(
                {
                    "_begun": (F.col("_on") & ~follows).cast("int"),
                    "_until": F.when(in_time, after).otherwise(F.col("_at") + limit),
                    "_why": F.when(
                        in_time, F.when(~F.lead("_on").over(w), F.lit("CLEARED"))
                    ).otherwise(F.lit("TIMEOUT")),
                }
            )

        s = s.bounded(build, before=1, after=1).running(interval=("sum", F.col("_begun")))
        return s.df.filter("_on")

    on = over_series(df, key, order, step, **limits)
    return on.groupBy(key, "interval").agg(
        F.timestamp_micros(F.min("_at")).alias("started"),
        F.timestamp_micros(F.max("_until")).alias("ended"),
        F.max_by("_why", F.struct("_at", *order)).alias("reason"),
        F.count("*").alias("packets"),
    )


def sweep_segment(
    df: DataFrame,
    angle: str = "servo_angle",
    key: str = "device_id",
    order: Sequence[str] = ORDER,
    **limits,
) -> DataFrame:
    """Number the sweep passes of a scanner: a pass ends where the angle turns back."""

    def step(s: Series) -> DataFrame:
        def direction(d, w):
            moved = F.signum(F.col(angle) - F.lag(angle).over(w))
            return d.withColumn("_moved", F.when(moved != 0, moved))

        def turns(d, w):
            turned = F.col("_moved") != F.lag("_heading").over(w)
            return d.withColumn("_turned", F.coalesce(turned, F.lit(False)).cast("int"))

        s = s.bounded(direction, before=1).running(_heading=("last", F.col("_moved")))
        s = s.bounded(turns, before=1).running(sweep_id=("sum", F.col("_turned")))
        return s.df

    return over_series(df, key, order, step, **limits).drop("_moved", "_heading", "_turned")


def sorted_by_time(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Chronological order with unknown times last and ties settled."""
    return df.orderBy(F.col(order[0]).asc_nulls_last(), *order[1:])


def latest_rows(df: DataFrame, rows: int, key: str, order: Sequence[Column]) -> DataFrame:
    """Last `rows` readings per key; each task keeps at most that many before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows)
