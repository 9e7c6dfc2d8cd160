"""Projections and filters that turn raw records into canonical readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, clamp, known, lenient_double
from ..schema import (
    ALIASES,
    BASELINE_DEFAULTS,
    BOUNDS,
    CRITICAL_COLUMNS,
    FEATURES,
    LABEL_COLUMNS,
    LABELS,
    NUMERIC_COLUMNS,
)


def alias_normalise(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rename every known dialect to the canonical names and fill defaults.

    Columns that no alias claims are kept. A record may mix dialects: the first
    non-null alias wins.
    """
    defaults = defaults or {}
    present = set(df.columns)
    claimed: set[str] = set()
    out = []
    for name, names in aliases.items():
        found = [F.col(n) for n in names if n in present]
        claimed.update(n for n in names if n in present)
        if name in defaults:
            found.append(F.lit(defaults[name]))
        if found:
            out.append(F.coalesce(*found).alias(name))
    rest = [F.col(c) for c in df.columns if c not in claimed]
    return df.select(*out, *rest)


def numeric_coerce(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: lenient_double(c) for c in cols if c in df.columns})


def drop_empty(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def critical_present(df: DataFrame, subset: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    return df.dropna(subset=[c for c in subset if c in df.columns])


def clamp_bounds(df: DataFrame, bounds: Mapping[str, tuple] = BOUNDS) -> DataFrame:
    """Clamp to the sanity bounds; `was_clamped` tells whether any channel moved."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    moved = F.lit(False)
    for c, (low, high) in present.items():
        moved = moved | F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
    return df.withColumns(
        {"was_clamped": moved, **{c: clamp(c, low, high) for c, (low, high) in present.items()}}
    )


def room_default(df: DataFrame, fallback: str = "ROOM_1") -> DataFrame:
    found = [F.col(c) for c in ("room_id", "device_id") if c in df.columns]
    return df.withColumn("room_id", F.coalesce(*found, F.lit(fallback)))


def validity_flag(
    df: DataFrame, temperature=(-40, 85), humidity=(0, 100), adc=(0, 32767)
) -> DataFrame:
    """Add `sensors_valid`; the channels of a group that fails its check read 0."""
    pressure = known("pressure").isNotNull() if "pressure" in df.columns else F.lit(True)
    air = F.coalesce(
        known("temperature").between(*temperature)
        & known("humidity").between(*humidity)
        & pressure,
        F.lit(False),
    )
    light = F.coalesce(
        F.col("flame_raw").between(*adc) & F.col("gas_raw").between(*adc), F.lit(False)
    )
    groups = {
        "temperature": air, "humidity": air, "pressure": air,
        "flame_raw": light, "gas_raw": light, "flame_voltage": light, "gas_voltage": light,
    }
    return df.withColumns(
        {
            "sensors_valid": air & light,
            **{
                c: F.when(ok, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType))
                for c, ok in groups.items()
                if c in df.columns
            },
        }
    )


def valid_reading(df: DataFrame) -> DataFrame:
    return df.filter(known("temperature").isNotNull() & known("humidity").isNotNull())


def adc_to_volts(raw: Column | str, lsb=0.000125, divider=0.6) -> Column:
    return as_col(raw) * F.lit(lsb) / F.lit(divider)


def adc_rescale(raw: Column | str, shift=2) -> Column:
    return F.shiftright(as_col(raw).try_cast("int"), shift)


def event_time(df: DataFrame, source: str = "timestamp", min_epoch: int = 1_700_000_000):
    """`event_time` from ISO text; all-digit text is uptime in ms, and times before
    `min_epoch` come from a clock that was never set."""
    text = F.trim(F.col(source))
    digits = text.rlike(r"^\d+$")
    parsed = F.when(~digits, F.try_to_timestamp(text))
    return df.withColumns(
        {
            "event_time": F.when(F.unix_seconds(parsed) >= min_epoch, parsed),
            "uptime_ms": F.when(digits, text.try_cast("bigint")),
        }
    )


def split_undated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings with a time, readings without one): ordered work needs a time, and a
    made-up one would corrupt rates, so undated readings are kept apart."""
    return df.filter("event_time is not null"), df.filter("event_time is null")


def pending_inference(df: DataFrame, pending: str = "PENDING_INFERENCE") -> DataFrame:
    done = F.col("ml_prediction")
    return df.filter(done.isNull() | done.isin("", pending))


def device_doc(df: DataFrame) -> DataFrame:
    """Latest-state document of a device, one nested row per decision."""
    return df.select(
        F.col("device_id").alias("id"),
        F.concat(F.col("room_id"), F.lit(" Fire Node")).alias("name"),
        F.col("room_id").alias("room"),
        "event_time",
        "reading_id",
        F.col("flame_raw").alias("flameRaw"),
        F.col("temperature").alias("tempC"),
        "humidity",
        F.col("gas_raw").alias("gasRaw"),
        F.col("servo_angle").alias("fireAngle"),
        F.col("risk_score").alias("riskScore"),
        F.col("fire_state").alias("fireState"),
        F.col("response_status").alias("responseStatus"),
        F.col("room_baseline_temp").alias("roomBaselineTemp"),
        F.col("delta_temp_from_baseline").alias("deltaTemp"),
        F.col("temp_rate_of_change_c_per_sec").alias("tempRateOfChange"),
        F.col("ai_classification_verdict").alias("aiClassificationVerdict"),
        F.col("suppression_reason").alias("suppressionReason"),
        F.struct(
            F.col("ml_active").alias("mlActive"),
            F.col("ml_prediction").alias("mlPrediction"),
            F.col("fusion_confidence").alias("fusionConfidence"),
            F.col("baseline_calibrated").alias("baselineCalibrated"),
        ).alias("aiMetadata"),
    )


def label_map(label: Column | str, labels: Mapping[str, int] = LABELS) -> Column:
    """Training class of a verdict text; unknown text counts as class 0."""
    text = F.upper(as_col(label).cast("string"))
    by_class: dict[int, list[str]] = {}
    for name, number in labels.items():
        by_class.setdefault(number, []).append(name)
    out = F
    for number, names in by_class.items():
        if number:
            out = out.when(text.isin(*names), F.lit(number))
    return out.otherwise(F.lit(0))


def label_column(columns: Sequence[str], order: Sequence[str] = LABEL_COLUMNS) -> str:
    for name in order:
        if name in columns:
            return name
    raise ValueError(f"no label column, expected one of {', '.join(order)}")


def present_features(columns: Sequence[str]) -> list[str]:
    return [f for f in FEATURES if f in columns]


def feature_columns(df: DataFrame) -> DataFrame:
    """The calibrated features that exist, missing values as 0.0."""
    return df.withColumns(
        {
            f: F.coalesce(known(F.col(f).cast("double")), F.lit(0.0))
            for f in present_features(df.columns)
        }
    )


def baseline_inputs(df: DataFrame) -> DataFrame:
    """Fill channels that are missing or NaN before they reach the room baseline."""
    out = {}
    for name, default in BASELINE_DEFAULTS.items():
        kind = "int" if name == "flame_digital" else "double"
        if name in df.columns:
            value = known(F.col(name).cast("double")).try_cast(kind)
            out[name] = F.coalesce(value, F.lit(default).cast(kind))
        else:
            out[name] = F.lit(default).cast(kind)
    return df.withColumns(out)


def aim_angle(angle: Column | str, low=5, high=175, offset=0, reverse=False) -> Column:
    shown = clamp(as_col(angle), 0, 180)
    turned = F.lit(180) - shown if reverse else shown
    return clamp(turned + F.lit(offset), low, high)


def clean(df: DataFrame) -> DataFrame:
    """The whole cleaning step: names, numbers, empty and incomplete rows, bounds, room."""
    named = alias_normalise(drop_empty(df))
    return room_default(clamp_bounds(critical_present(numeric_coerce(named))))


def flagged(raw: DataFrame) -> DataFrame:
    """Raw rows with the cleaning step's findings as columns instead of dropped rows."""
    empty = F.lit(True)
    for c in raw.columns:
        empty = empty & F.col(c).isNull()
    named = alias_normalise(raw.withColumn("empty", empty))
    number = numeric_coerce(named)
    complete = F.lit(True)
    for c in CRITICAL_COLUMNS:
        if c in number.columns:
            complete = complete & F.col(c).isNotNull()
    return room_default(clamp_bounds(number.withColumn("complete", complete)))
