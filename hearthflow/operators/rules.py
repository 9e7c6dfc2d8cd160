"""Rule classification as Column expressions; every threshold is a parameter or a
fixed value of the rule it belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, clamp, one_decimal
from ..schema import DANGER


def warm(uptime_ms: Column | str = "uptime_ms", warmup_ms: int = 60_000) -> Column:
    return F.coalesce(as_col(uptime_ms) > warmup_ms, F.lit(False))


def edge_state(
    df: DataFrame, flame_limit: int = 8000, gas_warning: int = 12000, gas_prefire: int = 18000
) -> DataFrame:
    """Edge state and risk from the digital flame pin, the flame level and warm gas."""
    lit = F.col("flame_digital") == 1
    gas_counts = F.col("warm") & F.col("sensors_valid")
    steps = [
        (lit & (F.col("flame_raw") < flame_limit), "CRITICAL", 98.0),
        (lit, "FIRE", 90.0),
        (gas_counts & (F.col("gas_raw") > gas_prefire), "PRE_FIRE", 65.0),
        (gas_counts & (F.col("gas_raw") > gas_warning), "WARNING", 35.0),
    ]
    return df.withColumns(
        {
            "edge_state": _first(steps, 1, "NORMAL"),
            "edge_risk": _first(steps, 2, 5.0),
        }
    )


def _first(steps: Sequence[tuple], field: int, default) -> Column:
    out = F
    for step in steps:
        out = out.when(step[0], F.lit(step[field]))
    return out.otherwise(F.lit(default))


def thermal_status(
    temperature: Column | str,
    rate_per_min: Column | str,
    temps=(40.0, 55.0, 70.0),
    rates=(3.0, 8.0, 15.0),
) -> Column:
    t, r = as_col(temperature), as_col(rate_per_min)
    steps = [
        ((t >= temps[i]) | (r >= rates[i]), state)
        for i, state in ((2, "FIRE"), (1, "HIGH_RISK"), (0, "WARNING"))
    ]
    return _first(steps, 1, "SAFE")


def thermal_risk(
    temperature: Column | str,
    rate_per_min: Column | str,
    ambient=25.0,
    span=45.0,
    level_points=60.0,
    trend_points=40.0,
    full_rate=15.0,
) -> Column:
    level = clamp((as_col(temperature) - ambient) / span * level_points, 0.0, level_points)
    trend = clamp(as_col(rate_per_min) / full_rate * trend_points, 0.0, trend_points)
    return clamp(level + trend, 0.0, 100.0).cast("int")


def flame_risk(
    flame_raw: Column | str, persistence: Column | str, threshold=400, max_persistence=3
) -> Column:
    raw = as_col(flame_raw).try_cast("bigint")
    held = as_col(persistence).try_cast("bigint")
    depth = F.floor((F.lit(threshold) - raw) * 30 / F.lit(max(threshold, 1)))
    hold = F.floor(held * 20 / F.lit(max(max_persistence, 1)))
    return (
        F.when(raw > threshold, F.when(raw > 800, F.lit(5)).otherwise(F.lit(15)))
        .otherwise(F.least(F.lit(50) + depth + hold, F.lit(100)))
        .cast("int")
    )


# The thresholds of a fire or pre-fire verdict, which also hold the room profile still.
FLAME_VOLTS = 1.6
FIRE_RATE, FIRE_RISE, FIRE_GAS_Z = 0.4, 4.5, 3.0
PRE_FIRE_GAS_Z, PRE_FIRE_RISE, PRE_FIRE_RATE = 3.5, 2.0, 0.1


def fusion_verdict(df: DataFrame) -> DataFrame:
    """Verdict, risk, fire flag and suppression reason from the walked room baseline.

    Needs the outputs of folds.RoomBaselineWalk; deviations are against the profile as it
    stood before the reading.
    """
    temp, rate = F.col("temperature"), F.col("temp_rate")
    rise = temp - F.col("temp_mean_before")
    temp_z = rise / F.col("temp_std_before")
    gas_z = (F.col("gas_raw") - F.col("gas_mean_before")) / F.col("gas_std_before")
    damp = F.col("humidity") - F.col("humidity_mean_before")
    flame = (F.col("flame_digital") == 1) | (F.col("flame_voltage") < FLAME_VOLTS)
    df = df.withColumns(
        {
            "temp_delta": rise,
            "gas_delta": F.col("gas_raw") - F.col("gas_mean_before"),
            "humidity_delta": damp,
            "temp_z": temp_z,
            "gas_z": gas_z,
            "flame_seen": flame,
        }
    )
    rise, temp_z, gas_z = F.col("temp_delta"), F.col("temp_z"), F.col("gas_z")
    damp, flame = F.col("humidity_delta"), F.col("flame_seen")
    calm_risk = clamp(temp_z * 5.0 + gas_z * 3.0, 0.0, 30.0)
    # (condition, verdict, risk), fixed values; the first that holds decides.
    chain = [
        (flame & ((rise > 2.0) | (rate > 0.15) | (gas_z > 2.0)), "ACTUAL_FIRE", 98.0),
        (flame, "ACTUAL_FIRE", 92.0),
        ((rate > FIRE_RATE) & (rise > FIRE_RISE) & (gas_z > FIRE_GAS_Z), "ACTUAL_FIRE", 88.0),
        ((temp > 28.0) & (gas_z < 2.0) & (F.abs(rate) < 0.08), "NORMAL_SUNNY_DAY", 5.0),
        ((damp > 15.0) & (gas_z < 1.5), "FALSE_ALARM_STEAM", 12.0),
        (
            (gas_z > 2.5) & (rise < 1.5) & (rate <= 0.05),
            "FALSE_ALARM_COOKING_GAS",
            25.0,
        ),
        (
            (gas_z > PRE_FIRE_GAS_Z) & ((rise > PRE_FIRE_RISE) | (rate > PRE_FIRE_RATE)),
            "PRE_FIRE_WARNING",
            65.0,
        ),
    ]
    risk = F
    for condition, _, points in chain:
        risk = risk.when(condition, F.lit(points))
    return df.withColumns(
        {"verdict": _first(chain, 1, "NORMAL"), "verdict_risk": risk.otherwise(calm_risk)}
    ).withColumns(
        {
            "verdict_fire": F.col("verdict") == "ACTUAL_FIRE",
            "suppression_reason": suppression_reason(),
        }
    )


def suppression_reason() -> Column:
    # The wording of the three suppression texts.
    sunny = F.concat(
        F.lit("High ambient temp ("), one_decimal("temperature"),
        F.lit("°C) matches dynamic room baseline ("), one_decimal("temp_mean_before"),
        F.lit("°C); zero flame/smoke."),
    )
    steam = F.concat(
        F.lit("Humidity surge (+"), one_decimal("humidity_delta"),
        F.lit("%) with zero optical flame or hazardous gas. Classified as benign steam."),
    )
    cooking = F.concat(
        F.lit("Gas spike (Z="), one_decimal("gas_z"),
        F.lit(") without thermal rise or IR flame. Local cooking aerosol."),
    )
    verdict = F.col("verdict")
    return (
        F.when(verdict == "NORMAL_SUNNY_DAY", sunny)
        .when(verdict == "FALSE_ALARM_STEAM", steam)
        .when(verdict == "FALSE_ALARM_COOKING_GAS", cooking)
        .otherwise(F.lit(""))
    )


def decision_fusion(
    df: DataFrame, state: str = "state", risk: str = "risk", digital: str = "flame_digital"
) -> DataFrame:
    """Fuse the model's state with the verdict; adds `fire_state` and `risk_score`."""
    s, r, verdict = F.col(state), F.col(risk), F.col("verdict")
    sunny = verdict == "NORMAL_SUNNY_DAY"
    benign = verdict.startswith("FALSE_ALARM")
    fire = F.col("verdict_fire")
    df = df.withColumns(
        {
            "_s": F.when(sunny, F.lit("SAFE"))
            .when(benign, F.when(s == "FIRE", s).otherwise(F.lit("SAFE")))
            .when(fire, F.lit("FIRE"))
            .otherwise(s),
            "_r": F.when(sunny, F.least(r, F.lit(10.0)))
            .when(benign, F.when(s == "FIRE", r).otherwise(F.least(r, F.lit(20.0))))
            .when(fire, F.greatest(r, F.lit(95.0)))
            .otherwise(r),
        }
    )
    pin = (F.col(digital) == 1) & F.col("_s").isin("SAFE", "WARNING")
    return df.withColumns(
        {
            "fire_state": F.when(pin, F.lit("FIRE")).otherwise(F.col("_s")),
            "risk_score": F.when(pin, F.greatest("_r", F.lit(90.0))).otherwise(F.col("_r")),
        }
    ).drop("_s", "_r")


def response_status(fire_state: Column | str = "fire_state") -> Column:
    return F.when(as_col(fire_state).isin(*DANGER), F.lit("ACTIVE")).otherwise(F.lit("IDLE"))


def prediction_fallback(
    df: DataFrame, prediction="ml_prediction", probabilities="probabilities"
) -> DataFrame:
    """Model answer where there is one, else the verdict and a fixed confidence."""
    guess = F.when(F.col("fire_state") == "FIRE", F.lit(0.95)).otherwise(F.lit(0.05))
    return df.withColumns(
        {
            "prediction": F.coalesce(F.nullif(F.col(prediction), F.lit("")), F.col("verdict")),
            "confidence": F.coalesce(F.try_element_at(probabilities, F.lit("FIRE")), guess),
        }
    )


def local_alarm(df: DataFrame, status="status", confirmed="confirmed") -> DataFrame:
    s = F.col(status)
    alarm = s.isin(*DANGER)
    return df.withColumns(
        {
            "alarm": alarm,
            "tone_hz": F.when(alarm, F.when(s == "FIRE", F.lit(1800)).otherwise(F.lit(1100))),
            "display": F.concat(
                s, F.when(F.col(confirmed), F.lit("")).otherwise(F.lit(" (checking)"))
            ),
        }
    )


def risk_band(risk: Column | str, amber=50, red=80) -> Column:
    r = as_col(risk)
    return F.when(r > red, F.lit("red")).when(r > amber, F.lit("amber")).otherwise(F.lit("green"))


def hybrid_risk(
    df: DataFrame, fire_probability: Column | None = None, bands=(30, 50, 80)
) -> DataFrame:
    """Stand-in for the missing hybrid engine: the strongest of its signals, banded.

    Needs `thermal_risk` and `flame_risk`; adds `risk` and `state`.
    """
    signals = [F.col("thermal_risk").cast("double"), F.col("flame_risk").cast("double")]
    if fire_probability is not None:
        signals.append(F.lit(100.0) * F.coalesce(fire_probability, F.lit(0.0)))
    r = F.col("risk")
    return df.withColumn("risk", F.greatest(*signals)).withColumn(
        "state",
        F.when(r > bands[2], F.lit("FIRE"))
        .when(r > bands[1], F.lit("HIGH_RISK"))
        .when(r >= bands[0], F.lit("WARNING"))
        .otherwise(F.lit("SAFE")),
    )
