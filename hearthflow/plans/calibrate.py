"""Batch calibration: walk the room baselines and classify every reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators.folds import SEED, RoomBaselineWalk, final_states, walk_series
from ..operators.normalise import baseline_inputs
from ..operators.rules import fusion_verdict
from ..operators.series import CHUNK, over_series

ORDER = ("event_time", "reading_id")

ENRICHED = (
    "room_baseline_temp",
    "room_baseline_gas",
    "room_baseline_humidity",
    "delta_temp_from_baseline",
    "delta_gas_from_baseline",
    "temp_rate_of_change_c_per_sec",
    "gas_rate_of_change_per_sec",
    "temp_zscore",
    "gas_zscore",
    "ai_classification_verdict",
    "ai_risk_score",
    "is_actual_fire",
    "suppression_reason",
    "baseline_calibrated",
)


def _prepared(df: DataFrame, profiles: DataFrame | None, key: str) -> DataFrame:
    filled = baseline_inputs(df).withColumn("at_us", micros("event_time"))
    if profiles is None:
        return filled
    saved = profiles.select(
        key,
        F.array(*[F.col(n).cast("double") for n in RoomBaselineWalk.state_names]).alias(SEED),
    )
    return filled.withColumn(SEED, F.lit(None).cast("array<double>")).unionByName(
        saved, allowMissingColumns=True
    )


def walk_rooms(
    df: DataFrame,
    alpha: float = 0.01,
    floors: tuple[float, float] = (0.3, 15.0),
    key: str = "room_id",
    order: Sequence[str] = ORDER,
    profiles: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """Input columns plus everything the room baseline knows at each reading.

    With `profiles` (see room_profiles) every room goes on from its saved state, so a day
    can be calibrated without walking the days before it again.
    """
    limits.setdefault("sized_by", df)

    def step(series):
        return walk_series(series, RoomBaselineWalk(alpha, *floors))

    walked = over_series(_prepared(df, profiles, key), key, order, step, **limits)
    if profiles is not None:
        walked = walked.filter(F.col(SEED).isNull()).drop(SEED)
    return walked.drop("at_us")


def room_profiles(
    df: DataFrame,
    alpha: float = 0.01,
    floors: tuple[float, float] = (0.3, 15.0),
    key: str = "room_id",
    order: Sequence[str] = ORDER,
    profiles: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """One row per room: its baseline state after the readings, to be saved for later."""
    limits.setdefault("sized_by", df)

    def step(series):
        return final_states(series, RoomBaselineWalk(alpha, *floors))

    return over_series(_prepared(df, profiles, key), key, order, step, **limits).drop(CHUNK)


def classify(df: DataFrame, **walk_options) -> DataFrame:
    """walk_rooms plus the fusion verdict, unrounded."""
    return fusion_verdict(walk_rooms(df, **walk_options))


def published(min_samples: int = 15) -> dict[str, Column]:
    """The enriched columns as published: baselines after the reading, deviations before."""
    return {
        "room_baseline_temp": F.round("temp_mean", 2),
        "room_baseline_gas": F.round("gas_mean", 1),
        "room_baseline_humidity": F.round("humidity_mean", 1),
        "delta_temp_from_baseline": F.round("temp_delta", 3),
        "delta_gas_from_baseline": F.round("gas_delta", 2),
        "temp_rate_of_change_c_per_sec": F.round("temp_rate", 4),
        "gas_rate_of_change_per_sec": F.round("gas_rate", 2),
        "temp_zscore": F.round("temp_z", 2),
        "gas_zscore": F.round("gas_z", 2),
        "ai_classification_verdict": F.col("verdict"),
        "ai_risk_score": F.round("verdict_risk", 1),
        "is_actual_fire": F.col("verdict_fire"),
        "suppression_reason": F.col("suppression_reason"),
        "baseline_calibrated": F.col("seen") >= min_samples,
    }


def batch_calibrate(df: DataFrame, **walk_options) -> DataFrame:
    """The input readings plus the enriched columns."""
    columns = published()
    kept = [c for c in df.columns if c not in columns]
    return classify(df, **walk_options).select(
        *kept, *[c.alias(name) for name, c in columns.items()]
    )
