"""From readings to decisions: rolling features, risk, verdict, fused state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import known
from ..operators import learning, timeline
from ..operators.rules import (
    decision_fusion,
    flame_risk,
    hybrid_risk,
    prediction_fallback,
    response_status,
    thermal_risk,
)
from .calibrate import classify, published


def risk(df: DataFrame, fire_probability: Column | None = None) -> DataFrame:
    """Hybrid risk of classified readings, from the temperature with its rate and the flame
    level."""
    scored = df.withColumns(
        {
            "thermal_risk": thermal_risk("temperature", F.col("temp_rate") * 60.0),
            "flame_risk": flame_risk("flame_raw", F.col("flame_digital")),
        }
    )
    return hybrid_risk(scored, fire_probability)


def answered(classified: DataFrame, model) -> DataFrame:
    """Classified readings with the model's `ml_prediction` and `probabilities` by class name.
    Features are the published columns, as in training; what is missing counts as 0."""
    enriched = published()
    features = {
        f: enriched[f] if f in enriched else F.col(f) if f in classified.columns else F.lit(None)
        for f in learning.model_features(model)
    }
    packed = classified.select(
        F.struct("*").alias("_row"),
        *[F.coalesce(known(c.cast("double")), F.lit(0.0)).alias(f) for f, c in features.items()],
    )
    kept = [F.col("_row")[c].alias(c) for c in classified.columns if c not in ANSWER]
    return learning.predict(packed, model).select(*kept, *ANSWER)


ANSWER = ("ml_prediction", "probabilities")


def unanswered(classified: DataFrame) -> DataFrame:
    return classified.withColumns(
        {
            "ml_prediction": F.lit(None).cast("string"),
            "probabilities": F.lit(None).cast("map<string, double>"),
        }
    )


def decide(
    classified: DataFrame, fire_probability: Column | None = None, model=None
) -> DataFrame:
    """Fused `fire_state`, `risk_score` and `response_status` of classified readings. With a model
    its probability of FIRE is one of the risk's signals, and its answer stays in the rows."""
    if model is not None:
        classified = answered(classified, model)
        fire_probability = F.try_element_at("probabilities", F.lit("FIRE"))
    return decision_fusion(risk(classified, fire_probability)).withColumn(
        "response_status", response_status()
    )


def decisions(readings: DataFrame, model=None, **walk_options) -> DataFrame:
    """The whole online path over stored readings."""
    return decide(classify(readings, **walk_options), model=model)


def documents(readings: DataFrame, model=None, **walk_options) -> DataFrame:
    """Decisions with the published baseline columns and the rolling-feature confidence,
    ready for normalise.device_doc."""
    decided = decisions(readings, model, **walk_options)
    if model is None:
        decided = unanswered(decided)
    rolled = timeline.rolling_features(decided, sized_by=readings)
    return rolled.withColumns({**published(), "ml_active": F.lit(model is not None)})


def enrichment(classified: DataFrame, model=None) -> DataFrame:
    """Patch columns for classified readings that wait for inference."""
    decided = decide(classified, model=model)
    if model is None:
        decided = unanswered(decided)
    return prediction_fallback(decided).select(
        "reading_id",
        "risk_score",
        "prediction",
        "confidence",
        F.round("temp_mean", 2).alias("room_baseline_temp"),
        F.round("temp_rate", 4).alias("temp_rate_of_change"),
        F.col("verdict").alias("ai_classification_verdict"),
    )
