"""Operators over ordered readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, rules, timeline
from ..plans.calibrate import ENRICHED, batch_calibrate, classify
from ..plans.online import answered, risk
from ..sources.fixture import EPOCH, readings
from . import inputs
from .inputs import rounded
from .judged import DOC_SQL
from .registry import query
from .sql import DECIDED, DECIDED_BY_MODEL, DEVICE_SEQ, EDGE_WALK, ROOM_WALK, STATED, alert_walk, check



@query(
    check(
        """SELECT reading_id, count(*) OVER w AS history_rows,
             round(avg(temperature) OVER w, 9) AS temperature_mean,
             min(temperature) OVER w AS temperature_min, max(temperature) OVER w AS temperature_max,
             round(avg(gas_raw) OVER w, 9) AS gas_raw_mean,
             min(gas_raw) OVER w AS gas_raw_min, max(gas_raw) OVER w AS gas_raw_max
           FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id
                                      ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""
    )
)
def win_history_50(spark, sf):
    out = timeline.history(readings(spark, sf))
    return rounded(out, 9, "temperature_mean", "gas_raw_mean").select(
        "reading_id", "history_rows", "temperature_mean", "temperature_min", "temperature_max",
        "gas_raw_mean", "gas_raw_min", "gas_raw_max",
    )


@query(
    check(
        """SELECT reading_id, gap_seconds,
             coalesce((temperature - lag(temperature) OVER w) / gap_seconds, 0) AS temp_rate,
             coalesce((gas_raw - lag(gas_raw) OVER w) / gap_seconds, 0) AS gas_rate,
             coalesce((flame_voltage - lag(flame_voltage) OVER w) / gap_seconds, 0) AS flame_rate
           FROM (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER w BETWEEN 1 AND 30
                     THEN (t_sec - lag(t_sec) OVER w)::DOUBLE ELSE 1.0::DOUBLE END AS gap_seconds
                 FROM readings WINDOW w AS (PARTITION BY room_id ORDER BY t_sec, reading_id))
           WINDOW w AS (PARTITION BY room_id ORDER BY t_sec, reading_id)"""
    )
)
def win_rate_of_change(spark, sf):
    return timeline.rate_of_change(readings(spark, sf)).select(
        "reading_id", "gap_seconds", "temp_rate", "gas_rate", "flame_rate"
    )


@query(
    check(
        "SELECT reading_id, temp_mean, gas_mean, humidity_mean, seen FROM classified",
        ROOM_WALK,
    )
)
def win_baseline_ema(spark, sf):
    return classify(readings(spark, sf)).select(
        "reading_id", "temp_mean", "gas_mean", "humidity_mean", "seen"
    )


@query(
    check(
        """SELECT reading_id,
             lag(temp_std, 1, 1.0::DOUBLE) OVER w AS temp_std_before,
             lag(gas_std, 1, 10.0::DOUBLE) OVER w AS gas_std_before
           FROM classified WINDOW w AS (PARTITION BY room_id ORDER BY seen)""",
        ROOM_WALK,
    )
)
def win_baseline_variance(spark, sf):
    return classify(readings(spark, sf)).select(
        "reading_id", "temp_std_before", "gas_std_before"
    )


@query(
    check(
        "SELECT reading_id, temp_delta, gas_delta, humidity_delta, temp_z, gas_z FROM classified",
        ROOM_WALK,
    )
)
def win_deviation_zscore(spark, sf):
    return classify(readings(spark, sf)).select(
        "reading_id", "temp_delta", "gas_delta", "humidity_delta", "temp_z", "gas_z"
    )


@query(
    check(
        "SELECT reading_id, row_number() OVER (PARTITION BY room_id ORDER BY t_sec, reading_id) "
        ">= 15 AS calibrated FROM readings"
    )
)
def win_calibrated_flag(spark, sf):
    return timeline.calibrated_flag(readings(spark, sf)).select("reading_id", "calibrated")


def _text(value, digits):
    """Half-up rounding of the shortest decimal text, as the published columns are rounded."""
    return (
        f"round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), {digits})::DOUBLE"
    )


ENRICHED_SQL = f"""
  reading_id, {_text('temp_mean', 2)} AS room_baseline_temp,
  {_text('gas_mean', 1)} AS room_baseline_gas,
  {_text('humidity_mean', 1)} AS room_baseline_humidity,
  {_text('temp_delta', 3)} AS delta_temp_from_baseline,
  {_text('gas_delta', 2)} AS delta_gas_from_baseline,
  {_text('temp_rate', 4)} AS temp_rate_of_change_c_per_sec,
  {_text('gas_rate', 2)} AS gas_rate_of_change_per_sec,
  {_text('temp_z', 2)} AS temp_zscore, {_text('gas_z', 2)} AS gas_zscore,
  verdict AS ai_classification_verdict, {_text('verdict_risk', 1)} AS ai_risk_score,
  verdict_fire AS is_actual_fire, seen >= 15 AS baseline_calibrated"""


@query(check(f"SELECT room_id, {ENRICHED_SQL} FROM classified", ROOM_WALK))
def win_enriched_reading(spark, sf):
    return batch_calibrate(readings(spark, sf)).select(
        "room_id", "reading_id", *[c for c in ENRICHED if c != "suppression_reason"]
    )


@query(
    check(
        f"""SELECT room_id, ai_classification_verdict, count(*) AS n,
              round(avg(ai_risk_score), 6) AS risk, round(avg(temp_zscore), 6) AS temp_zscore,
              round(avg(gas_zscore), 6) AS gas_zscore
            FROM (SELECT room_id, {ENRICHED_SQL} FROM classified)
            GROUP BY room_id, ai_classification_verdict""",
        ROOM_WALK,
    ),
    name="batch_calibrate",
)
def calibrated_rooms(spark, sf):
    """Calibrate the whole table and summarise it per room and verdict."""
    return (
        batch_calibrate(readings(spark, sf))
        .groupBy("room_id", "ai_classification_verdict")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("ai_risk_score"), 6).alias("risk"),
            F.round(F.avg("temp_zscore"), 6).alias("temp_zscore"),
            F.round(F.avg("gas_zscore"), 6).alias("gas_zscore"),
        )
    )


@query(check("SELECT reading_id, ema FROM edged", EDGE_WALK))
def win_edge_ema(spark, sf):
    return timeline.edge_thermal(readings(spark, sf)).select("reading_id", "ema")


@query(
    check(
        "SELECT reading_id, rate_per_min, CASE "
        "WHEN ema >= 70 OR rate_per_min >= 15 THEN 'FIRE' "
        "WHEN ema >= 55 OR rate_per_min >= 8 THEN 'HIGH_RISK' "
        "WHEN ema >= 40 OR rate_per_min >= 3 THEN 'WARNING' ELSE 'SAFE' END AS status FROM edged",
        EDGE_WALK,
    )
)
def win_edge_rate(spark, sf):
    return timeline.edge_thermal(readings(spark, sf)).select(
        "reading_id", "rate_per_min", "status"
    )


@query(
    check(
        "SELECT reading_id, slow_baseline, ema - slow_baseline AS deviation FROM edged",
        EDGE_WALK,
    )
)
def win_edge_baseline(spark, sf):
    return timeline.edge_thermal(readings(spark, sf)).select(
        "reading_id", "slow_baseline", "deviation"
    )


@query(
    check(
        """SELECT reading_id, confirmed,
             CASE WHEN confirmed THEN fire_state ELSE 'SAFE' END AS reported
           FROM (SELECT *, fire_state = 'SAFE' OR
                   t_sec - min(t_sec) OVER (PARTITION BY device_id, island) >= 10 AS confirmed
                 FROM (SELECT *, sum(changed) OVER
                         (PARTITION BY device_id ORDER BY t_sec, reading_id) AS island
                       FROM (SELECT *, (fire_state <> lag(fire_state, 1, 'SAFE') OVER
                               (PARTITION BY device_id ORDER BY t_sec, reading_id))::INTEGER
                               AS changed FROM stated)))""",
        STATED,
    )
)
def win_confirm_hold(spark, sf):
    held = timeline.confirm_hold(inputs.stated(readings(spark, sf)), status="fire_state")
    return held.select("reading_id", "confirmed", "reported")


@query(
    check(
        """SELECT reading_id, count AS persistence, count >= 3 AS flame_confirmed
           FROM counted WHERE rn > 0""",
        DEVICE_SEQ,
        """
counted AS (
  SELECT device_id, 0::BIGINT AS rn, NULL::BIGINT AS reading_id, 0::INTEGER AS count
  FROM (SELECT DISTINCT device_id FROM readings)
  UNION ALL
  SELECT s.device_id, s.rn, s.reading_id,
         CASE WHEN s.flame_raw <= 900 THEN least(c.count + 1, 255)
              ELSE greatest(c.count - 1, 0) END
  FROM counted c JOIN dseq s ON s.device_id = c.device_id AND s.rn = c.rn + 1)""",
    )
)
def win_persistence(spark, sf):
    return timeline.persistence(readings(spark, sf), threshold=900).select(
        "reading_id", "persistence", "flame_confirmed"
    )


HIT = "(event_type = 'error' OR k < 25)"


def _hit():
    return (F.col("event_type") == "error") | (F.col("k") < 25)


@query(
    check(
        f"""SELECT reading_id, sum({HIT}::INTEGER) OVER
              (PARTITION BY device_id ORDER BY t_sec, reading_id
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS detected FROM readings"""
    )
)
def win_debounce(spark, sf):
    return timeline.debounce(readings(spark, sf), _hit()).select("reading_id", "detected")


@query(
    check(
        f"""SELECT device_id, min(t_sec) AS started, max(t_sec) AS ended,
              arg_min(servo_angle, reading_id) AS angle, count(*) AS rows
            FROM (SELECT *, sum(begun) OVER w AS episode FROM (
                SELECT *, (latched = 1 AND lag(latched, 1, 0) OVER w = 0)::INTEGER AS begun
                FROM (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER
                          (PARTITION BY device_id ORDER BY t_sec, reading_id
                           ROWS UNBOUNDED PRECEDING), 0) AS latched
                      FROM (SELECT *, CASE WHEN {HIT} THEN 1
                                           WHEN NOT coalesce(lag({HIT}) OVER w, false) THEN 0 END
                                AS mark
                            FROM readings
                            WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id)))
                WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id))
              WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id))
            WHERE latched = 1 GROUP BY device_id, episode"""
    )
)
def win_fire_episodes(spark, sf):
    found = timeline.fire_episodes(readings(spark, sf), _hit())
    return found.select(
        "device_id",
        (F.unix_seconds("started") - EPOCH).alias("started"),
        (F.unix_seconds("ended") - EPOCH).alias("ended"),
        "angle",
        "rows",
    )


@query(
    check(
        """SELECT reading_id, CASE
             WHEN fire_state IN ('HIGH_RISK', 'FIRE') AND fire_state <> before THEN 'TRANSITION'
             WHEN fire_state = 'SAFE' AND before IN ('HIGH_RISK', 'FIRE') THEN 'ALL_CLEAR' END
             AS alert_kind
           FROM (SELECT *, lag(fire_state, 1, 'SAFE') OVER
                   (PARTITION BY device_id ORDER BY t_sec, reading_id) AS before FROM stated)""",
        STATED,
    )
)
def win_alert_transition(spark, sf):
    return timeline.alert_transition(inputs.stated(readings(spark, sf))).select(
        "reading_id", "alert_kind"
    )


@query(
    check(
        "SELECT reading_id, alert_kind, alert_kind IS NOT NULL AS should_alert FROM alerted",
        STATED,
        alert_walk(),
    )
)
def win_alert_rate_limit(spark, sf):
    return alerts.rate_limit(inputs.stated(readings(spark, sf))).select(
        "reading_id", "alert_kind", "should_alert"
    )


@query(
    check(
        """SELECT reading_id, gap * 1000 AS gap_ms, coalesce(gap * 1000 > 1500, false) AS timed_out
           FROM (SELECT *, lead(t_sec) OVER (PARTITION BY device_id ORDER BY reading_id) - t_sec
                   AS gap FROM readings)"""
    )
)
def win_watchdog_gap(spark, sf):
    return timeline.watchdog_gap(readings(spark, sf)).select("reading_id", "gap_ms", "timed_out")


@query(
    check(
        """SELECT device_id, min(t_sec) AS started, max(until) AS ended,
             arg_max(why, t_sec) AS reason, count(*) AS packets
           FROM (SELECT *, sum((k < 50 AND NOT follows)::INTEGER) OVER w AS interval_no
                 FROM (SELECT *,
                         coalesce(lag(k < 50) OVER w AND t_sec - lag(t_sec) OVER w <= 20, false)
                           AS follows,
                         CASE WHEN lead(t_sec) OVER w - t_sec <= 20 THEN lead(t_sec) OVER w
                              ELSE t_sec + 20 END AS until,
                         CASE WHEN coalesce(lead(t_sec) OVER w - t_sec <= 20, false)
                              THEN CASE WHEN lead(k < 50) OVER w THEN NULL ELSE 'CLEARED' END
                              ELSE 'TIMEOUT' END AS why
                       FROM readings
                       WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id))
                 WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id))
           WHERE k < 50 GROUP BY device_id, interval_no"""
    )
)
def win_response_intervals(spark, sf):
    on = timeline.response_intervals(readings(spark, sf), timeout_ms=20_000, fire=F.col("k") < 50)
    return on.select(
        "device_id",
        (F.unix_seconds("started") - EPOCH).alias("started"),
        (F.unix_seconds("ended") - EPOCH).alias("ended"),
        "reason",
        "packets",
    )


@query(
    check(
        """SELECT reading_id, (sum(turned) OVER w)::BIGINT AS sweep_id
           FROM (SELECT *, coalesce(moved <> lag(heading) OVER w, false)::INTEGER AS turned
                 FROM (SELECT *, last_value(moved IGNORE NULLS) OVER
                           (PARTITION BY device_id ORDER BY t_sec, reading_id
                            ROWS UNBOUNDED PRECEDING) AS heading
                       FROM (SELECT *, nullif(sign(servo_angle - lag(servo_angle) OVER w), 0)
                                 AS moved
                             FROM readings
                             WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id)))
                 WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id))
           WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id)"""
    )
)
def win_sweep_segment(spark, sf):
    return timeline.sweep_segment(readings(spark, sf)).select("reading_id", "sweep_id")


@query(
    check(
        "SELECT reading_id, round(m1, 9) AS temperature_mean, round(s1, 7) AS temperature_std, "
        "round(z1, 7) AS temperature_z, coalesce(abs(z2) > 3, false) AS gas_raw_anomaly, "
        "coalesce(abs(z3) > 3, false) AS flame_raw_anomaly FROM rolling",
        DOC_SQL,
    )
)
def feat_rolling(spark, sf):
    out = timeline.rolling_features(readings(spark, sf))
    out = rounded(out, 9, "temperature_mean")
    return rounded(out, 7, "temperature_std", "temperature_z").select(
        "reading_id", "temperature_mean", "temperature_std", "temperature_z", "gas_raw_anomaly", "flame_raw_anomaly"
    )


@query(check("SELECT reading_id, fusion_confidence FROM rolling", DOC_SQL))
def feat_fusion_confidence(spark, sf):
    return timeline.rolling_features(readings(spark, sf)).select("reading_id", "fusion_confidence")


@query(
    check(
        "SELECT reading_id, round(risk, 6) AS risk, state, ml_prediction, round(p_fire, 9) AS p_fire "
        "FROM risked",
        ROOM_WALK,
        DECIDED_BY_MODEL,
    )
)
def risk_hybrid(spark, sf):
    """The risk with the model's probability of FIRE among its signals."""
    rows = answered(classify(readings(spark, sf)), inputs.given_model())
    p_fire = F.try_element_at("probabilities", F.lit("FIRE"))
    return risk(rows.withColumn("p_fire", p_fire), F.col("p_fire")).select(
        "reading_id", F.round("risk", 6).alias("risk"), "state", "ml_prediction",
        F.round("p_fire", 9).alias("p_fire"),
    )


@query(
    check(
        """SELECT device_id, alert_kind, count(*) AS n, round(sum(risk_score), 4) AS risk
           FROM alerted WHERE alert_kind IS NOT NULL GROUP BY device_id, alert_kind""",
        ROOM_WALK,
        DECIDED,
        alert_walk("decided"),
    )
)
def online_alerts(spark, sf):
    """The whole online path: baseline, verdict, risk, fused state, rate-limited alerts."""
    from ..plans.online import decisions

    # Python steps take every column along, so only what the path needs is sent to them
    r = readings(spark, sf).select(
        "reading_id", "event_time", "device_id", "room_id", "temperature", "humidity", "pressure", "gas_raw",
        "flame_raw", "flame_voltage", "flame_digital",
    )
    decided = decisions(r).select("reading_id", "event_time", "device_id", "fire_state", "risk_score")
    raised = alerts.rate_limit(decided, sized_by=r).filter("should_alert")
    return raised.groupBy("device_id", "alert_kind").agg(
        F.count("*").alias("n"), F.round(F.sum("risk_score"), 4).alias("risk")
    )


@query(
    check(
        """SELECT device_id, arg_max(edge_state, t_sec) AS edge_state,
                  arg_max(temp_rate, t_sec) AS temp_rate
           FROM (SELECT *, CASE WHEN flame_digital = 1 THEN 'CRITICAL' ELSE 'NORMAL' END
                     AS edge_state,
                   coalesce((temperature - lag(temperature) OVER w) / gap, 0) AS temp_rate
                 FROM (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER w BETWEEN 1 AND 30
                           THEN (t_sec - lag(t_sec) OVER w)::DOUBLE ELSE 1.0::DOUBLE END AS gap
                       FROM readings
                       WINDOW w AS (PARTITION BY room_id ORDER BY t_sec, reading_id))
                 WINDOW w AS (PARTITION BY room_id ORDER BY t_sec, reading_id))
           GROUP BY device_id"""
    )
)
def current_state(spark, sf):
    """State of every device now: rates, edge rules, latest row."""
    from ..operators.ranking import latest_per_device

    r = readings(spark, sf).withColumns({"warm": F.lit(True), "sensors_valid": F.lit(True)})
    stated = rules.edge_state(timeline.rate_of_change(r))
    return latest_per_device(
        stated.select("device_id", "event_time", "reading_id", "edge_state", "temp_rate")
    ).select("device_id", "edge_state", "temp_rate")
