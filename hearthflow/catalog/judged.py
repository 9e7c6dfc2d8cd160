"""Rules, joins, aggregations, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, lookups, normalise, ranking, reports, rules
from ..operators.folds import RoomBaselineWalk
from ..plans.calibrate import classify
from ..plans.online import decisions, documents
from ..sources.fixture import readings
from . import inputs
from .inputs import rounded
from .registry import query
from .sql import DECIDED, DECIDED_BY_MODEL, ROOM_WALK, STATED, alert_walk, check

# --- rules -----------------------------------------------------------------


@query(
    check(
        """SELECT reading_id,
             CASE WHEN flame_digital = 1 AND flame_raw < 950 THEN 'CRITICAL'
                  WHEN flame_digital = 1 THEN 'FIRE'
                  WHEN warm AND ok AND gas_raw > 1700 THEN 'PRE_FIRE'
                  WHEN warm AND ok AND gas_raw > 1500 THEN 'WARNING' ELSE 'NORMAL' END
               AS edge_state,
             CASE WHEN flame_digital = 1 AND flame_raw < 950 THEN 98
                  WHEN flame_digital = 1 THEN 90
                  WHEN warm AND ok AND gas_raw > 1700 THEN 65
                  WHEN warm AND ok AND gas_raw > 1500 THEN 35 ELSE 5 END::DOUBLE AS edge_risk
           FROM (SELECT *, t_sec * 1000 > 60000 AS warm, temperature <= 35 AS ok
                 FROM readings)"""
    )
)
def rule_edge_state(spark, sf):
    r = readings(spark, sf).withColumns(
        {
            "warm": rules.warm(F.col("t_sec") * 1000),
            "sensors_valid": F.col("temperature") <= 35,
        }
    )
    out = rules.edge_state(r, flame_limit=950, gas_warning=1500, gas_prefire=1700)
    return out.select("reading_id", "edge_state", "edge_risk")


@query(check("SELECT reading_id, k >= 10 AND t_sec * 100 > 60000 AS warm FROM readings"))
def rule_warmup_gate(spark, sf):
    uptime = F.when(F.col("k") >= 10, F.col("t_sec") * 100)
    return readings(spark, sf).select("reading_id", rules.warm(uptime).alias("warm"))


STATUS = """CASE WHEN t >= 70 OR r >= 15 THEN 'FIRE' WHEN t >= 55 OR r >= 8 THEN 'HIGH_RISK'
                 WHEN t >= 40 OR r >= 3 THEN 'WARNING' ELSE 'SAFE' END"""
HOT = "(SELECT reading_id, temperature * 2 AS t, k / 10.0::DOUBLE + 0.0::DOUBLE AS r FROM readings)"


def _hot(spark, sf):
    return readings(spark, sf).select(
        "reading_id", (F.col("temperature") * 2.0).alias("t"), (F.col("k") / 10.0).alias("r")
    )


@query(check(f"SELECT reading_id, {STATUS} AS status FROM {HOT}"))
def rule_thermal_status(spark, sf):
    return _hot(spark, sf).select("reading_id", rules.thermal_status("t", "r").alias("status"))


@query(
    check(
        "SELECT reading_id, trunc(least(greatest((t - 25) / 45.0::DOUBLE * 60.0::DOUBLE, 0), 60) "
        "+ least(greatest(r / 15.0::DOUBLE * 40.0::DOUBLE, 0), 40))::INTEGER AS thermal_risk "
        f"FROM {HOT}"
    )
)
def rule_thermal_risk(spark, sf):
    return _hot(spark, sf).select("reading_id", rules.thermal_risk("t", "r").alias("thermal_risk"))


@query(
    check(
        """SELECT reading_id, CASE WHEN flame_raw > 900 THEN CASE WHEN flame_raw > 800 THEN 5
                  ELSE 15 END
             ELSE least(50 + (900 - flame_raw) * 30 // 900 + (k % 6) * 20 // 3, 100) END
             AS flame_risk FROM readings"""
    )
)
def rule_flame_risk(spark, sf):
    risk = rules.flame_risk("flame_raw", F.col("k") % 6, threshold=900)
    return readings(spark, sf).select("reading_id", risk.alias("flame_risk"))


@query(
    check(
        "SELECT reading_id, verdict, verdict_risk, verdict_fire, "
        "CASE WHEN verdict IN ('NORMAL_SUNNY_DAY', 'FALSE_ALARM_STEAM', "
        "'FALSE_ALARM_COOKING_GAS') THEN true ELSE false END AS suppressed FROM classified",
        ROOM_WALK,
    )
)
def rule_fusion_verdict(spark, sf):
    return classify(readings(spark, sf)).select(
        "reading_id", "verdict", "verdict_risk", "verdict_fire",
        (F.col("suppression_reason") != "").alias("suppressed"),
    )


@query(
    check(
        "SELECT reading_id, fire_state, risk_score FROM decided",
        ROOM_WALK,
        DECIDED,
    )
)
def rule_decision_fusion(spark, sf):
    return decisions(readings(spark, sf)).select(
        "reading_id", "fire_state", "risk_score"
    )


@query(
    check(
        "SELECT reading_id, CASE WHEN fire_state IN ('HIGH_RISK', 'FIRE') THEN 'ACTIVE' "
        "ELSE 'IDLE' END AS response_status FROM stated",
        STATED,
    )
)
def rule_response_status(spark, sf):
    return inputs.stated(readings(spark, sf)).select(
        "reading_id", rules.response_status().alias("response_status")
    )


@query(
    check(
        """SELECT reading_id, CASE WHEN k < 30 THEN 'FIRE' ELSE event_type END AS prediction,
             CASE WHEN k < 50 THEN k / 100.0::DOUBLE WHEN fire_state = 'FIRE' THEN 0.95::DOUBLE
                  ELSE 0.05::DOUBLE END AS confidence FROM stated""",
        STATED,
    )
)
def rule_prediction_fallback(spark, sf):
    k = F.col("k")
    r = inputs.stated(readings(spark, sf)).withColumns(
        {
            "ml_prediction": F.when(k < 30, "FIRE").when(k < 40, ""),
            "verdict": F.col("event_type"),
            "probabilities": F.when(k < 50, F.create_map(F.lit("FIRE"), k / 100.0)).when(
                k < 60, F.create_map(F.lit("NORMAL"), F.lit(1.0))
            ),
        }
    )
    return rules.prediction_fallback(r).select("reading_id", "prediction", "confidence")


@query(
    check(
        """SELECT reading_id, fire_state IN ('HIGH_RISK', 'FIRE') AS alarm,
             CASE fire_state WHEN 'FIRE' THEN 1800 WHEN 'HIGH_RISK' THEN 1100 END AS tone_hz,
             fire_state || CASE WHEN k < 50 THEN '' ELSE ' (checking)' END AS display
           FROM stated""",
        STATED,
    )
)
def rule_local_alarm(spark, sf):
    r = inputs.stated(readings(spark, sf)).withColumn("confirmed", F.col("k") < 50)
    return rules.local_alarm(r, status="fire_state").select(
        "reading_id", "alarm", "tone_hz", "display"
    )


@query(
    check(
        "SELECT reading_id, CASE WHEN k > 80 THEN 'red' WHEN k > 50 THEN 'amber' "
        "ELSE 'green' END AS band FROM readings"
    )
)
def proj_risk_band(spark, sf):
    return readings(spark, sf).select("reading_id", rules.risk_band("k").alias("band"))


DOC_SQL = """
rolled AS (
  SELECT reading_id, avg(temperature) OVER w AS m1, stddev_samp(temperature) OVER w AS s1,
         avg(gas_raw) OVER w AS m2, stddev_samp(gas_raw) OVER w AS s2,
         avg(flame_raw) OVER w AS m3, stddev_samp(flame_raw) OVER w AS s3,
         avg(humidity) OVER w AS m4, stddev_samp(humidity) OVER w AS s4
  FROM readings
  WINDOW w AS (PARTITION BY device_id ORDER BY t_sec, reading_id
               ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
zscored AS (
  SELECT reading_id, m1, s1,
         (temperature - m1) / nullif(s1, 0) AS z1, (gas_raw - m2) / nullif(s2, 0) AS z2,
         (flame_raw - m3) / nullif(s3, 0) AS z3, (humidity - m4) / nullif(s4, 0) AS z4
  FROM rolled JOIN readings USING (reading_id)),
rolling AS (
  SELECT *, (coalesce((abs(z1) > 3)::INTEGER, 0) + coalesce((abs(z2) > 3)::INTEGER, 0)
           + coalesce((abs(z3) > 3)::INTEGER, 0) + coalesce((abs(z4) > 3)::INTEGER, 0))
           / 4.0::DOUBLE AS fusion_confidence
  FROM zscored)"""


@query(
    check(
        """SELECT reading_id, device_id AS id, room_id || ' Fire Node' AS name,
             round(risk_score, 6) AS risk_score, fire_state,
             CASE WHEN fire_state IN ('HIGH_RISK', 'FIRE') THEN 'ACTIVE' ELSE 'IDLE' END
               AS response_status, verdict, true AS ml_active, ml_prediction, fusion_confidence,
             seen >= 15 AS calibrated
           FROM decided JOIN rolling USING (reading_id)""",
        ROOM_WALK,
        DECIDED_BY_MODEL,
        DOC_SQL,
    )
)
def proj_device_doc(spark, sf):
    docs = normalise.device_doc(documents(readings(spark, sf), inputs.given_model()))
    return docs.select(
        "reading_id",
        "id",
        "name",
        F.round("riskScore", 6).alias("risk_score"),
        F.col("fireState").alias("fire_state"),
        F.col("responseStatus").alias("response_status"),
        F.col("aiClassificationVerdict").alias("verdict"),
        F.col("aiMetadata.mlActive").alias("ml_active"),
        F.col("aiMetadata.mlPrediction").alias("ml_prediction"),
        F.col("aiMetadata.fusionConfidence").alias("fusion_confidence"),
        F.col("aiMetadata.baselineCalibrated").alias("calibrated"),
    )


# --- joins -----------------------------------------------------------------


@query(
    check(
        """SELECT reading_id, coalesce(p.seen, 0)::DOUBLE AS seen,
                  round(coalesce(p.t, 25.0::DOUBLE), 6) AS temp_mean,
                  round(coalesce(p.g, 1500.0::DOUBLE), 6) AS gas_mean
           FROM readings LEFT JOIN (
             SELECT room_id, count(*) AS seen, avg(temperature) AS t, avg(gas_raw) AS g
             FROM readings WHERE room_id < 'ROOM_7' GROUP BY room_id) p USING (room_id)"""
    )
)
def join_room_profile(spark, sf):
    r = readings(spark, sf)
    learned = {"seen": F.count("*"), "temp_mean": F.avg("temperature"), "gas_mean": F.avg("gas_raw")}
    start = dict(zip(lookups.PROFILE, RoomBaselineWalk.start))
    profiles = (
        r.filter("room_id < 'ROOM_7'")
        .groupBy("room_id")
        .agg(*[learned.get(c, F.lit(float(start[c]))).alias(c) for c in lookups.PROFILE])
    )
    return lookups.room_profile(r, profiles).select(
        "reading_id",
        "profile.seen",
        F.round("profile.temp_mean", 6).alias("temp_mean"),
        F.round("profile.gas_mean", 6).alias("gas_mean"),
    )


@query(
    check(
        "SELECT reading_id AS alert_id, k < 5 OR k >= 60 AS acknowledged FROM readings"
    )
)
def join_alert_ack(spark, sf):
    r = readings(spark, sf)
    raised = r.select(F.col("reading_id").alias("alert_id"), (F.col("k") < 5).alias("acknowledged"))
    acks = r.filter("k >= 60").select(F.col("reading_id").alias("alert_id"))
    return lookups.alert_ack(raised, acks.union(acks))


@query(
    check(
        """SELECT reading_id, CASE WHEN reset THEN 'SAFE' ELSE fire_state END AS fire_state,
             CASE WHEN reset THEN 5.0::DOUBLE ELSE k::DOUBLE END AS risk_score,
             CASE WHEN reset THEN 'CLEARED' ELSE 'IDLE' END AS response_status,
             CASE WHEN reset THEN 24.5::DOUBLE ELSE temperature END AS shown_temperature,
             CASE WHEN reset THEN 860 ELSE flame_raw END AS shown_flame
           FROM (SELECT *, t_sec <= (SELECT max(t_sec) FROM readings
                                     WHERE event_type = 'purchase' AND k = 50) AS reset
                 FROM stated)""",
        STATED,
    )
)
def join_verify_clear(spark, sf):
    r = inputs.stated(readings(spark, sf)).withColumns(
        {"risk_score": F.col("k").cast("double"), "response_status": F.lit("IDLE")}
    )
    actions = r.filter("event_type = 'purchase'").select(
        F.when(F.col("k") == 50, "CLEARED").otherwise("CONFIRMED").alias("action"),
        F.col("event_time").alias("action_time"),
        "device_id",
    )
    return lookups.verify_clear(r, actions).select(
        "reading_id", "fire_state", "risk_score", "response_status", "shown_temperature",
        "shown_flame",
    )


@query(
    check(
        """SELECT reading_id AS alert_id, k < 5 OR t_sec <= (
             SELECT max(t_sec) FROM readings WHERE event_type = 'purchase' AND k = 50)
             AS acknowledged FROM readings"""
    )
)
def join_clear_alerts(spark, sf):
    """A clear acknowledges every alert raised up to then."""
    r = readings(spark, sf)
    raised = r.select(
        F.col("reading_id").alias("alert_id"), "event_time", (F.col("k") < 5).alias("acknowledged")
    )
    actions = r.filter("event_type = 'purchase'").select(
        F.when(F.col("k") == 50, "CLEARED").otherwise("CONFIRMED").alias("action"),
        F.col("event_time").alias("action_time"),
    )
    return lookups.clear_alerts(raised, actions).drop("event_time")


@query(check("SELECT reading_id, device_id FROM readings WHERE event_type <> 'view'"))
def join_unprocessed(spark, sf):
    r = readings(spark, sf)
    done = r.filter("event_type = 'view'").select("reading_id")
    return lookups.unprocessed(r, done).select("reading_id", "device_id")


@query(
    check(
        "SELECT reading_id, CASE k % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'FIRE' "
        "WHEN 2 THEN 'FALSE_ALARM' END AS label_name FROM readings"
    )
)
def join_label_lookup(spark, sf):
    return readings(spark, sf).select(
        "reading_id", lookups.label_name(F.col("k") % 4).alias("label_name")
    )


# --- aggregations ----------------------------------------------------------


@query(
    check(
        "SELECT verdict, count(*) AS n, "
        "count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified) AS pct "
        "FROM classified GROUP BY verdict",
        ROOM_WALK,
    )
)
def agg_verdict_breakdown(spark, sf):
    return reports.verdict_breakdown(classify(readings(spark, sf)))


@query(
    check(
        "SELECT count(*) AS n, min(reading_id) AS reading_id, "
        "arg_min(room_id, reading_id) AS room_id, arg_min(temperature, reading_id) AS temperature "
        "FROM classified WHERE verdict = 'NORMAL_SUNNY_DAY' OR starts_with(verdict, 'FALSE_ALARM')",
        ROOM_WALK,
    )
)
def agg_suppressed_summary(spark, sf):
    return reports.suppressed_summary(classify(readings(spark, sf))).drop("suppression_reason")


@query(
    check(
        """SELECT count(*) AS initial_rows, count_if(k >= 3 AND k < 10)::BIGINT AS dropped_rows,
             count_if(k >= 10 AND temperature * 4 > 120)::BIGINT AS clamped_rows,
             count_if(k >= 10)::BIGINT AS valid_rows,
             count(DISTINCT CASE WHEN k >= 10 THEN room_id END) AS rooms
           FROM readings"""
    )
)
def agg_quality_report(spark, sf):
    k = F.col("k")
    raw = readings(spark, sf).select(
        *[
            F.when(k >= low, c).alias(name)
            for name, c, low in (
                ("temp", (F.col("temperature") * 4.0).cast("string"), 3),
                ("gas", F.when(k < 10, F.lit("bad")).otherwise(F.col("gas_raw").cast("string")), 3),
                ("flame", F.col("flame_raw"), 3),
                ("room", F.col("room_id"), 3),
            )
        ]
    )
    return reports.quality_report(normalise.flagged(raw))


@query(check("SELECT DISTINCT room_id FROM readings"))
def agg_distinct_rooms(spark, sf):
    return reports.distinct_rooms(readings(spark, sf))


@query(check("SELECT device_id, count(*) AS n FROM readings GROUP BY device_id"))
def agg_rows_per_device(spark, sf):
    return reports.rows_per(readings(spark, sf), "device_id")


LABELLED = """
labelled AS (
  SELECT *, CASE WHEN verdict IN ('PRE_FIRE_WARNING', 'ACTUAL_FIRE') THEN 1
                 WHEN starts_with(verdict, 'FALSE_ALARM') THEN 2 ELSE 0 END AS label,
            CASE WHEN flame_digital = 1 OR temperature > 30 THEN 1
                 WHEN humidity > 74 THEN 2 ELSE 0 END AS prediction
  FROM classified)"""


def _scored(spark, sf):
    """Class of the verdict against a plain threshold guess."""
    guess = (
        F.when((F.col("flame_digital") == 1) | (F.col("temperature") > 30), 1)
        .when(F.col("humidity") > 74, 2)
        .otherwise(0)
    )
    return classify(readings(spark, sf)).select(
        normalise.label_map("verdict").alias("label"), guess.alias("prediction")
    )


@query(check("SELECT label, count(*) AS n FROM labelled GROUP BY label", ROOM_WALK, LABELLED))
def agg_class_distribution(spark, sf):
    return reports.rows_per(_scored(spark, sf), "label")


PER_CLASS = """
per_class AS (
  SELECT c.class, count_if(label = class) AS support, count_if(prediction = class) AS guessed,
         count_if(label = class AND prediction = class) AS hit
  FROM labelled CROSS JOIN (VALUES (0), (1), (2)) AS c(class) GROUP BY c.class),
scored AS (
  SELECT class, support, hit, coalesce(hit / nullif(guessed, 0)::DOUBLE, 0) AS precision,
         coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall,
         coalesce(2.0::DOUBLE * hit / nullif(support + guessed, 0)::DOUBLE, 0) AS f1
  FROM per_class WHERE support + guessed > 0)"""


@query(
    check(
        "SELECT round(sum(hit) / sum(support)::DOUBLE, 9) AS accuracy, "
        "round(sum(f1 * support) / sum(support)::DOUBLE, 9) AS weighted_f1 FROM scored",
        ROOM_WALK,
        LABELLED,
        PER_CLASS,
    )
)
def agg_eval_scores(spark, sf):
    return rounded(reports.eval_scores(_scored(spark, sf)), 9, "accuracy", "weighted_f1")


@query(
    check(
        """SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall,
                  round(f1, 9) AS f1, support FROM (
             SELECT class::VARCHAR AS name, precision, recall, f1, support::BIGINT AS support
             FROM scored
             UNION ALL
             SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM scored
             UNION ALL
             SELECT 'weighted', sum(precision * support) / sum(support)::DOUBLE,
                    sum(recall * support) / sum(support)::DOUBLE,
                    sum(f1 * support) / sum(support)::DOUBLE, sum(support)::BIGINT FROM scored)""",
        ROOM_WALK,
        LABELLED,
        PER_CLASS,
    )
)
def agg_classification_report(spark, sf):
    return rounded(
        reports.classification_report(_scored(spark, sf)), 9, "precision", "recall", "f1"
    )


@query(
    check(
        "SELECT label, count_if(prediction = 0)::BIGINT AS predicted_0, "
        "count_if(prediction = 1)::BIGINT AS predicted_1, "
        "count_if(prediction = 2)::BIGINT AS predicted_2 "
        "FROM labelled GROUP BY label",
        ROOM_WALK,
        LABELLED,
    )
)
def agg_confusion_matrix(spark, sf):
    return reports.confusion_matrix(_scored(spark, sf))


SWEPT = """
swept AS (SELECT device_id, t_sec // 400 AS sweep_id, k * 2 AS angle, flame_raw FROM readings),
bins AS (
  SELECT s.device_id, s.sweep_id, b.bin,
         coalesce(min(CASE WHEN least(least(angle, 180) // 10, 18) = b.bin THEN flame_raw END),
                  1023) AS min_raw
  FROM swept s CROSS JOIN (SELECT unnest(range(19)) AS bin) b
  GROUP BY s.device_id, s.sweep_id, b.bin)"""


def _swept(spark, sf):
    return readings(spark, sf).select(
        "device_id",
        F.floor(F.col("t_sec") / 400).alias("sweep_id"),
        (F.col("k") * 2).alias("angle"),
        "flame_raw",
    )


@query(check("SELECT device_id, sweep_id, bin::INTEGER AS bin, min_raw FROM bins", SWEPT))
def agg_sweep_bins(spark, sf):
    return reports.sweep_bins(_swept(spark, sf))


@query(
    check(
        """SELECT device_id, sweep_id, best_angle, min_raw, round(confidence, 9) AS confidence
           FROM (SELECT *, CASE WHEN min_raw < 700 AND mean_raw - min_raw > 80
                     THEN least((mean_raw - min_raw) / 350.0::DOUBLE, 1) ELSE 0.1::DOUBLE END
                     AS confidence
                 FROM (SELECT device_id, sweep_id, min(min_raw) AS min_raw,
                         avg(min_raw) AS mean_raw,
                         CASE WHEN min(min_raw) >= 1023 THEN 90
                              ELSE (arg_min(bin, min_raw * 100 + bin) * 10)::INTEGER END
                           AS best_angle
                       FROM bins GROUP BY device_id, sweep_id))""",
        SWEPT,
    )
)
def agg_sweep_peak(spark, sf):
    peak = reports.sweep_peak(_swept(spark, sf), flame_below=700)
    return rounded(peak, 9, "confidence").drop("mean_raw")


# --- sort, limit, latest, set operations -----------------------------------


@query(
    check(
        "SELECT reading_id, t_sec, device_id, row_number() OVER (ORDER BY t_sec, reading_id) "
        "AS position FROM readings"
    )
)
def sort_chronological(spark, sf):
    return ranking.sort_chronological(readings(spark, sf), position="position").select(
        "reading_id", "t_sec", "device_id", "position"
    )


@query(
    check(
        "SELECT *, row_number() OVER (ORDER BY coalesce(timestamp, ''), push_id) AS position FROM "
        "(SELECT 'p' || reading_id AS push_id, CASE WHEN k >= 5 THEN t_sec::VARCHAR END "
        "AS timestamp FROM readings)"
    )
)
def sort_export(spark, sf):
    r = readings(spark, sf).select(
        F.concat(F.lit("p"), "reading_id").alias("push_id"),
        F.when(F.col("k") >= 5, F.col("t_sec").cast("string")).alias("timestamp"),
    )
    return ranking.sort_export(r, position="position")


def _top(rows, key="device_id"):
    return (
        f"SELECT reading_id, {key}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY t_sec DESC, reading_id DESC) AS rank FROM readings) "
        f"WHERE rank <= {rows}"
    )


@query(check(_top(10)))
def topk_recent_per_device(spark, sf):
    return ranking.recent_per_device(readings(spark, sf)).select("reading_id", "device_id", "rank")


@query(
    check(
        "SELECT reading_id, device_id, (row_number() OVER (PARTITION BY device_id "
        f"ORDER BY t_sec, reading_id))::INTEGER AS position FROM ({_top(50)})",
    ).replace("SELECT reading_id, device_id, rank::INTEGER", "SELECT reading_id, device_id, t_sec, rank::INTEGER")
)
def device_history(spark, sf):
    return ranking.device_history(readings(spark, sf)).select("reading_id", "device_id", "position")


def _raised(spark, sf):
    """All danger readings as alert rows."""
    r = inputs.stated(readings(spark, sf)).withColumn("risk_score", F.col("k").cast("double"))
    return alerts.build(r.filter(lookups.in_danger("fire_state")))


@query(
    check(
        "SELECT reading_id, device_id, 'critical' AS severity, fire_state FROM stated "
        "WHERE fire_state IN ('HIGH_RISK', 'FIRE') ORDER BY t_sec DESC LIMIT 50",
        STATED,
    )
)
def topk_recent_alerts(spark, sf):
    return alerts.recent(_raised(spark, sf)).select(
        "reading_id", "device_id", "severity", "fire_state"
    )


@query(
    check(
        "SELECT t_sec, true AS is_critical, room_id AS place, servo_angle || '°' AS angle "
        "FROM stated WHERE fire_state IN ('HIGH_RISK', 'FIRE') ORDER BY t_sec DESC LIMIT 8",
        STATED,
    )
)
def topk_alert_feed(spark, sf):
    return alerts.feed(_raised(spark, sf)).select(
        (F.unix_seconds("event_time") - 1_704_067_200).alias("t_sec"), "is_critical", "place",
        "angle",
    )


@query(
    check(
        """SELECT reading_id, k < 10 OR fire_state = 'FIRE' AS is_critical,
             CASE WHEN k < 10 THEN 'critical' WHEN k < 20 THEN 'info'
                  WHEN fire_state = 'FIRE' THEN 'critical' ELSE 'info' END AS severity,
             CASE WHEN k >= 30 THEN room_id WHEN k >= 25 THEN device_id ELSE 'Kitchen' END
               AS place,
             CASE WHEN k >= 40 THEN 'm' ELSE 't' END AS text,
             CASE WHEN k >= 50 THEN servo_angle || '°' ELSE 'N/A' END AS angle,
             k >= 60 AND k >= 70 AS acknowledged
           FROM stated""",
        STATED,
    )
)
def proj_alert_view(spark, sf):
    k = F.col("k")
    raw = inputs.stated(readings(spark, sf)).select(
        F.col("reading_id").alias("alert_id"),
        "event_time",
        "fire_state",
        F.when(k < 10, "critical").when(k < 20, "info").when(k < 30, "").alias("severity"),
        F.when(k >= 30, F.col("room_id")).alias("room_id"),
        F.when(k >= 25, F.col("device_id")).alias("device_id"),
        F.when(k >= 40, "m").when(k >= 20, "").alias("message"),
        F.lit("t").alias("title"),
        F.when(k >= 50, F.col("servo_angle")).alias("fire_angle"),
        F.when(k >= 60, k >= 70).alias("acknowledged"),
    )
    return alerts.view(raw).withColumnRenamed("alert_id", "reading_id").drop("event_time")


@query(
    check(
        "SELECT device_id, max(reading_id) AS reading_id, arg_max(temperature, reading_id) "
        "AS temperature, arg_max(room_id, reading_id) AS room_id FROM readings GROUP BY device_id"
    )
)
def latest_per_device(spark, sf):
    slim = readings(spark, sf).select(
        "device_id", "event_time", "reading_id", "temperature", "room_id"
    )
    return ranking.latest_per_device(slim).drop("event_time")


@query(check("SELECT reading_id, device_id, CASE WHEN k < 50 THEN k END AS extra FROM readings"))
def union_devices(spark, sf):
    r = readings(spark, sf)
    parts = [
        r.filter("k < 50").select("reading_id", "device_id", F.col("k").alias("extra")),
        r.filter("k >= 50").select("reading_id", "device_id"),
    ]
    return ranking.union_devices(parts)


@query(
    check(
        """SELECT 'ALERT' AS event_kind, reading_id, room_id, NULL AS email_sent_to FROM stated
           WHERE fire_state IN ('HIGH_RISK', 'FIRE')
           UNION ALL
           SELECT 'DISPATCH', reading_id,
                  CASE WHEN k >= 20 THEN room_id ELSE 'General Room' END,
                  CASE WHEN k >= 50 THEN 'a@b.c' ELSE '' END
           FROM readings""",
        STATED,
    )
)
def union_audit_trail(spark, sf):
    trail = alerts.audit_trail(_raised(spark, sf), alerts.dispatch_log(_requests(spark, sf)))
    return trail.select("event_kind", "reading_id", "room_id", "email_sent_to")


@query(
    check(
        "SELECT reading_id, device_id, 0 AS arrival FROM readings",
    )
)
def dedup_push_id(spark, sf):
    """Some readings arrive again up to three times."""
    r = readings(spark, sf).select("reading_id", "device_id", "event_time")
    copies = F.sequence(F.lit(0), (F.col("reading_id") % 4).cast("int"))
    sent = r.withColumn("arrival", F.explode(copies))
    return ranking.dedup(
        sent.withColumn("arrival_time", F.col("event_time") + F.make_dt_interval(secs=F.col("arrival").cast("decimal(18,6)")))
    ).select("reading_id", "device_id", "arrival")


# --- alert content ---------------------------------------------------------


def _requests(spark, sf):
    k = F.col("k")
    return readings(spark, sf).select(
        "reading_id",
        "event_time",
        F.when(k >= 50, "a@b.c").alias("email"),
        F.when(k >= 60, "555").alias("phone"),
        F.when(k >= 20, F.col("room_id")).alias("room_id"),
        F.when(k >= 30, F.col("temperature")).alias("temperature"),
        F.when(k >= 40, F.col("servo_angle")).alias("fire_angle"),
        F.when(k >= 10, k.cast("double")).alias("risk_score"),
    )


@query(
    check(
        """SELECT reading_id, 'USER_NOTIFICATION_DISPATCH' AS type,
             CASE WHEN k >= 50 THEN 'a@b.c' ELSE '' END AS email_sent_to,
             CASE WHEN k >= 60 THEN '555' ELSE '' END AS sms_sent_to,
             CASE WHEN k >= 20 THEN room_id ELSE 'General Room' END AS room_id,
             CASE WHEN k >= 30 THEN temperature ELSE 25.0::DOUBLE END AS temperature,
             CASE WHEN k >= 40 THEN servo_angle ELSE 90 END AS fire_angle,
             CASE WHEN k >= 10 THEN k::DOUBLE ELSE 0.0::DOUBLE END AS risk_score
           FROM readings"""
    )
)
def alert_dispatch_log(spark, sf):
    return alerts.dispatch_log(_requests(spark, sf)).drop("alert_id", "event_time")


@query(
    check(
        """SELECT reading_id, CASE WHEN danger THEN '🔥 FIRE ALERT: ' || room_id
                  ELSE '✅ ALL CLEAR: ' || room_id END AS title,
             'Severity: ' || fire_state || ' | Risk Score: ' || k || '.0% | Detected Angle: '
               || servo_angle || '° | Device: ' || device_id AS message,
             CASE WHEN danger THEN 'critical' ELSE 'info' END AS severity, false AS acknowledged
           FROM (SELECT *, fire_state IN ('HIGH_RISK', 'FIRE') AS danger FROM alerted
                 WHERE alert_kind IS NOT NULL)""",
        STATED,
        alert_walk(),
    )
)
def alert_build(spark, sf):
    r = inputs.stated(readings(spark, sf)).withColumn("risk_score", F.col("k").cast("double"))
    raised = alerts.rate_limit(r).filter("should_alert")
    return alerts.build(raised).select(
        "reading_id", "title", "message", "severity", "acknowledged"
    )


@query(
    check(
        """SELECT reading_id, verdict,
             CASE verdict WHEN 'NORMAL_SUNNY_DAY' THEN 'High ambient temp ('
                  WHEN 'FALSE_ALARM_STEAM' THEN 'Humidity surge (+'
                  WHEN 'FALSE_ALARM_COOKING_GAS' THEN 'Gas spike (Z=' ELSE '' END AS opening,
             CASE verdict WHEN 'NORMAL_SUNNY_DAY' THEN temp_mean_before
                  WHEN 'FALSE_ALARM_STEAM' THEN humidity_delta
                  WHEN 'FALSE_ALARM_COOKING_GAS' THEN gas_z END AS shown
           FROM classified""",
        ROOM_WALK,
    )
)
def alert_suppression_reason(spark, sf):
    """The text itself rounds ties differently per engine, so its opening and the number
    behind it are compared."""
    verdict = F.col("verdict")
    shown = (
        F.when(verdict == "NORMAL_SUNNY_DAY", F.col("temp_mean_before"))
        .when(verdict == "FALSE_ALARM_STEAM", F.col("humidity_delta"))
        .when(verdict == "FALSE_ALARM_COOKING_GAS", F.col("gas_z"))
    )
    return classify(readings(spark, sf)).select(
        "reading_id",
        "verdict",
        F.regexp_extract("suppression_reason", r"^[^(]*\((\+|Z=)?", 0).alias("opening"),
        shown.alias("shown"),
    )


