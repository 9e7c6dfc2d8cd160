"""SQL building blocks of the checks: the readings view and the sequential walks."""

from __future__ import annotations

READINGS = """
readings AS (
  SELECT event_id AS reading_id, event_id AS t_sec,
         'dev_' || (user_id % 20) AS device_id,
         'ROOM_' || (user_id % 10) AS room_id,
         22.0::DOUBLE + least(value, 200.0::DOUBLE) * 0.08::DOUBLE AS temperature,
         40.0::DOUBLE + k * 0.4::DOUBLE AS humidity,
         1013.25::DOUBLE AS pressure,
         1400.0::DOUBLE + floor(value)
           * (CASE WHEN event_type = 'view' THEN 0.0 ELSE 2.0 END)::DOUBLE AS gas_raw,
         (CASE WHEN event_type = 'error' AND k < 5 THEN 0.8 ELSE 3.0 END)::DOUBLE
           AS flame_voltage,
         CASE WHEN event_type = 'error' AND k < 3 THEN 1 ELSE 0 END AS flame_digital,
         (1023 - least(floor(value * 4.0::DOUBLE), 1023))::INTEGER AS flame_raw,
         floor(k * 180 / 99.0::DOUBLE)::INTEGER AS servo_angle,
         k, event_type, value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

# State of a reading by its value: the given input of the alert checks.
STATED = """
stated AS (
  SELECT *, CASE WHEN value >= 120 THEN 'FIRE' WHEN value >= 70 THEN 'HIGH_RISK'
                 WHEN value >= 50 THEN 'WARNING' ELSE 'SAFE' END AS fire_state
  FROM readings)"""

ROOM_WALK = """
seq AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY t_sec, reading_id) AS rn
  FROM readings),
walk AS (
  SELECT room_id, 0::BIGINT AS rn, NULL::BIGINT AS reading_id, NULL::BIGINT AS last_t,
         25.0::DOUBLE AS tm, 1.0::DOUBLE AS tv, 1.0::DOUBLE AS ts, 50.0::DOUBLE AS hm,
         1500.0::DOUBLE AS gm, 100.0::DOUBLE AS gv, 10.0::DOUBLE AS gs,
         0.0::DOUBLE AS last_temp, 0.0::DOUBLE AS last_gas, 0.0::DOUBLE AS last_flame,
         0.0::DOUBLE AS gap_seconds, 0.0::DOUBLE AS temp_rate, 0.0::DOUBLE AS gas_rate,
         0.0::DOUBLE AS flame_rate, 0.0::DOUBLE AS temp_mean_before,
         0.0::DOUBLE AS temp_delta, 0.0::DOUBLE AS gas_delta, 0.0::DOUBLE AS humidity_delta,
         0.0::DOUBLE AS temp_z, 0.0::DOUBLE AS gas_z, ''::VARCHAR AS verdict,
         0.0::DOUBLE AS verdict_risk
  FROM (SELECT DISTINCT room_id FROM readings)
  UNION ALL
  SELECT room_id, rn, reading_id, t_sec,
         CASE WHEN rn = 1 THEN temperature WHEN frozen THEN tm
              ELSE tm + 0.01::DOUBLE * temp_delta END,
         CASE WHEN rn = 1 OR frozen THEN tv ELSE tv1 END,
         CASE WHEN rn = 1 OR frozen THEN ts ELSE greatest(sqrt(tv1), 0.3::DOUBLE) END,
         CASE WHEN rn = 1 THEN humidity WHEN frozen THEN hm
              ELSE (1.0::DOUBLE - 0.01::DOUBLE) * hm + 0.01::DOUBLE * humidity END,
         CASE WHEN rn = 1 THEN gas_raw WHEN frozen THEN gm
              ELSE gm + 0.01::DOUBLE * gas_delta END,
         CASE WHEN rn = 1 OR frozen THEN gv ELSE gv1 END,
         CASE WHEN rn = 1 OR frozen THEN gs ELSE greatest(sqrt(gv1), 15.0::DOUBLE) END,
         temperature, gas_raw, flame_voltage,
         gap, temp_rate, gas_rate, flame_rate, tm, temp_delta, gas_delta, humidity_delta,
         temp_z, gas_z, verdict,
         CASE WHEN verdict = 'ACTUAL_FIRE' AND flame AND
                   (temp_delta > 2 OR temp_rate > 0.15 OR gas_z > 2) THEN 98
              WHEN verdict = 'ACTUAL_FIRE' AND flame THEN 92
              WHEN verdict = 'ACTUAL_FIRE' THEN 88
              WHEN verdict = 'NORMAL_SUNNY_DAY' THEN 5
              WHEN verdict = 'FALSE_ALARM_STEAM' THEN 12
              WHEN verdict = 'FALSE_ALARM_COOKING_GAS' THEN 25
              WHEN verdict = 'PRE_FIRE_WARNING' THEN 65
              ELSE least(greatest(temp_z * 5.0::DOUBLE + gas_z * 3.0::DOUBLE, 0), 30)
         END::DOUBLE
  FROM (
    SELECT *, verdict IN ('ACTUAL_FIRE', 'PRE_FIRE_WARNING') AS frozen,
           (1.0::DOUBLE - 0.01::DOUBLE) * tv
             + 0.01::DOUBLE * (temp_delta * temp_delta) AS tv1,
           (1.0::DOUBLE - 0.01::DOUBLE) * gv
             + 0.01::DOUBLE * (gas_delta * gas_delta) AS gv1
    FROM (
      SELECT *, CASE
          WHEN flame THEN 'ACTUAL_FIRE'
          WHEN temp_rate > 0.4::DOUBLE AND temp_delta > 4.5::DOUBLE AND gas_z > 3
            THEN 'ACTUAL_FIRE'
          WHEN temperature > 28 AND gas_z < 2 AND abs(temp_rate) < 0.08::DOUBLE
            THEN 'NORMAL_SUNNY_DAY'
          WHEN humidity_delta > 15 AND gas_z < 1.5::DOUBLE THEN 'FALSE_ALARM_STEAM'
          WHEN gas_z > 2.5::DOUBLE AND temp_delta < 1.5::DOUBLE AND temp_rate <= 0.05::DOUBLE
            THEN 'FALSE_ALARM_COOKING_GAS'
          WHEN gas_z > 3.5::DOUBLE AND (temp_delta > 2 OR temp_rate > 0.1::DOUBLE)
            THEN 'PRE_FIRE_WARNING'
          ELSE 'NORMAL' END AS verdict
      FROM (
        SELECT *, temp_delta / ts AS temp_z, gas_delta / gs AS gas_z,
               CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE (temperature - last_temp) / gap END
                 AS temp_rate,
               CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE (gas_raw - last_gas) / gap END
                 AS gas_rate,
               CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE (flame_voltage - last_flame) / gap END
                 AS flame_rate,
               (flame_digital = 1 OR flame_voltage < 1.6::DOUBLE) AS flame
        FROM (
          SELECT s.room_id, s.rn, s.reading_id, s.t_sec, s.temperature, s.humidity,
                 s.gas_raw, s.flame_voltage, s.flame_digital,
                 w.tm, w.tv, w.ts, w.hm, w.gm, w.gv, w.gs,
                 w.last_temp, w.last_gas, w.last_flame,
                 s.temperature - w.tm AS temp_delta, s.gas_raw - w.gm AS gas_delta,
                 s.humidity - w.hm AS humidity_delta,
                 CASE WHEN s.t_sec - w.last_t BETWEEN 1 AND 30
                      THEN (s.t_sec - w.last_t)::DOUBLE ELSE 1.0::DOUBLE END AS gap
          FROM walk w JOIN seq s ON s.room_id = w.room_id AND s.rn = w.rn + 1))))),
classified AS (
  SELECT w.reading_id, w.rn AS seen, w.tm AS temp_mean, w.ts AS temp_std, w.tv AS temp_var,
         w.hm AS humidity_mean, w.gm AS gas_mean, w.gs AS gas_std, w.gv AS gas_var,
         w.gap_seconds, w.temp_rate, w.gas_rate, w.flame_rate, w.temp_mean_before,
         w.temp_delta, w.gas_delta, w.humidity_delta, w.temp_z, w.gas_z, w.verdict,
         w.verdict_risk, w.verdict = 'ACTUAL_FIRE' AS verdict_fire,
         r.* EXCLUDE (reading_id)
  FROM walk w JOIN readings r ON r.reading_id = w.reading_id WHERE w.rn > 0)"""

# Fused state of classified readings.
def decided_sql(source: str = "classified", signal: str = "0") -> str:
    """Risk, state and decision of the rows of `source`, with one more signal of the risk."""
    return f"""
risked AS (
  SELECT *, CASE WHEN risk > 80 THEN 'FIRE' WHEN risk > 50 THEN 'HIGH_RISK'
                 WHEN risk >= 30 THEN 'WARNING' ELSE 'SAFE' END AS state
  FROM (SELECT *, greatest(
          trunc(least(greatest((temperature - 25.0::DOUBLE) / 45.0::DOUBLE * 60.0::DOUBLE, 0), 60)
              + least(greatest(temp_rate * 60.0::DOUBLE / 15.0::DOUBLE * 40.0::DOUBLE, 0), 40)),
          CASE WHEN flame_raw > 800 THEN 5 WHEN flame_raw > 400 THEN 15
               ELSE least(50 + (400 - flame_raw) * 30 // 400 + flame_digital * 20 // 3, 100)
          END, {signal})::DOUBLE AS risk
        FROM {source})),
fused AS (
  SELECT *, CASE WHEN verdict = 'NORMAL_SUNNY_DAY' THEN 'SAFE'
                 WHEN starts_with(verdict, 'FALSE_ALARM') AND state <> 'FIRE' THEN 'SAFE'
                 WHEN verdict_fire THEN 'FIRE' ELSE state END AS state2,
            CASE WHEN verdict = 'NORMAL_SUNNY_DAY' THEN least(risk, 10)
                 WHEN starts_with(verdict, 'FALSE_ALARM') AND state <> 'FIRE'
                   THEN least(risk, 20)
                 WHEN starts_with(verdict, 'FALSE_ALARM') THEN risk
                 WHEN verdict_fire THEN greatest(risk, 95) ELSE risk END AS risk2
  FROM risked),
decided AS (
  SELECT *, CASE WHEN flame_digital = 1 AND state2 IN ('SAFE', 'WARNING') THEN 'FIRE'
                 ELSE state2 END AS fire_state,
            (CASE WHEN flame_digital = 1 AND state2 IN ('SAFE', 'WARNING')
                  THEN greatest(risk2, 90) ELSE risk2 END)::DOUBLE AS risk_score
  FROM fused)"""


DECIDED = decided_sql()
#: The answers of inputs.given_model, and the decisions that follow them.
ANSWERED = """
answered AS (
  SELECT *, exp(m1) / (exp(m0) + exp(m1) + exp(m2)) AS p_fire,
    CASE WHEN m0 >= m1 AND m0 >= m2 THEN 'NORMAL' WHEN m1 >= m2 THEN 'FIRE' ELSE 'FALSE_ALARM' END
      AS ml_prediction
  FROM (SELECT *, 0.5::DOUBLE AS m0,
          (CASE WHEN temperature <= 30 THEN -1.5 WHEN round(temp_z, 2) <= 3.005 THEN 0.2 ELSE 2.6 END)::DOUBLE
            AS m1,
          (CASE WHEN humidity <= 74 THEN -0.8 ELSE 1.1 END)::DOUBLE AS m2
        FROM classified))"""
DECIDED_BY_MODEL = ANSWERED + "," + decided_sql("answered", "100.0::DOUBLE * p_fire")

DEVICE_SEQ = """
dseq AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_sec, reading_id) AS rn
  FROM readings)"""

EDGE_WALK = (
    DEVICE_SEQ
    + """,
edge AS (
  SELECT device_id, 0::BIGINT AS rn, NULL::BIGINT AS reading_id, NULL::BIGINT AS last_t,
         0.0::DOUBLE AS ema, 0.0::DOUBLE AS rate_per_min, 0.0::DOUBLE AS slow_baseline
  FROM (SELECT DISTINCT device_id FROM readings)
  UNION ALL
  SELECT device_id, rn, reading_id, t_sec, ema, rate,
         CASE WHEN ema < 40 AND rate < 3
              THEN 0.02::DOUBLE * ema + (1.0::DOUBLE - 0.02::DOUBLE) * base ELSE base END
  FROM (
    SELECT *, CASE WHEN t_sec > last_t
                   THEN (ema - was) * 60000.0::DOUBLE / ((t_sec - last_t) * 1000.0::DOUBLE)
                   ELSE 0.0::DOUBLE END AS rate
    FROM (
      SELECT s.device_id, s.rn, s.reading_id, s.t_sec,
             CASE WHEN s.rn = 1 THEN s.t_sec ELSE e.last_t END AS last_t,
             CASE WHEN s.rn = 1 THEN s.temperature ELSE e.ema END AS was,
             CASE WHEN s.rn = 1 THEN s.temperature ELSE e.slow_baseline END AS base,
             0.25::DOUBLE * s.temperature + (1.0::DOUBLE - 0.25::DOUBLE)
               * CASE WHEN s.rn = 1 THEN s.temperature ELSE e.ema END AS ema
      FROM edge e JOIN dseq s ON s.device_id = e.device_id AND s.rn = e.rn + 1))),
edged AS (SELECT * FROM edge WHERE rn > 0)"""
)


def alert_walk(source: str = "stated") -> str:
    """Alert kinds over `source` (needs fire_state), as table `alerted`."""
    return f"""
aseq AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_sec, reading_id) AS arn
  FROM {source}),
arun AS (
  SELECT device_id, 0::BIGINT AS rn, NULL::BIGINT AS reading_id,
         'SAFE'::VARCHAR AS last_state, -1000000000::BIGINT AS alerted_at,
         NULL::VARCHAR AS alert_kind
  FROM (SELECT DISTINCT device_id FROM {source})
  UNION ALL
  SELECT device_id, rn, reading_id, fire_state,
         CASE WHEN kind IS NULL THEN alerted_at ELSE t_sec END, kind
  FROM (
    SELECT s.device_id, s.arn AS rn, s.reading_id, s.fire_state, s.t_sec, a.alerted_at,
           CASE WHEN s.fire_state IN ('HIGH_RISK', 'FIRE') AND s.fire_state <> a.last_state
                  THEN 'TRANSITION'
                WHEN s.fire_state IN ('HIGH_RISK', 'FIRE') AND s.t_sec - a.alerted_at >= 60
                  THEN 'REMINDER'
                WHEN s.fire_state = 'SAFE' AND a.last_state IN ('HIGH_RISK', 'FIRE')
                  THEN 'ALL_CLEAR' END AS kind
    FROM arun a JOIN aseq s ON s.device_id = a.device_id AND s.arn = a.rn + 1)),
alerted AS (
  SELECT a.alert_kind, s.* FROM arun a JOIN aseq s ON s.reading_id = a.reading_id
  WHERE a.rn > 0)"""


def check(body: str, *ctes: str) -> str:
    """A whole statement: the readings view, further CTEs, then the body."""
    return "WITH RECURSIVE " + ",".join([READINGS, *ctes]) + "\n" + body
