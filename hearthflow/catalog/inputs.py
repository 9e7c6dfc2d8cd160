"""Inputs that queries derive from the readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boosting import Boosted, Tree
from ..schema import CLASS_NAMES
from ..session import staged


def stated(r: DataFrame) -> DataFrame:
    """Readings with a given fire state, by value."""
    v = F.col("value")
    return r.withColumn(
        "fire_state",
        F.when(v >= 120, "FIRE").when(v >= 70, "HIGH_RISK").when(v >= 50, "WARNING").otherwise("SAFE"),
    )


def given_model() -> Boosted:
    """A small model with trees written down here, so that SQL can give its answers."""
    fire = Tree()
    hot = fire.split(0, 0, 0, [-1.5, 0.0]) + 1
    fire.split(hot, 2, 0, [0.2, 2.6])
    steam = Tree()
    steam.split(0, 1, 0, [-0.8, 1.1])
    return Boosted(
        features=["temperature", "humidity", "temp_zscore"], classes=list(CLASS_NAMES),
        cuts=[[30.0], [74.0], [3.005]], base=[0.0, 0.0, 0.0],
        rounds=[[Tree(value=[0.5]), fire, steam]], gains=[2.0, 1.0, 1.0],
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def telemetry_posts(r: DataFrame) -> DataFrame:
    """One post per reading; some lack fields, use other names, are broken or empty."""
    k, kind = F.col("k"), F.col("event_type")
    body = F.to_json(
        F.struct(
            F.col("device_id"),
            F.when(k >= 10, F.col("room_id")).alias("room_id"),
            F.when(k >= 5, F.col("flame_raw").cast("string"))
            .when(k >= 3, F.lit("n/a"))
            .alias("flame_raw"),
            F.when((kind == "view") & (k < 95), F.col("temperature").cast("string"))
            .when(kind == "view", F.lit("hot"))
            .alias("temp_c"),
            F.when(kind == "click", F.col("temperature").cast("string")).alias("tempC"),
            F.col("humidity"),
            F.when(kind != "error", F.col("gas_raw").cast("int")).alias("gas_raw"),
            F.when(kind == "error", F.col("gas_raw").cast("int")).alias("gasRaw"),
            F.when(k >= 50, k).alias("smokeRaw"),
            F.col("servo_angle").alias("fire_angle"),
            (F.col("flame_digital") == 1).alias("is_fire"),
        )
    )
    value = (
        F.when((kind == "signup") & (k < 5), F.lit("{}"))
        .when((kind == "signup") & (k < 8), F.lit("not json"))
        .otherwise(body)
    )
    return r.select("reading_id", "event_time", "t_sec", value.alias("value"))


POSTED = """
posted AS (
  SELECT reading_id, t_sec,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 'empty payload'
         WHEN k >= 3 AND k < 5 THEN 'invalid field: flame_raw'
         WHEN event_type = 'view' AND k >= 95 THEN 'invalid field: temperature'
    END AS reason,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 'dev_001' ELSE device_id END AS device_id,
    CASE WHEN (event_type = 'signup' AND k < 8) OR k < 10 THEN 'Kitchen' ELSE room_id END
      AS room_id,
    CASE WHEN k < 5 OR (event_type = 'signup' AND k < 8) THEN 850 ELSE flame_raw END
      AS flame_raw,
    CASE WHEN event_type = 'click' OR (event_type = 'view' AND k < 95)
         THEN temperature ELSE 25.0::DOUBLE END AS temperature,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 55.0::DOUBLE ELSE humidity END AS humidity,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 120 ELSE gas_raw::INTEGER END AS gas_raw,
    CASE WHEN k >= 50 THEN k ELSE 120 END AS smoke_raw,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 90 ELSE servo_angle END AS servo_angle,
    CASE WHEN event_type = 'signup' AND k < 8 THEN 0 ELSE flame_digital END AS flame_digital
  FROM readings)"""


def tree_docs(r: DataFrame) -> DataFrame:
    """Tree documents: device -> readings -> push id, with a node that is not an object."""
    k, kind = F.col("k"), F.col("event_type")
    push = F.concat(F.lit("-N"), F.lpad(F.col("reading_id").cast("string"), 9, "0"))
    node = F.to_json(
        F.struct(
            F.when(k >= 4, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k >= 2, (F.col("t_sec") * 1000).cast("string"))
            .alias("timestamp"),
            F.when(k % 2 == 0, F.col("room_id")).alias("zone_id"),
            F.when(kind != "view", F.col("temperature")).alias("temperature_c"),
            F.when(kind == "view", F.col("temperature")).alias("temperature"),
            F.when(k < 90, F.col("humidity")).alias("humidity"),
            F.when(kind == "click", F.col("pressure")).alias("pressure_hpa"),
            F.col("flame_raw"),
            F.col("flame_voltage"),
            F.when(kind == "error", F.col("flame_digital")).alias("flame_digital"),
            F.col("gas_raw"),
            F.when(k >= 20, F.col("servo_angle")).alias("servo_angle"),
            F.when(kind == "error", F.lit("PENDING_INFERENCE")).alias("ml_prediction"),
        )
    )
    doc = F.concat(
        F.lit('{"devices":{"'), "device_id", F.lit('":{"readings":{"'), push, F.lit('":'), node,
        F.lit(',"'), push, F.lit('x":"gone"}}}}'),
    )
    return r.select("room_id", doc.alias("value"))


TREED = """
treed AS (
  SELECT '-N' || lpad(reading_id::VARCHAR, 9, '0') AS push_id, device_id,
    CASE WHEN k >= 4 THEN strftime(make_timestamp((1704067200 + t_sec) * 1000000),
                                   '%Y-%m-%dT%H:%M:%SZ')
         WHEN k >= 2 THEN (t_sec * 1000)::VARCHAR ELSE '' END AS timestamp,
    CASE WHEN k % 2 = 0 THEN room_id ELSE 'ZONE_1' END AS zone_id,
    'EXP001' AS experiment_id, temperature AS temperature_c,
    CASE WHEN k < 90 THEN humidity END AS humidity_percent, 1013.25::DOUBLE AS pressure_hpa,
    flame_raw::DOUBLE AS flame_raw, flame_voltage,
    CASE WHEN event_type = 'error' THEN flame_digital ELSE 0 END AS flame_digital,
    gas_raw, NULL::DOUBLE AS gas_voltage,
    CASE WHEN k >= 20 THEN servo_angle ELSE 90 END AS servo_angle,
    'NORMAL' AS fire_state, 0.0::DOUBLE AS risk_score,
    CASE WHEN event_type = 'error' THEN 'PENDING_INFERENCE' ELSE 'NORMAL' END
      AS ml_prediction,
    0.0::DOUBLE AS ml_confidence, 'IDLE' AS responder_status, room_id, k, event_type
  FROM readings)"""


def packets(r: DataFrame) -> DataFrame:
    """A stored log of 18-byte packets, some broken, and short legacy ones."""
    k = F.col("k")

    def byte(c):
        return F.lpad(F.hex(c), 2, "0")

    number = F.col("reading_id")
    little = F.concat(
        *[byte(F.shiftright(number, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))) for i in range(4)]
    )
    fire = F.when(F.col("event_type") == "error", 1).otherwise(0)
    head = F.concat(
        byte(F.when(k == 99, 187).otherwise(170)), byte(fire), byte(F.least(k * 2, F.lit(181)))
    )
    zone = F.rpad(F.hex(F.col("room_id")), 16, "0")
    body = F.concat(head, little, byte(k % 5), byte(k), zone)
    codes = [
        F.when(k == 99, 187).otherwise(170), fire, F.least(k * 2, F.lit(181)), k % 5, k,
        *[F.shiftright(number, 8 * i).bitwiseAND(255).cast("int") for i in range(4)],
        *[F.ascii(F.substring("room_id", i + 1, 1)) for i in range(6)],
    ]
    total = reduce(lambda a, b: a.bitwiseXOR(b), codes)
    broken = (F.col("event_type") == "signup") & (k < 10)
    check = F.when(broken, total.bitwiseXOR(F.lit(1))).otherwise(total)
    payload = (
        F.when(F.col("event_type") == "click", F.unhex(F.concat(head, little)))
        .when(F.col("event_type") == "view", F.unhex(F.concat(head, F.lit("00"), little)))
        .otherwise(F.unhex(F.concat(body, byte(check))))
    )
    log = r.select("reading_id", "t_sec", "event_time", "device_id", payload.alias("payload"))
    return staged(log, "packets")


PACKETED = """
packeted AS (
  SELECT reading_id, t_sec, device_id,
    CASE WHEN k = 99 THEN 187 ELSE 170 END AS header, event_type = 'error' AS fire,
    least(k * 2, 181) AS angle, reading_id AS packet_id,
    CASE WHEN long_form THEN k % 5 END AS packet_state, CASE WHEN long_form THEN k END AS risk,
    CASE WHEN long_form THEN room_id END AS zone,
    CASE WHEN long_form THEN CASE WHEN event_type = 'signup' AND k < 10
         THEN xor(total, 1) ELSE total END END AS checksum,
    CASE WHEN NOT long_form THEN k <> 99
         ELSE k <> 99 AND k <= 90 AND NOT (event_type = 'signup' AND k < 10) END AS valid,
    total, long_form
  FROM (SELECT *, event_type NOT IN ('click', 'view') AS long_form,
          xor(xor(xor(xor(xor(xor(xor(xor(xor(xor(xor(xor(
              CASE WHEN k = 99 THEN 187 ELSE 170 END,
              CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), least(k * 2, 181)),
              (reading_id & 255)::INTEGER), ((reading_id >> 8) & 255)::INTEGER),
              ((reading_id >> 16) & 255)::INTEGER), ((reading_id >> 24) & 255)::INTEGER),
              k % 5), k), xor(ascii('R'), xor(ascii('O'), xor(ascii('O'), ascii('M'))))),
              ascii('_')), ascii(right(room_id, 1))), 0) AS total
        FROM readings))"""
