"""Sources, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalise as n
from ..schema import MASTER_COLUMNS
from ..session import staging_path
from ..sources import files, packets as packet_source, wire
from ..sources.fixture import readings
from . import inputs
from .inputs import PACKETED, POSTED, TREED
from .registry import query
from .sql import check

TREE_COLUMNS = ("push_id", "device_id", *(c for c in MASTER_COLUMNS if c != "device_id"))


def tree(r):
    return wire.reading_tree(inputs.tree_docs(r), root="devices")


@query(check(f"SELECT {', '.join(TREE_COLUMNS)} FROM treed", TREED))
def src_reading_tree(spark, sf):
    return tree(readings(spark, sf)).select(*TREE_COLUMNS)


@query(
    check(
        "SELECT push_id, device_id, temperature_c, CASE WHEN room_id >= 'ROOM_5' THEN 'legacy' "
        "ELSE 'primary' END AS path FROM treed",
        TREED,
    )
)
def src_path_fallback(spark, sf):
    r = readings(spark, sf)
    legacy = tree(r).withColumn("path", F.lit("legacy"))
    primary = tree(r.filter("room_id < 'ROOM_5'")).withColumn("path", F.lit("primary"))
    return wire.path_fallback(primary, legacy).select(
        "push_id", "device_id", "temperature_c", "path"
    )


POST_COLUMNS = (
    "reading_id", "reason", "device_id", "room_id", "flame_raw", "temperature", "humidity",
    "gas_raw", "smoke_raw", "servo_angle", "flame_digital",
)


@query(
    check(
        "SELECT reading_id, reason, CASE WHEN reason IS NULL THEN device_id END AS device_id, "
        + ", ".join(
            f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in POST_COLUMNS[3:]
        )
        + " FROM posted",
        POSTED,
    )
)
def src_telemetry_json(spark, sf):
    """Accepted and rejected posts in one pass; a rejected post keeps its reason only."""
    parsed = wire.telemetry_json(inputs.telemetry_posts(readings(spark, sf)))
    good = F.col("reason").isNull()
    return parsed.select(
        "reading_id", "reason", *[F.when(good, F.col(c)).alias(c) for c in POST_COLUMNS[2:]]
    )


@query(
    check(
        "SELECT reading_id, device_id, room_id, t_sec + 1704067200 AS epoch, temperature, "
        "humidity, gas_raw::INTEGER AS gas_raw, flame_digital, k AS risk FROM readings"
    )
)
def src_mqtt_json(spark, sf):
    r = readings(spark, sf)
    message = F.to_json(
        F.struct(
            F.lit("ignored").alias("deviceId"),
            F.col("room_id").alias("roomId"),
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recordedAt"),
            "temperature",
            "humidity",
            F.col("gas_raw").cast("int").alias("smoke"),
            F.col("gas_raw").cast("int").alias("gasRaw"),
            (F.col("flame_digital") == 1).alias("flameDetected"),
            F.col("k").alias("edgeRiskScore"),
            F.col("reading_id").cast("string").alias("edgeStatus"),
        )
    )
    topic = F.concat(F.lit("site/v1/devices/"), "device_id", F.lit("/telemetry"))
    parsed = wire.mqtt_json(r.select(topic.alias("topic"), message.alias("value")))
    return parsed.select(
        F.col("status").cast("bigint").alias("reading_id"),
        "device_id",
        "room_id",
        F.unix_seconds("event_time").alias("epoch"),
        "temperature",
        "humidity",
        "gas_raw",
        "flame_digital",
        "risk",
    )


def serial_lines(r):
    fields = [
        "device_id", "room_id", "temperature", "humidity", F.col("gas_raw").cast("int"),
        "flame_digital", F.lit(0.5), "k", F.col("reading_id"),
    ]
    csv_line = F.concat_ws(",", F.lit("CSV"), *[F.col(f) if isinstance(f, str) else f for f in fields])
    body = F.to_json(
        F.struct(
            F.col("device_id").alias("deviceId"),
            F.col("room_id").alias("roomId"),
            "temperature",
            "humidity",
            F.col("gas_raw").cast("int").alias("gasRaw"),
            (F.col("flame_digital") == 1).alias("flameDetected"),
            F.lit(0.5).alias("temperatureRate"),
            F.col("k").alias("riskScore"),
            F.col("reading_id").cast("string").alias("status"),
        )
    )
    lines = F.array(
        F.lit("========"), F.concat(F.lit("Temperature : "), F.col("temperature")), csv_line,
        F.concat(F.lit("JSON,"), body),
    )
    return r.select(F.explode(lines).alias("line"))


@query(
    check(
        "SELECT tag, reading_id::VARCHAR AS status, device_id, room_id, temperature, humidity, "
        "gas_raw::INTEGER AS gas_raw, flame_digital, 0.5::DOUBLE AS rate_per_min, k AS risk "
        "FROM readings CROSS JOIN (VALUES ('CSV'), ('JSON')) AS tags(tag)"
    )
)
def src_tagged_lines(spark, sf):
    lines = serial_lines(readings(spark, sf))
    return (
        wire.tagged_lines(lines, tag="CSV")
        .withColumn("tag", F.lit("CSV"))
        .unionByName(wire.tagged_lines(lines, tag="JSON").withColumn("tag", F.lit("JSON")))
    )


@query(
    check(
        "SELECT t_sec::VARCHAR AS esp_timestamp_ms, device_id, room_id, "
        "flame_raw::VARCHAR AS flame_raw, 'FLAME_TEST_001' AS session_id, "
        "'FLAME' AS condition, '1m' AS distance, '' AS orientation, '' AS notes "
        "FROM readings WHERE k >= 15"
    )
)
def src_serial_csv(spark, sf):
    r = readings(spark, sf)
    k = F.col("k")

    def line(at, level):
        return F.concat_ws(",", at, "device_id", "room_id", level)

    t, flame = F.col("t_sec").cast("string"), F.col("flame_raw").cast("string")
    text = (
        F.when(k < 3, F.lit("timestamp_ms,device_id,room_id,flame_raw"))
        .when(k < 6, F.lit("  "))
        .when(k < 9, F.concat_ws(",", t, "device_id", flame))
        .when(k < 12, line(F.concat(F.lit("-"), t), flame))
        .when(k < 15, line(t, F.concat(flame, F.lit(".5"))))
        .otherwise(F.concat(line(t, flame), F.lit("\r")))
    )
    return wire.serial_csv(
        r.select(text.alias("line"), "event_time"),
        session="FLAME_TEST_001",
        condition="FLAME",
        distance="1m",
        received_at=F.col("event_time"),
    ).drop("pc_timestamp")


@query(
    check(
        "SELECT reading_id::VARCHAR AS reading_id, room_id, "
        "least(temperature * 4, 120) AS temperature, humidity, gas_raw, "
        "temperature * 4 > 120 AS was_clamped "
        "FROM readings WHERE k >= 5"
    )
)
def src_dataset_csv(spark, sf):
    path = staging_path(spark, "dataset")
    readings(spark, sf).select(
        "reading_id",
        F.col("device_id").alias("device"),
        F.col("room_id").alias("room"),
        (F.col("temperature") * 4).alias("temp"),
        F.col("humidity").alias("hum"),
        F.when(F.col("k") >= 5, F.col("gas_raw").cast("string")).otherwise(F.lit("bad")).alias("gas"),
        F.col("flame_raw").alias("flame"),
    ).write.option("header", True).csv(path)
    return files.clean_dataset(spark, path).select(
        "reading_id", "room_id", "temperature", "humidity", "gas_raw", "was_clamped"
    )


@query(
    check(
        "SELECT reading_id, header, fire, angle, packet_id, packet_state, risk, zone, checksum, "
        "valid FROM packeted",
        PACKETED,
    )
)
def src_packet_log(spark, sf):
    return packet_source.packet_log(inputs.packets(readings(spark, sf))).select(
        "reading_id", "header", "fire", "angle", "packet_id", "packet_state", "risk", "zone",
        "checksum", "valid",
    )


@query(check("SELECT reading_id, angle FROM packeted WHERE valid AND long_form", PACKETED))
def filter_packet_valid(spark, sf):
    decoded = packet_source.packet_log(inputs.packets(readings(spark, sf)), accept_legacy=False)
    return decoded.filter("valid").select("reading_id", "angle")


@query(check("SELECT reading_id, total AS checksum FROM packeted WHERE long_form", PACKETED))
def agg_packet_checksum(spark, sf):
    return (
        packet_source.packet_log(inputs.packets(readings(spark, sf)))
        .filter(F.length("payload") == packet_source.FULL)
        .select("reading_id", F.col("computed_checksum").alias("checksum"))
    )


def dialects(r):
    """Each event type names its channels in its own way."""
    kind = F.col("event_type")

    def only(types, c):
        return F.when(kind.isin(*types), F.col(c))

    return r.select(
        F.col("reading_id").alias("push_id"),
        only(["view"], "device_id").alias("device"),
        only(["click"], "device_id").alias("deviceId"),
        only(["error", "purchase", "signup"], "device_id").alias("device_id"),
        only(["view", "click"], "room_id").alias("zone_id"),
        only(["error"], "room_id").alias("roomId"),
        only(["view"], "temperature").alias("temp_c"),
        only(["click"], "temperature").alias("tempC"),
        only(["error", "signup"], "temperature").alias("temperature_c"),
        only(["view", "purchase"], "humidity").alias("humidity_percent"),
        only(["error"], "humidity").alias("hum"),
        only(["view", "click", "error"], "gas_raw").alias("gasRaw"),
        F.col("flame_raw").alias("flameRaw"),
    )


@query(
    check(
        """SELECT reading_id, device_id,
             CASE WHEN event_type IN ('view', 'click', 'error') THEN room_id ELSE 'ROOM_1' END
               AS room_id,
             CASE WHEN event_type <> 'purchase' THEN temperature ELSE 25.0::DOUBLE END
               AS temperature,
             CASE WHEN event_type IN ('view', 'purchase', 'error') THEN humidity
                  ELSE 50.0::DOUBLE END AS humidity,
             CASE WHEN event_type IN ('view', 'click', 'error') THEN gas_raw
                  ELSE 1500.0::DOUBLE END AS gas_raw, flame_raw
           FROM readings"""
    )
)
def proj_alias_normalise(spark, sf):
    return n.alias_normalise(
        dialects(readings(spark, sf)),
        defaults={"temperature": 25.0, "humidity": 50.0, "gas_raw": 1500.0, "room_id": "ROOM_1"},
    )


@query(
    check(
        """SELECT reading_id, CASE WHEN k >= 30 THEN temperature END AS temperature,
                  CASE WHEN k < 90 THEN flame_raw::DOUBLE END AS flame_raw
           FROM readings"""
    )
)
def proj_numeric_coerce(spark, sf):
    r = readings(spark, sf)
    k = F.col("k")
    messy = r.select(
        "reading_id",
        F.when(k < 10, F.lit("n/a"))
        .when(k < 20, F.lit(""))
        .when(k < 25, F.lit("nan"))
        .when(k < 30, F.concat(F.col("temperature"), F.lit("d")))
        .otherwise(F.concat(F.lit(" "), F.col("temperature")))
        .alias("temperature"),
        F.when(k >= 90, F.lit("-")).otherwise(F.col("flame_raw").cast("string")).alias("flame_raw"),
    )
    return n.numeric_coerce(messy)


def gappy(r):
    k = F.col("k")
    return r.select(
        *[
            F.when(k >= limit, F.col(c)).alias(c)
            for c, limit in (
                ("reading_id", 5), ("temperature", 10), ("gas_raw", 20), ("flame_raw", 30),
                ("humidity", 40),
            )
        ]
    )


@query(
    check(
        "SELECT reading_id, CASE WHEN k >= 10 THEN temperature END AS temperature, "
        "CASE WHEN k >= 20 THEN gas_raw END AS gas_raw, "
        "CASE WHEN k >= 30 THEN flame_raw END AS flame_raw, "
        "CASE WHEN k >= 40 THEN humidity END AS humidity FROM readings WHERE k >= 5"
    )
)
def filter_drop_empty(spark, sf):
    return n.drop_empty(gappy(readings(spark, sf)))


@query(
    check(
        "SELECT reading_id, temperature, gas_raw, flame_raw, "
        "CASE WHEN k >= 40 THEN humidity END AS humidity FROM readings WHERE k >= 30"
    )
)
def filter_critical_present(spark, sf):
    return n.critical_present(gappy(readings(spark, sf)))


@query(
    check(
        """SELECT reading_id, CASE WHEN k < 95 THEN
                    least(greatest(temperature * 6 - 110, -20), 120) END AS temperature,
                  least(greatest(humidity * 2 - 85, 0), 100) AS humidity,
                  least(gas_raw / 300.0::DOUBLE, 5) AS gas_voltage,
                  (k < 95 AND (temperature * 6 - 110 < -20 OR temperature * 6 - 110 > 120))
                  OR humidity * 2 - 85 < 0 OR humidity * 2 - 85 > 100
                  OR gas_raw / 300.0::DOUBLE > 5 AS was_clamped
           FROM readings"""
    )
)
def proj_clamp_bounds(spark, sf):
    wild = readings(spark, sf).select(
        "reading_id",
        F.when(F.col("k") < 95, F.col("temperature") * 6.0 - 110.0).alias("temperature"),
        (F.col("humidity") * 2.0 - 85.0).alias("humidity"),
        (F.col("gas_raw") / 300.0).alias("gas_voltage"),
    )
    return n.clamp_bounds(wild)


@query(
    check(
        "SELECT reading_id, CASE WHEN k >= 30 THEN room_id WHEN k >= 10 THEN device_id "
        "ELSE 'ROOM_1' END AS room_id FROM readings"
    )
)
def proj_room_default(spark, sf):
    k = F.col("k")
    r = readings(spark, sf).select(
        "reading_id",
        F.when(k >= 30, F.col("room_id")).alias("room_id"),
        F.when(k >= 10, F.col("device_id")).alias("device_id"),
    )
    return n.room_default(r).select("reading_id", "room_id")


@query(
    check(
        """SELECT reading_id, air AND light AS sensors_valid,
                  CASE WHEN air THEN t ELSE 0 END AS temperature,
                  CASE WHEN light THEN flame ELSE 0 END AS flame_raw
           FROM (SELECT reading_id, temperature * 3 AS t, flame_raw - 100 AS flame,
                        k >= 5 AND temperature * 3 <= 85 AS air, flame_raw >= 100 AS light
                 FROM readings)"""
    )
)
def proj_validity_flag(spark, sf):
    r = readings(spark, sf).select(
        "reading_id",
        (F.col("temperature") * 3.0).alias("temperature"),
        F.when(F.col("k") >= 5, F.col("humidity")).otherwise(F.lit(float("nan"))).alias("humidity"),
        "pressure",
        (F.col("flame_raw") - 100).alias("flame_raw"),
        "gas_raw",
    )
    return n.validity_flag(r).select("reading_id", "sensors_valid", "temperature", "flame_raw")


@query(check("SELECT reading_id FROM readings WHERE k >= 8"))
def filter_valid_reading(spark, sf):
    nan = F.lit(float("nan"))
    r = readings(spark, sf).select(
        "reading_id",
        F.when(F.col("k") >= 5, F.col("temperature")).otherwise(nan).alias("temperature"),
        F.when(F.col("k") >= 8, F.col("humidity")).otherwise(nan).alias("humidity"),
    )
    return n.valid_reading(r).select("reading_id")


@query(
    check(
        "SELECT reading_id, gas_raw * 0.000125::DOUBLE / 0.6::DOUBLE AS gas_voltage, "
        "flame_raw * 0.000125::DOUBLE / 0.6::DOUBLE AS flame_voltage FROM readings"
    )
)
def proj_adc_to_volts(spark, sf):
    return readings(spark, sf).select(
        "reading_id",
        n.adc_to_volts("gas_raw").alias("gas_voltage"),
        n.adc_to_volts("flame_raw").alias("flame_voltage"),
    )


@query(check("SELECT reading_id, gas_raw::INTEGER // 4 AS raw10 FROM readings"))
def proj_adc_rescale(spark, sf):
    return readings(spark, sf).select("reading_id", n.adc_rescale("gas_raw").alias("raw10"))


@query(
    check(
        """SELECT reading_id,
             CASE WHEN k >= 30 AND k < 60 THEN t_sec + 1704067200 - 7200
                  WHEN k >= 60 THEN t_sec + 1704067200 END AS epoch,
             CASE WHEN k >= 10 AND k < 20 THEN t_sec * 1000 END AS uptime_ms
           FROM readings"""
    )
)
def proj_event_time(spark, sf):
    k, iso = F.col("k"), "yyyy-MM-dd'T'HH:mm:ss"
    text = (
        F.when(k < 5, F.lit(""))
        .when(k < 10, F.lit("soon"))
        .when(k < 20, (F.col("t_sec") * 1000).cast("string"))
        .when(k < 30, F.lit("1970-01-01T00:00:05Z"))
        .when(k < 60, F.concat(F.date_format("event_time", iso), F.lit("+02:00")))
        .otherwise(F.concat(F.date_format("event_time", iso), F.lit("Z")))
    )
    r = readings(spark, sf).select("reading_id", "event_time", text.alias("timestamp"))
    return n.event_time(r.select("reading_id", "timestamp")).select(
        "reading_id", F.unix_seconds("event_time").alias("epoch"), "uptime_ms"
    )


@query(check("SELECT reading_id FROM readings WHERE event_type IN ('view', 'click', 'error')"))
def filter_pending_inference(spark, sf):
    kind = F.col("event_type")
    r = readings(spark, sf).withColumn(
        "ml_prediction",
        F.when(kind == "view", "PENDING_INFERENCE").when(kind == "click", "").when(
            kind.isin("purchase", "signup"), "NORMAL"
        ),
    )
    return n.pending_inference(r).select("reading_id")


@query(
    check(
        """SELECT reading_id, least(greatest(servo_angle + 7, 5), 175) AS aim,
                  least(greatest(180 - servo_angle, 5), 175) AS aim_reversed FROM readings"""
    )
)
def proj_aim_angle(spark, sf):
    return readings(spark, sf).select(
        "reading_id",
        n.aim_angle("servo_angle", offset=7).alias("aim"),
        n.aim_angle("servo_angle", reverse=True).alias("aim_reversed"),
    )


@query(
    check(
        """SELECT reading_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1
             WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS label FROM readings"""
    )
)
def proj_label_map(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "normal_sunny_day")
        .when(kind == "click", "Actual_Fire")
        .when(kind == "error", "FALSE_ALARM_STEAM")
        .when(kind == "purchase", "PRE_FIRE_WARNING")
        .otherwise("CRITICAL")
    )
    return readings(spark, sf).select("reading_id", n.label_map(text).alias("label"))


