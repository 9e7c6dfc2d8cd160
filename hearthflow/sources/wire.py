"""Wire formats to readings: JSON trees, posts, broker messages and serial lines.

All parsers are Column work, so they apply to batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT = "map<string, variant>"


def _get(node: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{path}", kind)


def reading_tree(df: DataFrame, value: str = "value", root: str | None = None) -> DataFrame:
    """Flatten device -> readings -> push id; nodes that are not objects are skipped.

    `root` names the path below which the devices sit, e.g. "devices". Defaults fill the
    fields of the master export that a reading may lack. Every document is parsed once,
    into a VARIANT, and numbers may come as JSON numbers or as text.
    """
    doc = F.try_parse_json(value)
    devices = _get(doc, root, OBJECT) if root else F.try_variant_get(doc, "$", OBJECT)
    nodes = (
        df.select(F.explode(devices).alias("path_device", "device"))
        .select("path_device", F.explode(_get("device", "readings", OBJECT)).alias("push_id", "r"))
        .filter(F.try_variant_get("r", "$", OBJECT).isNotNull())
    )

    def text(name: str, default=None) -> Column:
        found = _get("r", name, "string")
        return found if default is None else F.coalesce(found, F.lit(default))

    def number(*names: str, default=None, kind: str = "double") -> Column:
        found = [_get("r", n, "double") for n in names]
        if default is not None:
            found.append(F.lit(float(default)))
        return F.coalesce(*found).try_cast(kind)

    # Defaults of the master export.
    fields = {
        "timestamp": text("timestamp", ""),
        "device_id": F.coalesce(text("device_id"), "path_device"),
        "zone_id": text("zone_id", "ZONE_1"),
        "experiment_id": text("experiment_id", "EXP001"),
        "temperature_c": number("temperature_c", "temperature"),
        "humidity_percent": number("humidity_percent", "humidity"),
        "pressure_hpa": number("pressure_hpa", "pressure", default=1013.25),
        "flame_raw": number("flame_raw"),
        "flame_voltage": number("flame_voltage"),
        "flame_digital": number("flame_digital", default=0, kind="int"),
        "gas_raw": number("gas_raw"),
        "gas_voltage": number("gas_voltage"),
        "servo_angle": number("servo_angle", default=90, kind="int"),
        "fire_state": text("fire_state", "NORMAL"),
        "risk_score": number("risk_score", default=0.0),
        "ml_prediction": text("ml_prediction", "NORMAL"),
        "ml_confidence": number("ml_confidence", default=0.0),
        "responder_status": text("responder_status", "IDLE"),
    }
    return nodes.select("push_id", "path_device", *[c.alias(n) for n, c in fields.items()])


def path_fallback(primary: DataFrame, legacy: DataFrame, legacy_only: bool = True) -> DataFrame:
    """Readings of the primary path, and of the legacy path for devices without any.

    With `legacy_only=False` the legacy path counts only when there is no primary
    device at all.
    """
    have = primary.select("path_device").distinct()
    if legacy_only:
        rest = legacy.join(have, "path_device", "left_anti")
    else:
        none_at_all = have.agg(F.count("*") == 0).scalar()
        rest = legacy.filter(none_at_all)
    return primary.unionByName(rest)


def telemetry_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse telemetry posts; `reason` is null for a good post, else why it is rejected.

    A field that is missing takes its default; one that is there but null or not a number
    rejects the post.
    """
    # Field names in order of preference and their defaults.
    numbers = {
        "flame_raw": (("flame_raw",), 850, "int"),
        "servo_angle": (("fire_angle",), 90, "int"),
        "temperature": (("temp_c", "tempC"), 25.0, "double"),
        "humidity": (("humidity",), 55.0, "double"),
        "gas_raw": (("gas_raw", "gasRaw"), 120, "int"),
        "smoke_raw": (("smoke_raw", "smokeRaw"), 120, "int"),
    }
    df = df.withColumn("_body", F.try_parse_json(value))
    df = df.withColumns(
        {
            f"_{name}": F.coalesce(*[_get("_body", n, "variant") for n in names])
            for name, (names, _, _) in numbers.items()
        }
    ).withColumn("_fields", F.size(F.try_variant_get("_body", "$", OBJECT)))
    parsed = {
        name: F.try_variant_get(f"_{name}", "$", kind) for name, (_, _, kind) in numbers.items()
    }
    reason = F.when(F.coalesce(F.col("_fields"), F.lit(0)) < 1, F.lit("empty payload"))
    for name, number in parsed.items():
        reason = reason.when(
            F.col(f"_{name}").isNotNull() & number.isNull(), F.lit(f"invalid field: {name}")
        )
    out = {
        name: F.coalesce(parsed[name], F.lit(default).cast(kind))
        for name, (_, default, kind) in numbers.items()
    }
    lit = F.coalesce(_get("_body", "is_fire", "boolean"), F.lit(False))
    return df.withColumns(
        {
            **out,
            "flame_digital": lit.cast("int"),
            "device_id": F.coalesce(_get("_body", "device_id", "string"), F.lit("dev_001")),
            "room_id": F.coalesce(
                _get("_body", "room_id", "string"),
                _get("_body", "zone_id", "string"),
                F.lit("Kitchen"),
            ),
            "reason": reason,
        }
    ).drop("_body", "_fields", *[f"_{n}" for n in numbers])


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("reason is null").drop("reason"), parsed.filter("reason is not null")


MQTT = (
    "deviceId string, roomId string, recordedAt string, temperature double, humidity double, "
    "smoke int, co int, co2 int, battery int, signalStrength int, temperatureRate double, "
    "dataSource string, gasRaw int, flameDetected boolean, edgeRiskScore int, edgeStatus string"
)


def mqtt_parsed(df: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Broker messages with `reason`, which is null for readings: device from the topic
    `<prefix>devices/<device>/telemetry`, else from the message."""
    from_topic = F.regexp_extract(topic, r"devices/([^/]+)/telemetry$", 1)
    text = F.col(value).cast("string")
    m = F.from_json(text, f"{MQTT}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    device = F.coalesce(F.nullif(from_topic, F.lit("")), "m.deviceId")
    measured = F.coalesce(
        *[F.col(f"m.{c}").cast("string") for c in ("temperature", "humidity", "smoke", "gasRaw")],
        F.col("m.flameDetected").cast("string"),
        "m.recordedAt",
    )
    reason = (
        F.when(F.coalesce(F.btrim(text), F.lit("")) == "", "empty message")
        .when(F.col("m").isNull() | F.col("m._broken").isNotNull(), "malformed message")
        .when(measured.isNull(), "no values")
        .when(device.isNull(), "no device")
    )
    return df.withColumn("m", m).select(
        device.alias("device_id"),
        F.col("m.roomId").alias("room_id"),
        F.try_to_timestamp("m.recordedAt").alias("event_time"),
        "m.temperature",
        "m.humidity",
        F.col("m.smoke").alias("smoke_raw"),
        F.col("m.gasRaw").alias("gas_raw"),
        F.col("m.flameDetected").cast("int").alias("flame_digital"),
        F.col("m.temperatureRate").alias("rate_per_min"),
        F.col("m.edgeRiskScore").alias("risk"),
        F.col("m.edgeStatus").alias("status"),
        reason.alias("reason"),
        text.alias("message"),
    )


def mqtt_json(df: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """The readings among broker messages; mqtt_rejects has the others."""
    return mqtt_parsed(df, topic, value).filter("reason is null").drop("reason", "message")


def mqtt_rejects(df: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """(device_id, reason, message) of broker messages that are no readings."""
    parsed = mqtt_parsed(df, topic, value).filter("reason is not null")
    return parsed.select("device_id", "reason", "message")


CSV_LINE = (
    "device_id string, room_id string, temperature double, humidity double, gas_raw int, "
    "flame_digital int, rate_per_min double, risk int, status string"
)
JSON_LINE = (
    "deviceId string, roomId string, temperature double, humidity double, gasRaw int, "
    "flameDetected boolean, temperatureRate double, riskScore int, status string"
)


def tagged_lines(df: DataFrame, line: str = "line", tag: str = "CSV") -> DataFrame:
    """Readings of the `CSV,` or `JSON,` lines of a serial log; banner lines fall away.

    A node prints each sample in both forms, so one of them is read.
    """
    text = F.btrim(F.col(line), F.lit(" \t\r\n"))
    kept = df.filter(text.startswith(f"{tag},")).withColumn(
        "_rest", F.substr(text, F.lit(len(tag) + 2), F.length(text))
    )
    if tag == "CSV":
        out = kept.withColumn("r", F.from_csv("_rest", CSV_LINE)).select("r.*")
    else:
        out = kept.withColumn("r", F.from_json("_rest", JSON_LINE)).select(
            F.col("r.deviceId").alias("device_id"),
            F.col("r.roomId").alias("room_id"),
            "r.temperature",
            "r.humidity",
            F.col("r.gasRaw").alias("gas_raw"),
            F.col("r.flameDetected").cast("int").alias("flame_digital"),
            F.col("r.temperatureRate").alias("rate_per_min"),
            F.col("r.riskScore").alias("risk"),
            "r.status",
        )
    return out.filter("device_id is not null")


def serial_csv(
    df: DataFrame,
    session: str,
    condition: str = "NORMAL",
    distance: str = "",
    orientation: str = "",
    notes: str = "",
    line: str = "line",
    received_at: Column | None = None,
) -> DataFrame:
    """Four-field flame lines; the header, blanks and lines with other than digits in the
    time or level field are dropped. Session details go on every row."""
    if condition not in ("NORMAL", "FLAME", "RECOVERY", "NOISE", "UNKNOWN"):
        raise ValueError(f"unknown condition {condition}")
    part = F.split(F.btrim(F.col(line), F.lit(" \t\r\n")), ",")
    digits = r"^[0-9]+$"
    return (
        df.withColumn("p", part)
        .filter(F.size("p") == 4)
        .filter(F.col("p")[0].rlike(digits) & F.col("p")[3].rlike(digits))
        .select(
            (F.current_timestamp() if received_at is None else received_at).alias("pc_timestamp"),
            F.col("p")[0].alias("esp_timestamp_ms"),
            F.col("p")[1].alias("device_id"),
            F.col("p")[2].alias("room_id"),
            F.col("p")[3].alias("flame_raw"),
            F.lit(session).alias("session_id"),
            F.lit(condition).alias("condition"),
            F.lit(distance).alias("distance"),
            F.lit(orientation).alias("orientation"),
            F.lit(notes).alias("notes"),
        )
    )
