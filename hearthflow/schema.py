"""Canonical column names, alias dialects and the fixed vocabularies of the readings."""

from __future__ import annotations

# The names each channel goes by on the wire, canonical name first.
ALIASES: dict[str, tuple[str, ...]] = {
    "reading_id": ("reading_id", "push_id"),
    "timestamp": ("timestamp", "pc_timestamp", "recordedAt"),
    "device_id": ("device_id", "device", "deviceId"),
    "room_id": ("room_id", "room", "zone_id", "roomId"),
    "experiment_id": ("experiment_id",),
    "temperature": ("temperature", "temp", "temp_c", "tempC", "temperature_c"),
    "humidity": ("humidity", "hum", "humidity_percent"),
    "pressure": ("pressure", "pressure_hpa"),
    "gas_raw": ("gas_raw", "gas", "gasRaw"),
    "gas_voltage": ("gas_voltage",),
    "smoke_raw": ("smoke_raw", "smokeRaw"),
    "flame_raw": ("flame_raw", "flame", "flameRaw"),
    "flame_voltage": ("flame_voltage",),
    "flame_digital": ("flame_digital", "is_fire"),
    "servo_angle": ("servo_angle", "fire_angle", "fireAngle"),
    "edge_state": ("edge_state", "fire_state"),
    "risk_score": ("risk_score",),
    "ml_prediction": ("ml_prediction",),
    "ml_confidence": ("ml_confidence",),
    "responder_status": ("responder_status",),
}

# What a missing channel counts as when readings reach the room baseline.
BASELINE_DEFAULTS = {
    "temperature": 25.0,
    "humidity": 50.0,
    "pressure": 1013.25,
    "gas_raw": 1500.0,
    "gas_voltage": 0.5,
    "flame_raw": 15000.0,
    "flame_voltage": 3.0,
    "flame_digital": 0,
}

# The master export, 18 columns in this order.
MASTER_COLUMNS = (
    "timestamp",
    "device_id",
    "zone_id",
    "experiment_id",
    "temperature_c",
    "humidity_percent",
    "pressure_hpa",
    "flame_raw",
    "flame_voltage",
    "flame_digital",
    "gas_raw",
    "gas_voltage",
    "servo_angle",
    "fire_state",
    "risk_score",
    "ml_prediction",
    "ml_confidence",
    "responder_status",
)

# Columns that are numbers, and those a row must have.
NUMERIC_COLUMNS = (
    "temperature",
    "humidity",
    "pressure",
    "flame_raw",
    "flame_voltage",
    "gas_raw",
    "gas_voltage",
    "flame_digital",
    "servo_angle",
)
CRITICAL_COLUMNS = ("temperature", "gas_raw", "flame_raw")

# Sanity bounds of the cleaning step.
BOUNDS = {
    "temperature": (-20.0, 120.0),
    "humidity": (0.0, 100.0),
    "gas_voltage": (0.0, 5.0),
    "flame_voltage": (0.0, 5.0),
}

# The calibrated training features.
FEATURES = (
    "temperature",
    "room_baseline_temp",
    "delta_temp_from_baseline",
    "temp_rate_of_change_c_per_sec",
    "temp_zscore",
    "gas_raw",
    "gas_voltage",
    "room_baseline_gas",
    "delta_gas_from_baseline",
    "gas_rate_of_change_per_sec",
    "gas_zscore",
    "flame_raw",
    "flame_voltage",
    "flame_digital",
    "humidity",
    "pressure",
)

# Verdict text to training class, and the class names.
LABELS = {
    "NORMAL": 0,
    "NORMAL_SUNNY_DAY": 0,
    "FALSE_ALARM_STEAM": 2,
    "FALSE_ALARM_COOKING_GAS": 2,
    "PRE_FIRE_WARNING": 1,
    "ACTUAL_FIRE": 1,
    "FIRE": 1,
    "FALSE_ALARM": 2,
}
CLASS_NAMES = {0: "NORMAL", 1: "FIRE", 2: "FALSE_ALARM"}
# Columns that may hold a label, in order, and the states of a device.
LABEL_COLUMNS = ("ai_classification_verdict", "fire_state", "label")
FIRE_STATES = ("SAFE", "WARNING", "HIGH_RISK", "FIRE")
DANGER = ("HIGH_RISK", "FIRE")
