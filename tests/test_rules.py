"""Rules at their boundaries, and the scenarios of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from hearthflow.operators import alerts, normalise, reports, rules, timeline
from hearthflow.plans.calibrate import batch_calibrate, classify


def one(df, *columns):
    row = df.select(*columns).first()
    return tuple(row) if len(columns) > 1 else row[0]


VERDICTS = [
    # flame pin, volts, rise, rate, gas z, humidity rise, temp -> verdict, risk
    ((1, 3.0, 2.1, 0.0, 0.0, 0.0, 20.0), ("ACTUAL_FIRE", 98.0)),
    ((1, 3.0, 2.0, 0.15, 2.0, 0.0, 20.0), ("ACTUAL_FIRE", 92.0)),
    ((0, 1.59, 0.0, 0.0, 0.0, 0.0, 20.0), ("ACTUAL_FIRE", 92.0)),
    ((0, 1.6, 0.0, 0.0, 0.0, 0.0, 20.0), ("NORMAL", 0.0)),
    ((0, 3.0, 4.6, 0.41, 3.1, 0.0, 20.0), ("ACTUAL_FIRE", 88.0)),
    ((0, 3.0, 4.5, 0.41, 3.1, 0.0, 20.0), ("NORMAL", 30.0)),
    ((0, 3.0, 0.0, 0.079, 1.99, 0.0, 28.1), ("NORMAL_SUNNY_DAY", 5.0)),
    ((0, 3.0, 0.0, 0.08, 1.0, 0.0, 28.1), ("NORMAL", 3.0)),
    ((0, 3.0, 0.0, 0.0, 1.0, 0.0, 28.0), ("NORMAL", 3.0)),
    ((0, 3.0, 0.0, 0.0, 1.49, 15.1, 20.0), ("FALSE_ALARM_STEAM", 12.0)),
    ((0, 3.0, 0.0, 0.0, 1.5, 15.1, 20.0), ("NORMAL", 4.5)),
    ((0, 3.0, 1.49, 0.05, 2.51, 0.0, 20.0), ("FALSE_ALARM_COOKING_GAS", 25.0)),
    ((0, 3.0, 1.5, 0.05, 2.51, 0.0, 20.0), ("NORMAL", 15.03)),
    ((0, 3.0, 2.01, 0.0, 3.51, 0.0, 20.0), ("PRE_FIRE_WARNING", 65.0)),
    ((0, 3.0, 2.0, 0.1, 3.6, 0.0, 20.0), ("NORMAL", 20.8)),
]


def test_verdict_chain(rows):
    names = ("flame_digital", "flame_voltage", "rise", "temp_rate", "z", "damp", "temperature")
    df = rows(
        ", ".join(f"{n} {'int' if n == 'flame_digital' else 'double'}" for n in names) + ", i int",
        [(*given, i) for i, (given, _) in enumerate(VERDICTS)],
    ).select(
        "*",
        (F.col("temperature") - F.col("rise")).alias("temp_mean_before"),
        F.lit(1.0).alias("temp_std_before"),
        F.col("z").alias("gas_raw"),
        F.lit(0.0).alias("gas_mean_before"),
        F.lit(1.0).alias("gas_std_before"),
        F.col("damp").alias("humidity"),
        F.lit(0.0).alias("humidity_mean_before"),
    )
    out = rules.fusion_verdict(df).orderBy("i").collect()
    for r, (given, (verdict, risk)) in zip(out, VERDICTS):
        assert r["verdict"] == verdict, given
        if verdict != "NORMAL":
            assert r["verdict_risk"] == risk


@pytest.mark.parametrize(
    "temp, rate, status",
    [
        (39.9, 2.9, "SAFE"), (40.0, 0.0, "WARNING"), (0.0, 3.0, "WARNING"),
        (55.0, 0.0, "HIGH_RISK"), (0.0, 8.0, "HIGH_RISK"), (70.0, 0.0, "FIRE"), (0.0, 15.0, "FIRE"),
    ],
)
def test_thermal_status(spark, temp, rate, status):
    assert one(spark.range(1), rules.thermal_status(F.lit(temp), F.lit(rate))) == status


@pytest.mark.parametrize(
    "raw, held, risk",
    [(801, 0, 5), (800, 0, 15), (401, 0, 15), (400, 0, 50), (0, 3, 100), (200, 1, 71), (399, 0, 50)],
)
def test_flame_risk(spark, raw, held, risk):
    assert one(spark.range(1), rules.flame_risk(F.lit(raw), F.lit(held))) == risk


def test_thermal_risk_truncates(spark):
    assert one(spark.range(1), rules.thermal_risk(F.lit(47.5), F.lit(7.5))) == 50
    assert one(spark.range(1), rules.thermal_risk(F.lit(25.9), F.lit(-3.0))) == 1


def test_decision_fusion(rows):
    cases = [
        ("FIRE", 99.0, "NORMAL_SUNNY_DAY", False, 0, "SAFE", 10.0),
        ("FIRE", 99.0, "FALSE_ALARM_STEAM", False, 0, "FIRE", 99.0),
        ("HIGH_RISK", 60.0, "FALSE_ALARM_STEAM", False, 0, "SAFE", 20.0),
        ("SAFE", 5.0, "ACTUAL_FIRE", True, 0, "FIRE", 95.0),
        ("WARNING", 40.0, "NORMAL", False, 1, "FIRE", 90.0),
        ("HIGH_RISK", 60.0, "NORMAL", False, 1, "HIGH_RISK", 60.0),
        ("SAFE", 4.0, "NORMAL_SUNNY_DAY", False, 1, "FIRE", 90.0),
    ]
    df = rows(
        "state string, risk double, verdict string, verdict_fire boolean, flame_digital int, "
        "want_state string, want_risk double",
        cases,
    )
    for r in rules.decision_fusion(df).collect():
        assert (r["fire_state"], r["risk_score"]) == (r["want_state"], r["want_risk"])


@pytest.fixture(scope="module")
def scenarios(spark):
    """Hot room, steam, then fire: 120 readings at 1 Hz."""
    i = F.col("id")
    s = i - 70
    sunny, steam = i < 40, i < 70
    return spark.range(120).select(
        i.alias("reading_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + i).alias("event_time"),
        F.lit("node-1").alias("device_id"),
        F.when(sunny, "LivingRoom_Sunny").otherwise("Kitchen").alias("room_id"),
        F.when(sunny, 31.0 + i * 0.06).when(steam, 27.5 + (i - 40) * 0.03)
        .otherwise(32.0 + s * 0.8).alias("temperature"),
        F.when(sunny, 45.0).when(steam, 82.0).otherwise(30.0).alias("humidity"),
        F.when(sunny, 1400 + i * 2).when(steam, 2200).otherwise(2500 + s * 350)
        .cast("double").alias("gas_raw"),
        F.when(sunny, 3.1).when(steam, 3.0).otherwise(F.greatest(3.0 - s * 0.15, F.lit(0.2)))
        .alias("flame_voltage"),
        F.when(s > 3, 1).otherwise(0).alias("flame_digital"),
    )


def test_scenario_counts(scenarios):
    got = {r["verdict"]: r["n"] for r in reports.verdict_breakdown(classify(scenarios)).collect()}
    assert got == {
        "ACTUAL_FIRE": 49, "NORMAL": 39, "NORMAL_SUNNY_DAY": 30, "PRE_FIRE_WARNING": 2,
    }
    risks = classify(scenarios).filter("verdict_fire").groupBy("verdict_risk").count().collect()
    assert {r[0]: r[1] for r in risks} == {98.0: 46, 88.0: 3}


@pytest.mark.parametrize(
    "i, verdict, risk, base, rise, rate, temp_z, gas_z",
    [
        (0, "NORMAL_SUNNY_DAY", 5.0, 31.0, 6.0, 0.0, 6.0, -10.0),
        (17, "NORMAL", 11.3, 31.09, 0.942, 0.06, 0.99, 2.09),
        (40, "PRE_FIRE_WARNING", 65.0, 27.5, 2.5, 0.0, 2.5, 70.0),
        (41, "NORMAL", 0.2, 27.5, 0.03, 0.03, 0.03, 0.0),
        (57, "NORMAL_SUNNY_DAY", 5.0, 27.54, 0.471, 0.03, 0.51, 0.0),
        (70, "PRE_FIRE_WARNING", 65.0, 27.62, 4.381, 3.63, 4.88, 20.0),
        (71, "ACTUAL_FIRE", 88.0, 27.62, 5.181, 0.8, 5.77, 43.33),
        (119, "ACTUAL_FIRE", 98.0, 27.62, 43.581, 0.8, 48.56, 1163.33),
    ],
)
def test_scenario_rows(scenarios, i, verdict, risk, base, rise, rate, temp_z, gas_z):
    r = batch_calibrate(scenarios).filter(F.col("reading_id") == i).first()
    assert r["ai_classification_verdict"] == verdict
    assert r["ai_risk_score"] == risk
    assert r["room_baseline_temp"] == base
    assert r["delta_temp_from_baseline"] == rise
    assert r["temp_rate_of_change_c_per_sec"] == rate
    assert (r["temp_zscore"], r["gas_zscore"]) == (temp_z, gas_z)
    assert (r["suppression_reason"] != "") == (verdict == "NORMAL_SUNNY_DAY")


def test_frozen_rows_leave_the_baseline(scenarios):
    fire = classify(scenarios).filter("reading_id >= 71")
    assert fire.select("temp_mean", "gas_mean").distinct().count() == 1


def test_missing_channels_count_as_defaults(rows):
    df = rows(
        "reading_id int, event_time timestamp_ntz, room_id string, temperature double, gas_raw double",
        [(1, None, "A", float("nan"), None)],
    ).withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    r = classify(df).first()
    assert (r["temp_mean"], r["gas_mean"], r["humidity_mean"]) == (25.0, 1500.0, 50.0)


def alert_kinds(rows, states):
    df = rows(
        "reading_id int, t long, fire_state string",
        [(i, t, s) for i, (t, s) in enumerate(states)],
    ).select(
        "reading_id", "fire_state", F.lit("d").alias("device_id"),
        F.timestamp_seconds(F.col("t") + 1_704_067_200).alias("event_time"),
    )
    out = alerts.rate_limit(df).orderBy("reading_id").collect()
    return [r["alert_kind"] for r in out]


def test_alert_sequences(rows):
    t, n = "TRANSITION", None
    assert alert_kinds(rows, [(0, "SAFE"), (1, "FIRE"), (60, "FIRE"), (61, "FIRE")]) == [
        n, t, n, "REMINDER",
    ]
    assert alert_kinds(rows, [(0, "FIRE"), (1, "HIGH_RISK"), (2, "SAFE")]) == [t, t, "ALL_CLEAR"]
    assert alert_kinds(rows, [(0, "FIRE"), (1, "WARNING"), (2, "SAFE")]) == [t, n, n]
    assert alert_kinds(rows, [(0, "WARNING"), (500, "WARNING")]) == [n, n]


def sweep(rows, values):
    df = rows("device_id string, sweep_id int, angle int, flame_raw int",
              [("d", 1, a, f) for a, f in values])
    return reports.sweep_peak(df).first()


def test_sweeps(rows):
    r = sweep(rows, [(10, 1023)])
    assert (r["best_angle"], r["min_raw"], r["confidence"]) == (90, 1023, 0.1)
    r = sweep(rows, [(40, 100), (120, 100)])
    assert (r["best_angle"], r["min_raw"], r["confidence"]) == (40, 100, 1.0)
    assert sweep(rows, [(185, 200)])["best_angle"] == 180
    flat = [(a * 10, 400) for a in range(19)]
    assert sweep(rows, flat)["confidence"] == 0.1
    # Mean 400 and lowest 320: a prominence of exactly 80 is not enough.
    exact = [(0, 320)] + [(a * 10, 404) for a in range(1, 17)] + [(170, 408), (180, 408)]
    assert sum(v for _, v in exact) == 400 * 19
    assert sweep(rows, exact)["confidence"] == 0.1


def test_confirm_hold_needs_ten_seconds(rows):
    df = rows("reading_id int, t long, status string",
              [(0, 0, "WARNING"), (1, 9, "WARNING"), (2, 10, "WARNING"), (3, 11, "FIRE"),
               (4, 12, "SAFE")]).select(
        "reading_id", "status", F.lit("d").alias("device_id"),
        F.timestamp_seconds("t").alias("event_time"),
    )
    out = timeline.confirm_hold(df).orderBy("reading_id").collect()
    assert [r["reported"] for r in out] == ["SAFE", "SAFE", "WARNING", "SAFE", "SAFE"]
    assert [r["confirmed"] for r in out] == [False, False, True, False, True]


def test_gap_limits(rows):
    df = rows("reading_id int, t double, temperature double",
              [(0, 0.0, 20.0), (1, 0.05, 21.0), (2, 0.15, 22.0), (3, 30.15, 25.0),
               (4, 60.151, 28.0)]).select(
        "reading_id", "temperature", F.lit(0.0).alias("gas_raw"),
        F.lit(0.0).alias("flame_voltage"), F.lit("r").alias("room_id"),
        F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("event_time"),
    )
    out = timeline.rate_of_change(df).orderBy("reading_id").collect()
    assert [r["gap_seconds"] for r in out] == [1.0, 1.0, 0.1, 30.0, 1.0]


def test_clock_stepping_back_is_no_timeout(rows):
    df = rows("reading_id int, t double", [(0, 10.0), (1, 11.5), (2, 13.001), (3, 2.0)]).select(
        "reading_id", F.lit("d").alias("device_id"),
        F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("event_time"),
    )
    out = timeline.watchdog_gap(df).orderBy("reading_id").collect()
    assert [r["timed_out"] for r in out] == [False, True, False, False]


def test_lenient_numbers(rows):
    values = ["1", " 2.5 ", "-.5", "1e3", "5.", "inf", "nan", "", "1d", "1,2", "0x10", None]
    df = normalise.numeric_coerce(rows("i int, temperature string", list(enumerate(values))))
    got = [r["temperature"] for r in df.orderBy("i").collect()]
    assert got == [1.0, 2.5, -0.5, 1000.0, 5.0, float("inf"), *[None] * 6]


def test_label_column_order():
    assert normalise.label_column(["label", "fire_state"]) == "fire_state"
    with pytest.raises(ValueError):
        normalise.label_column(["x"])
