"""Wire formats, packets and files with broken input."""

import pytest
from pyspark.sql import functions as F

from hearthflow.operators.normalise import alias_normalise, clean, event_time, split_undated
from hearthflow.plans.export import export_master
from hearthflow.schema import MASTER_COLUMNS
from hearthflow.session import staging_path
from hearthflow.sinks.files import master_csv, session_bucket
from hearthflow.sources.packets import packet_log
from hearthflow.sources.wire import (
    mqtt_json,
    mqtt_rejects,
    path_fallback,
    reading_tree,
    serial_csv,
    tagged_lines,
    telemetry_json,
)


def frame(body: bytes) -> bytes:
    check = 0
    for b in body:
        check ^= b
    return body + bytes([check])


def full(angle=90, header=0xAA, number=0x01020304):
    return frame(
        bytes([header, 1, angle]) + number.to_bytes(4, "little") + bytes([3, 88]) + b"ZONE_1\0\0"
    )


@pytest.mark.parametrize(
    "payload, valid, number",
    [
        (full(), True, 0x01020304),
        (full(number=0xFFEEDDCC), True, 0xFFEEDDCC),
        (full(angle=180), True, 0x01020304),
        (full(angle=181), False, 0x01020304),
        (full(header=0xAB), False, 0x01020304),
        (full()[:-1] + b"\x00", False, 0x01020304),
        (full() + b"\x00", False, None),
        (b"", False, None),
        (None, False, None),
        (b"\xaa\x01\x5a" + (7).to_bytes(4, "little"), True, 7),
        (b"\xaa\x00\x5a\x00" + (0xF0000009).to_bytes(4, "little"), True, 0xF0000009),
        (b"\xab\x00\x5a\x00" + (9).to_bytes(4, "little"), False, 9),
    ],
)
def test_packets(rows, payload, valid, number):
    r = packet_log(rows("payload binary", [(payload,)])).first()
    assert (r["valid"], r["packet_id"]) == (valid, number)
    if payload and len(payload) == 18 and valid:
        assert (r["zone"], r["risk"], r["packet_state"], r["fire"]) == ("ZONE_1", 88, 3, True)


def test_short_packets_can_be_refused(rows):
    df = rows("payload binary", [(b"\xaa\x01\x5a\x07\x00\x00\x00",)])
    assert packet_log(df, accept_legacy=False).first()["valid"] is False


def test_tree_skips_what_is_not_a_reading(rows):
    docs = [
        ('{"devices":{"a":{"readings":{"p1":{"temperature":"21.5","flame_raw":7},"p2":"x",'
         '"p3":4,"p4":null,"p5":[1],"p6":{"timestamp":null,"servo_angle":1e20}}},"b":5,'
         '"c":{"readings":"none"},"d":{}}}',),
        ('{"devices":{"a":{"readings":{"p7":{"device_id":"own","pressure":1000}}}}}',),
        ('{"devices":null}',), ("[]",), ("broken {",), (None,), ("",),
    ]
    got = {r["push_id"]: r for r in reading_tree(rows("value string", docs), root="devices").collect()}
    assert set(got) == {"p1", "p6", "p7"}
    assert (got["p1"]["temperature_c"], got["p1"]["timestamp"]) == (21.5, "")
    assert got["p6"]["servo_angle"] is None or got["p6"]["servo_angle"] == 90
    assert (got["p7"]["device_id"], got["p7"]["pressure_hpa"]) == ("own", 1000.0)


def test_path_fallback_modes(rows):
    schema = "path_device string, push_id string"
    primary = rows(schema, [("a", "1")])
    legacy = rows(schema, [("a", "2"), ("b", "3")])
    none = rows(schema, [])
    assert {r[1] for r in path_fallback(primary, legacy).collect()} == {"1", "3"}
    assert {r[1] for r in path_fallback(primary, legacy, legacy_only=False).collect()} == {"1"}
    assert {r[1] for r in path_fallback(none, legacy, legacy_only=False).collect()} == {"2", "3"}


POSTS = [
    # body, reason, temperature, gas
    ('{"device_id":"d","temp_c":68.5,"gas_raw":650,"is_fire":true}', None, 68.5, 650),
    ('{"tempC":"30.5","gasRaw":12.9}', None, 30.5, 12),
    ('{"temp_c":"hot"}', "invalid field: temperature", None, None),
    ('{"temp_c":null,"tempC":20}', "invalid field: temperature", None, None),
    ('{"gas_raw":"12.7"}', "invalid field: gas_raw", None, None),
    ('{"gas_raw":[1]}', "invalid field: gas_raw", None, None),
    ("{}", "empty payload", None, None),
    ("[]", "empty payload", None, None),
    ("oops", "empty payload", None, None),
    (None, "empty payload", None, None),
    ('{"zone_id":"Z"}', None, 25.0, 120),
]


@pytest.mark.parametrize("body, reason, temperature, gas", POSTS)
def test_posts(rows, body, reason, temperature, gas):
    r = telemetry_json(rows("value string", [(body,)])).first()
    assert r["reason"] == reason
    if reason is None:
        assert (r["temperature"], r["gas_raw"]) == (temperature, gas)
    if body and "zone_id" in body:
        assert (r["room_id"], r["device_id"], r["servo_angle"]) == ("Z", "dev_001", 90)


def test_broker_messages(rows):
    df = rows(
        "topic string, value string",
        [("site/devices/n1/telemetry", '{"deviceId":"x","temperature":21,"flameDetected":true}'),
         ("other", '{"deviceId":"x","recordedAt":"2024-01-01T00:00:00Z"}')],
    )
    a, b = mqtt_json(df).collect()
    assert (a["device_id"], a["temperature"], a["flame_digital"]) == ("n1", 21.0, 1)
    assert b["device_id"] == "x" and b["event_time"] is not None


def test_serial_lines(rows):
    lines = [("timestamp_ms,device_id,room_id,flame_raw",), ("",), ("1,d,r,5\r\n",), ("1,d,r",),
             ("1,d,r,5,6",), ("-1,d,r,5",), ("1,d,r,5.5",), (" 2,d,r,6 ",)]
    got = serial_csv(rows("line string", lines), session="S1").select("esp_timestamp_ms", "flame_raw")
    assert sorted(map(tuple, got.collect())) == [("1", "5"), ("2", "6")]
    with pytest.raises(ValueError):
        serial_csv(rows("line string", lines), session="S1", condition="MAYBE")


def test_tagged_lines_ignore_banners(rows):
    lines = [("=====",), ("CSV,d,r,21.50,40.00,12,1,0.25,7,SAFE",), ("CSVX,d",), ("JSON,{bad",),
             ('JSON,{"deviceId":"d","temperature":21.5,"flameDetected":true}',)]
    df = rows("line string", lines)
    assert [r["temperature"] for r in tagged_lines(df, tag="CSV").collect()] == [21.5]
    assert [r["flame_digital"] for r in tagged_lines(df, tag="JSON").collect()] == [1]


def test_sessions_by_name(rows):
    df = rows("session_id string", [("flame_1",), ("My_Recovery",), ("RECOVERY_FLAME",), ("x",)])
    got = [r[0] for r in df.select(session_bucket()).collect()]
    assert got == ["flame_tests", "recovery", "flame_tests", "normal"]


def test_export_is_ordered_over_all_files(spark, rows):
    doc = '{"n%d":{"readings":{"p%03d":{"timestamp":%s,"temperature_c":%d}}}}'
    stamps = ["null" if i % 7 == 0 else f'"2024-01-01T00:00:{i % 5:02d}Z"' for i in range(60)]
    docs = [(doc % (i % 3, i, stamps[i], i),) for i in range(60)]
    path = staging_path(spark, "export")
    written = export_master(rows("value string", docs), rows("value string", []), path, files=3)
    back = spark.read.option("header", True).csv(path)
    assert tuple(back.columns) == MASTER_COLUMNS
    got = back.withColumn("f", F.input_file_name()).orderBy("f").select("timestamp").collect()
    want = written.orderBy("timestamp", "push_id").select("timestamp").collect()
    assert sorted(r[0] or "" for r in got) == [r[0] for r in want]
    one = staging_path(spark, "export")
    master_csv(written, one, files=1)
    seen = [r["temperature_c"] for r in spark.read.option("header", True).csv(one).collect()]
    order = [r["temperature_c"] for r in written.orderBy("timestamp", "push_id").collect()]
    assert [float(x) for x in seen] == order


def test_cleaning_a_whole_dataset(rows):
    df = rows(
        "temp string, hum string, gas string, flame string, device string",
        [("21.5", "40", "1500", "900", "n1"), ("bad", "40", "1500", "900", "n1"),
         ("500", "-3", "1500", "900", None), (None, None, None, None, None)],
    )
    got = clean(df).orderBy("temperature").collect()
    assert [(r["temperature"], r["humidity"], r["room_id"], r["was_clamped"]) for r in got] == [
        (21.5, 40.0, "n1", False), (120.0, 0.0, "ROOM_1", True),
    ]


def test_times(rows):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00",
             "123456", "1999-01-01T00:00:00Z", "later", "", None]
    df = event_time(rows("i int, timestamp string", list(enumerate(texts)))).orderBy("i")
    got = df.select(F.unix_seconds("event_time"), "uptime_ms").collect()
    assert [r[0] for r in got] == [1_704_067_200] * 3 + [None] * 5
    assert [r[1] for r in got] == [None, None, None, 123456, None, None, None, None]
    dated, undated = split_undated(df)
    assert (dated.count(), undated.count()) == (3, 5)


def test_first_alias_that_is_there_wins(rows):
    df = rows("temp_c double, tempC double, other int", [(None, 2.0, 1), (1.0, 2.0, 2), (None, None, 3)])
    got = alias_normalise(df, defaults={"temperature": 25.0}).orderBy("other").collect()
    assert [r["temperature"] for r in got] == [2.0, 1.0, 25.0]


def test_broken_broker_messages_are_rejected_with_a_reason(spark):
    topic = "site/v1/devices/d1/telemetry"
    rows = [
        (topic, '{"temperature": 20.5}'), (topic, "not json"), (topic, "{}"), (topic, ""),
        (topic, None), (topic, "[1"), ("other", '{"humidity": 3}'), (topic, '{"roomId": "a"}'),
    ]
    df = spark.createDataFrame(rows, "topic string, value string")
    assert [r["temperature"] for r in mqtt_json(df).collect()] == [20.5]
    reasons = sorted(r["reason"] for r in mqtt_rejects(df).collect())
    assert reasons == sorted(
        ["malformed message"] * 2 + ["no values"] * 2 + ["empty message"] * 2 + ["no device"]
    )


def test_long_tagged_line(spark):
    line = "CSV,dev,room,20.5,40.0,1500,0,0.5,7," + "x" * 1_100_000
    got = tagged_lines(spark.createDataFrame([(line,)], "line string")).collect()
    assert len(got) == 1 and got[0]["device_id"] == "dev"
