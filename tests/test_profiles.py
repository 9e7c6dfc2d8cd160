"""Calibrating day by day from saved profiles equals calibrating everything at once."""

import pytest
from pyspark.sql import functions as F

from hearthflow.operators.lookups import PROFILE, room_profile
from hearthflow.plans.calibrate import classify, room_profiles


@pytest.mark.parametrize("max_rows", [None, 20])
def test_second_day_goes_on_from_the_first(readings, max_rows):
    first, second = readings.filter("t_sec <= 600"), readings.filter("t_sec > 600")
    limit = {} if max_rows is None else {"max_rows": max_rows}
    saved = room_profiles(first, **limit)
    got = classify(second, profiles=saved, **limit)
    want = classify(readings).filter("t_sec > 600")
    keep = ["reading_id", "verdict", "seen"]
    near = [F.round(c, 8).alias(c) for c in ("temp_mean", "gas_mean", "temp_rate", "gas_z")]
    assert got.select(*keep, *near).exceptAll(want.select(*keep, *near)).count() == 0
    assert got.count() == second.count()


def test_profiles_of_profiles(readings):
    first, second = readings.filter("t_sec <= 600"), readings.filter("t_sec > 600")
    chained = room_profiles(second, profiles=room_profiles(first))
    names = ["room_id", *[F.round(c, 8).alias(c) for c in PROFILE]]
    assert chained.select(*names).exceptAll(room_profiles(readings).select(*names)).count() == 0


def test_profile_joins_back(readings):
    saved = room_profiles(readings.filter("room_id <> 'ROOM_3'"))
    joined = room_profile(readings, saved)
    fresh = joined.filter("room_id = 'ROOM_3'").select("profile.seen").distinct().collect()
    assert [r["seen"] for r in fresh] == [0.0]
    assert joined.filter("profile.seen > 0").count() == readings.filter("room_id <> 'ROOM_3'").count()
