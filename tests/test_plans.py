"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hearthflow.catalog import QUERIES
from hearthflow.operators import timeline
from hearthflow.sources.fixture import readings as read

BATCH = [q for q in QUERIES if not q.startswith(("stream_", "sink_", "ml_", "champion", "topk_feat"))]


@pytest.fixture(autouse=True)
def no_rows_of_other_tests(request, spark):
    """Spark would put what other tests have cached in place of a query's own reading."""
    if "readings" not in request.fixturenames:
        spark.catalog.clearCache()


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_windows_share_one_exchange(spark):
    out = timeline.fire_episodes(read(spark, SMALL), F.col("k") < 25)
    # Five windows and the final grouping all work on rows hashed once by device.
    assert exchanges(plan(out)) == 1


@pytest.mark.parametrize(
    "name", ["win_rate_of_change", "win_history_50", "win_sweep_segment", "win_response_intervals",
             "win_enriched_reading", "win_alert_rate_limit", "win_edge_ema"],
)
def test_one_exchange_per_ordered_query(spark, name):
    assert exchanges(plan(QUERIES[name](spark, SMALL))) == 1


@pytest.mark.parametrize("name", ["topk_recent_per_device", "device_history"])
def test_top_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["topk_recent_alerts", "topk_alert_feed"])
def test_newest_alerts_are_a_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


def test_filters_and_columns_reach_the_scan(spark):
    events = read(spark, "/root/testdata/sf0.01").filter("reading_id > 500").select("reading_id", "temperature")
    text = plan(events)
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,500)]" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


@pytest.mark.parametrize("name", ["agg_sweep_bins", "agg_rows_per_device", "rule_edge_state"])
def test_aggregates_and_rules_stay_in_codegen(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.collect()
    assert "*(1)" in df._jdf.queryExecution().executedPlan().toString()


def test_online_alerts_sends_only_what_it_needs_to_python(spark):
    text = QUERIES["online_alerts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in text.splitlines() if "MapInArrow" in line]
    assert len(steps) == 2
    assert not any(c in text for c in ("servo_angle", "t_sec#", "AS k#"))
    assert "temperature#" not in max(steps, key=lambda line: "alert_kind" in line)
