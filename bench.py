"""Times the headline queries and prints one JSON line.

Every query runs once over its whole tables into the noop sink; one small query is run
before the clock starts, so that JVM and Python worker start-up are not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearthflow.catalog import QUERIES  # noqa: E402
from hearthflow.operators.folds import RoomBaselineWalk  # noqa: E402
from hearthflow.session import local_session  # noqa: E402
from hearthflow.sources.fixture import readings  # noqa: E402

HEADLINE = (
    "src_reading_tree",
    "src_telemetry_json",
    "src_packet_log",
    "proj_alias_normalise",
    "rule_edge_state",
    "win_rate_of_change",
    "win_history_50",
    "feat_rolling",
    "win_edge_ema",
    "win_fire_episodes",
    "win_sweep_segment",
    "win_alert_rate_limit",
    "win_enriched_reading",
    "agg_verdict_breakdown",
    "agg_quality_report",
    "agg_sweep_peak",
    "rule_decision_fusion",
    "online_alerts",
    "latest_per_device",
    "topk_recent_per_device",
    "dedup_push_id",
    "join_room_profile",
    "sink_master_csv",
    "stream_room_baseline",
    "stream_alert_state",
    "stream_state_ttl",
    "stream_dedup",
    "stream_watchdog",
    "ml_train_forest",
    "ml_train_boosted",
)


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def fold_rows_per_second() -> float:
    """Rows per second of the room-baseline step on one core, outside Spark."""
    n = 200_000
    at = [i * 1_000_000 for i in range(n)]
    temp = [22.0 + (i % 97) * 0.05 for i in range(n)]
    level = [50.0] * n
    gas = [1400.0 + (i % 89) for i in range(n)]
    columns = [at, temp, level, gas, [3.0] * n, [0] * n, [1013.0] * n]
    walk = RoomBaselineWalk()
    return n / timed(lambda: walk.walk(walk.start, columns))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("hearthflow-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    small = str(Path(folder).parent / "sf0.001")
    if os.path.isdir(small):
        QUERIES["agg_verdict_breakdown"](spark, small).collect()
    rows = readings(spark, folder).count()
    seconds = {name: round(timed(lambda n=name: run(n)), 3) for name in HEADLINE}
    fold = seconds["agg_verdict_breakdown"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "readings": rows,
                "room_baseline_readings_per_sec": round(rows / fold),
                "room_step_readings_per_sec_per_core": round(fold_rows_per_second()),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
