"""Acknowledgements as a stream-stream join."""

import time
import uuid

from hearthflow.session import staging_path
from hearthflow.streaming import jobs
from hearthflow.streaming.actions import acknowledged, acknowledgements

WAIT = 15


def test_acks_before_after_and_long_after(spark):
    jobs.use_state_store(spark)
    folder = staging_path(spark, f"acks-{uuid.uuid4().hex}")
    schema = "alert_id string"

    def run(alerts, acks):
        for name, ids in (("alerts", alerts), ("acks", acks)):
            frame = spark.createDataFrame([(i,) for i in ids], schema)
            frame.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        sides = [jobs.file_stream(spark, f"{folder}/{n}", frame.schema) for n in ("alerts", "acks")]
        out = acknowledgements(*sides, wait=f"{WAIT} seconds")
        jobs.to_table(out, f"{folder}/out", f"{folder}/progress", jobs.available_now()).awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run(["same", "soon", "never", "much later", None], ["same", "same", "early", None])
        run(["early"], ["soon"])
        time.sleep(WAIT + 1)
        run(["flush"], ["much later"])
        time.sleep(WAIT + 1)
        got = run(["end"], ["end of acks"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = sorted((r["outcome"], str(r["alert_id"])) for r in got.collect())
    assert rows == [
        ("ACKED", "early"), ("ACKED", "same"), ("ACKED", "same"), ("ACKED", "soon"),
        ("LATE", "None"), ("LATE", "much later"),
        ("OPEN", "None"), ("OPEN", "flush"), ("OPEN", "much later"), ("OPEN", "never"),
    ]
    stored = spark.createDataFrame(
        [("same", False), ("never", False), ("much later", False), ("early", False), ("x", True)],
        "alert_id string, acknowledged boolean",
    )
    shown = {r["alert_id"]: r["acknowledged"] for r in acknowledged(stored, got).collect()}
    assert shown == {"same": True, "never": False, "much later": True, "early": True, "x": True}
