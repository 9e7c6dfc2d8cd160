"""foreachBatch sinks. A batch that is replayed is taken in once, see `appended`, so every sink is
idempotent, and a new checkpoint goes on where the table stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import latest_per_device
from ..streaming.jobs import every
from .appended import AppendTable

PATCH = (
    "reading_id",
    "risk_score",
    "prediction",
    "confidence",
    "room_baseline_temp",
    "temp_rate_of_change",
    "ai_classification_verdict",
)
VERSION = "model_version"


def enrichment_patch(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the patch columns (and `model_version`, if there is one) of every batch. `prepare` makes patches of classified rows batch by batch, see
    `plans.models.versioned_enrichment`; without it the rows are patches."""

    table = AppendTable(rows.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        if prepare is not None:
            batch = prepare(batch, batch_id)
        columns = [c for c in (*PATCH, VERSION) if c != VERSION or c in batch.columns]
        table.append(batch.select(*columns), batch_id)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every(2)))
        .start()
    )


def patched(readings: DataFrame, path: str) -> DataFrame:
    """Readings with their newest patch."""
    patches = AppendTable(readings.sparkSession, path).read()
    rest = [c for c in (*PATCH, VERSION) if c != "reading_id" and c in patches.columns]
    newest = (
        patches.groupBy("reading_id")
        .agg(F.max_by(F.struct(*rest), "seq").alias("_patch"))
        .select("reading_id", "_patch.*")
    )
    kept = [c for c in readings.columns if c not in rest]
    return readings.select(*kept).join(newest, "reading_id", "left")


def _states(spark: SparkSession, path: str) -> dict[int, tuple[int, DataFrame]]:
    """The complete states: slot, commit and rows."""
    found = {}
    for slot in (0, 1):
        try:
            rows = spark.read.parquet(f"{path}/state/slot_{slot}")
        except AnalysisException:
            continue
        seq = rows.agg(F.max("seq")).first()[0]
        if seq is not None:
            found[slot] = (seq, rows.drop("seq"))
    return found


def device_state(
    docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, key: str = "id"
) -> StreamingQuery:
    """Keep the newest document per device and append every document as history.

    The state table is written in turn to two slots: a batch reads the newest state of earlier
    commits and writes the other slot, so a replay starts from an untouched table.
    """
    history = AppendTable(docs.sparkSession, f"{path}/readings", checkpoint)

    def write_state(fresh: DataFrame, seq: int) -> None:
        spark, newest = fresh.sparkSession, latest_per_device(fresh, key)
        earlier = {slot: state for slot, state in _states(spark, path).items() if state[0] < seq}
        last = max(earlier, key=lambda slot: earlier[slot][0], default=1)
        if earlier:
            newest = latest_per_device(newest.unionByName(earlier[last][1]), key)
        newest.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/state/slot_{1 - last}"
        )

    def write(batch: DataFrame, batch_id: int) -> None:
        history.append(batch, batch_id, write_state)

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every(2)))
        .start()
    )


def device_history(spark: SparkSession, path: str) -> DataFrame:
    """All documents, with `seq`, the commit that brought them."""
    return AppendTable(spark, f"{path}/readings").read()


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table of the newest finished batch."""
    states = _states(spark, path)
    if not states:
        raise FileNotFoundError(f"no device state below {path}")
    return max(states.values(), key=lambda state: state[0])[1]


def alerts(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append alerts; the same table is the alert list and the audit trail's alert part."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every(2)))
        .start(path)
    )
