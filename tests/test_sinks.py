"""Tables that streams append to: few folders, nothing twice, nothing lost."""

import uuid

import pytest
from pyspark.sql import functions as F

from hearthflow.session import staging_path
from hearthflow.sinks import appended, streams
from hearthflow.sinks.appended import AppendTable, Folder, due
from hearthflow.streaming import jobs


@pytest.fixture
def folder(spark):
    return staging_path(spark, f"sinks-{uuid.uuid4().hex}")


def with_id(spark, checkpoint):
    """A checkpoint folder with the id that a stream keeps there."""
    spark.range(1).select(F.lit(uuid.uuid4().hex).alias("id")).write.json(f"{checkpoint}/metadata")
    return checkpoint


def test_ten_thousand_batches_make_few_folders():
    live, number, moved = [], 0, 0
    for _ in range(10_000):
        number += 1
        live.append(Folder(number, 0, 500))
        while old := due(live, largest=10**6):
            number += 1
            rows = sum(f.n_rows for f in old)
            moved += rows
            live = [f for f in live if f not in old] + [Folder(number, old[0].level + 1, rows)]
        assert len(live) <= 9 * 4 + 10_000 * 500 // 10**6
    assert sum(f.n_rows for f in live) == 5_000_000 and moved <= 4 * 5_000_000


def test_batches_are_merged_and_all_rows_stay(spark, folder):
    table = AppendTable(spark, folder, with_id(spark, f"{folder}-c"), fan=3, largest=100)
    for n in range(11):
        assert table.append(spark.range(n, n + 2), n)
    assert sorted(f.level for f in table.live) == [0, 0, 2]
    again = AppendTable(spark, folder)
    assert (again.live, again.taken, again.version) == (table.live, table.taken, table.version)
    rows = again.read().groupBy("seq").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert [r["ids"] for r in rows.orderBy("seq").collect()] == [[n, n + 1] for n in range(11)]
    # what was merged long ago is emptied
    gone = [n for n in range(1, table.version) if n not in {f.number for f in table.live} | set(table.dead)]
    assert gone and all(spark.read.parquet(f"{folder}/data/{n}").count() == 0 for n in gone)


def test_a_large_folder_is_left_alone(spark, folder):
    table = AppendTable(spark, folder, with_id(spark, f"{folder}-c"), fan=2, largest=10)
    for n, many in enumerate((50, 3, 4, 60, 5)):
        table.append(spark.range(many), n)
    assert sorted(f.n_rows for f in table.live) == [5, 7, 50, 60]


def test_replays_and_crashes(spark, folder, monkeypatch):
    checkpoint = with_id(spark, f"{folder}-c")
    table = AppendTable(spark, folder, checkpoint, fan=2)
    assert table.append(spark.range(5), 0)
    assert not table.append(spark.range(5), 0)  # replayed after the commit
    assert not AppendTable(spark, folder, checkpoint).append(spark.range(5), 0)

    def fails(self):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(appended.AppendTable, "_commit", fails)
        with pytest.raises(RuntimeError):
            table.append(spark.range(5, 9), 1)
    table = AppendTable(spark, folder, checkpoint, fan=2)
    assert table.read().count() == 5  # written, yet not taken in
    commit, calls = appended.AppendTable._commit, []

    def fails_in_the_merge(self):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost in the merge")
        commit(self)

    with monkeypatch.context() as m:
        m.setattr(appended.AppendTable, "_commit", fails_in_the_merge)
        with pytest.raises(RuntimeError):
            table.append(spark.range(5, 9), 1)
    table = AppendTable(spark, folder, checkpoint, fan=2)
    assert table.taken and sorted(r[0] for r in table.read().select("id").collect()) == list(range(9))
    assert not table.append(spark.range(5, 9), 1)
    assert table.append(spark.range(9, 10), 2)
    assert sorted(r[0] for r in table.read().select("id").collect()) == list(range(10))
    assert len(table.live) < 3


def test_empty_batches(spark, folder):
    with pytest.raises(FileNotFoundError):
        AppendTable(spark, folder).read()
    table = AppendTable(spark, folder, with_id(spark, f"{folder}-c"))
    assert table.append(spark.range(0), 0) and table.read().count() == 0


def test_a_new_checkpoint_overwrites_nothing(spark, readings, folder):
    """Two streams one after the other on one table, both with batches 0, 1, ...; before, the second wrote
    over the first's batches."""
    docs = readings.select(F.col("device_id").alias("id"), "event_time", "reading_id")
    parts = [docs.where(f"reading_id % 4 = {i}") for i in range(4)]
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/in{n // 2}")
        source = jobs.file_stream(spark, f"{folder}/in{n // 2}", docs.schema)
        streams.device_state(
            source, f"{folder}/out", f"{folder}/progress{n // 2}", jobs.available_now()
        ).awaitTermination()
    history = streams.device_history(spark, f"{folder}/out")
    assert history.count() == docs.count()
    assert history.drop("seq").exceptAll(docs).count() == 0
    assert history.select("seq").distinct().count() == 4
    state = streams.current_state(spark, f"{folder}/out")
    want = docs.groupBy("id").agg(F.max("reading_id").alias("reading_id"))
    assert state.select("id", "reading_id").exceptAll(want).count() == 0
    assert state.count() == want.count()


def test_a_state_written_before_a_lost_commit_is_written_again(spark, folder):
    schema = "id string, event_time timestamp, reading_id bigint"
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 2)], schema)
    rows = rows.withColumn("event_time", F.timestamp_seconds("reading_id"))
    rows.write.mode("append").parquet(f"{folder}/in")

    def run():
        source = jobs.file_stream(spark, f"{folder}/in", rows.schema)
        streams.device_state(
            source, f"{folder}/out", f"{folder}/progress", jobs.available_now()
        ).awaitTermination()

    run()
    # as if a batch had been lost after its state, before its commit
    stray = rows.limit(1).withColumn("reading_id", F.lit(99).cast("bigint")).withColumn("seq", F.lit(2).cast("bigint"))
    stray.write.parquet(f"{folder}/out/state/slot_1")
    more = rows.where("id = 'b'").withColumn("reading_id", F.lit(5).cast("bigint"))
    more.withColumn("event_time", F.timestamp_seconds("reading_id")).write.mode("append").parquet(f"{folder}/in")
    run()
    state = streams.current_state(spark, f"{folder}/out")
    assert sorted((r["id"], r["reading_id"]) for r in state.collect()) == [("a", 1), ("b", 5)]
