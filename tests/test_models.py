"""Models on the online path: versions, pins and decisions that follow the model."""

import pytest
from pyspark.sql import functions as F

from hearthflow.catalog.inputs import given_model
from hearthflow.operators import learning
from hearthflow.operators.boosting import Boosted, Tree
from hearthflow.plans.calibrate import batch_calibrate, classify
from hearthflow.plans.models import Registry, versioned_enrichment
from hearthflow.plans.online import answered, decide, documents, enrichment
from hearthflow.session import staging_path
from hearthflow.sinks import streams
from hearthflow.sinks.appended import AppendTable
from hearthflow.streaming import jobs, processors


def always(probability_of_fire_margin):
    """A model that gives every reading the same answer."""
    trees = [Tree(value=[0.0]), Tree(value=[probability_of_fire_margin]), Tree(value=[0.0])]
    return Boosted(["temperature"], [0, 1, 2], [[0.0]], [0.0] * 3, [trees], [0.0])


@pytest.fixture
def registry(spark):
    return Registry(spark, staging_path(spark, "registry"))


def test_versions_are_numbered_and_load_what_was_published(spark, registry, readings):
    assert registry.versions() == []
    assert [registry.publish(given_model(), "BoostedTrees"), registry.publish(always(9.0), "B")] == [1, 2]
    assert registry.versions() == [1, 2]
    again = Registry(spark, registry.path)
    assert again.load(1).to_json() == given_model().to_json()
    # a model that is being published has no description yet
    spark.createDataFrame([("x",)], "value string").write.text(f"{registry.path}/version=3/model")
    assert registry.versions() == [1, 2]


def test_a_batch_keeps_its_version(registry):
    pins = f"{registry.path}-pins"
    assert registry.pinned(pins, 0) is None
    registry.publish(always(9.0), "A")
    assert registry.pinned(pins, 0) is None and registry.pinned(pins, 1) == 1
    registry.publish(always(-9.0), "B")
    assert [registry.pinned(pins, i) for i in (0, 1, 2)] == [None, 1, 2]


def test_decisions_follow_the_model(readings):
    classified = classify(readings)
    plain = decide(classified).filter("fire_state = 'SAFE'").select("reading_id")
    hot = decide(classified, model=always(9.0))
    seen = hot.join(plain, "reading_id")
    # a sure FIRE of the model decides wherever the verdict does not call it sunny
    wrong = seen.filter("verdict <> 'NORMAL_SUNNY_DAY' AND fire_state <> 'FIRE'")
    assert seen.count() > 100 and wrong.count() == 0
    assert {r[0] for r in hot.select("ml_prediction").distinct().collect()} == {"FIRE"}
    calm = decide(classified, model=always(-9.0)).select("reading_id", "fire_state")
    assert calm.exceptAll(decide(classified).select("reading_id", "fire_state")).count() == 0


def test_answers_use_the_features_of_training(spark, readings):
    data = learning.training_set(batch_calibrate(readings))
    model = learning.train_boosted(data, rounds=3, depth=3)
    want = learning.predict(data, model).select("reading_id", "ml_prediction", "probabilities.FIRE")
    got = answered(classify(readings), model).select("reading_id", "ml_prediction", "probabilities.FIRE")
    assert got.exceptAll(want).count() == 0 and got.count() == 1000
    kept = answered(classify(readings), model)
    assert set(classify(readings).columns) < set(kept.columns)
    forest = learning.train_forest(data, trees=5, depth=4)
    assert answered(classify(readings), forest).filter("ml_prediction is null").count() == 0


def test_documents_say_whether_a_model_answered(readings):
    on, off = documents(readings, given_model()), documents(readings)
    assert on.filter("ml_active and ml_prediction is not null").count() == 1000
    assert off.filter("not ml_active and ml_prediction is null").count() == 1000


def test_a_version_published_in_mid_stream(spark, registry, readings, tmp_path):
    folder = str(tmp_path)
    pins, patches = f"{folder}/pins", f"{folder}/patch"
    half = readings.select(F.percentile_approx("t_sec", 0.5)).first()[0]

    def run():
        rows = processors.room_baseline(jobs.file_stream(spark, f"{folder}/in", readings.schema))
        streams.enrichment_patch(
            rows, patches, f"{folder}/progress", jobs.available_now(), versioned_enrichment(registry, pins)
        ).awaitTermination()

    registry.publish(always(9.0), "A")
    readings.filter(F.col("t_sec") <= half).coalesce(1).write.parquet(f"{folder}/in")
    run()
    registry.publish(given_model(), "B")
    readings.filter(F.col("t_sec") > half).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    got = streams.patched(readings, patches)
    assert got.filter("prediction is null").count() == 0
    by_half = got.groupBy((F.col("t_sec") > half).alias("later")).agg(F.collect_set("model_version").alias("v"))
    assert {r["later"]: r["v"] for r in by_half.collect()} == {False: [1], True: [2]}
    # what the stream wrote is what the batch path gives with the same versions
    classified = classify(readings)
    want = enrichment(classified.filter(F.col("t_sec") <= half), always(9.0)).unionByName(
        enrichment(classified.filter(F.col("t_sec") > half), given_model())
    )
    columns = ["reading_id", "prediction", "confidence", "risk_score"]
    assert want.select(*columns).exceptAll(got.select(*columns)).count() == 0
    # a replay of the first batch still uses its version
    first = AppendTable(spark, patches).read().where("seq = 1")
    assert first.count() > 0
    again = versioned_enrichment(registry, pins)(classified.filter(F.col("t_sec") <= half), 0)
    assert again.select(*columns).exceptAll(first.select(*columns)).count() == 0
