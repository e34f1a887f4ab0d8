"""The model store with many series, several versions and interrupted writes."""

import pytest
from pyspark.sql import functions as F

from hourloom.plans import anomaly
from hourloom.plans.anomaly import AnomalyModel
from hourloom.schemas import SERIES
from hourloom.sources import store


@pytest.fixture(scope="module")
def model(spark):
    """Trained on two series; its forest and threshold stand for 600."""
    hours = spark.range(800).select((F.col("id") % 2 + 204).alias("station_code"), F.lit(0).cast("long").alias("item_code"), F.floor(F.col("id") / 2).alias("n"))
    rows = hours.select(
        *SERIES,
        F.expr("timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(0, n)").alias("measurement_datetime"),
        ((F.col("n") * 7 + F.col("station_code")) % 11).cast("double").alias("clean_value"),
        F.when(F.col("n") % 9 == 0, 9).otherwise(0).alias("instrument_status"),
    )
    labelled = anomaly.labelled(rows).cache()
    fitted = anomaly.train_anomaly(labelled, trees=2, depth=2, forest_trees=3)
    series = spark.range(600).select((F.col("id") % 100 + 204).alias("station_code"), F.floor(F.col("id") / 100).alias("item_code"))

    def spread(table):
        return series.crossJoin(table.filter("station_code = 204").drop(*SERIES)).cache()

    return AnomalyModel(fitted.classifier, spread(fitted.forest), spread(fitted.thresholds)), labelled


def files(path):
    return [p for p in path.rglob("*.parquet")]


def test_600_series_are_one_version(spark, model, tmp_path):
    fitted, rows = model
    assert store.save_model(fitted, str(tmp_path)) == 1
    written = files(tmp_path / "anomaly" / "versions" / "1" / "forest")
    assert 1 < len(written) <= store.PARTS  # parts, not series
    assert spark.read.parquet(str(tmp_path / "anomaly" / "versions" / "1" / "forest")).count() == 600
    found = store.load_models(spark, str(tmp_path))
    assert list(found) == [("anomaly", 1)]
    again = found["anomaly", 1]
    assert sorted(map(tuple, again.thresholds.select(*SERIES, "threshold").collect())) == sorted(map(tuple, fitted.thresholds.collect()))
    want, got = (sorted(map(tuple, anomaly.predict_anomalies(m, rows).collect())) for m in (fitted, again))
    assert want == got and len(got) == 800


def test_newest_complete_version_answers(spark, model, tmp_path):
    fitted, _ = model
    few = F.col("station_code") == 205
    store.save_model(fitted, str(tmp_path))
    part = AnomalyModel(fitted.classifier, fitted.forest.filter(few), fitted.thresholds.filter(few).withColumn("threshold", F.lit(0.25)))
    assert store.save_model(part, str(tmp_path)) == 2
    (tmp_path / "anomaly" / "versions" / "3" / "forest").mkdir(parents=True)  # a write that was cut short
    (tmp_path / "anomaly" / "manifests" / "version=4").mkdir()
    versions = store.registry(spark, str(tmp_path)).groupBy("version").count().collect()
    assert {(r["version"], r["count"]) for r in versions} == {(1, 594), (2, 6)}
    found = store.load_models(spark, str(tmp_path))
    assert sorted(found) == [("anomaly", 1), ("anomaly", 2)]
    assert found["anomaly", 1].thresholds.count() == 594
    assert {r["threshold"] for r in found["anomaly", 2].thresholds.collect()} == {0.25}
    asked = spark.createDataFrame([(205, 0), (206, 0), (999, 0)], "station_code long, item_code long")
    got = {r["station_code"]: r["version"] for r in store.requested(spark, str(tmp_path), "anomaly", asked).collect()}
    assert got == {205: 2, 206: 1, 999: None}
    assert store.save_model(part, str(tmp_path)) == 5  # the number of an unfinished version is not used again


def test_some_series_read_some_parts(spark, model, tmp_path):
    store.save_model(model[0], str(tmp_path))
    one = spark.createDataFrame([(205, 0)], "station_code long, item_code long")
    loaded = store.load_model(spark, str(tmp_path), "anomaly", 1, one)
    assert loaded.thresholds.count() == 1 and loaded.forest.count() == 1
    assert "part" not in loaded.forest.columns


def test_empty_store(spark, tmp_path):
    assert store.registry(spark, str(tmp_path)).count() == 0
    assert store.load_models(spark, str(tmp_path)) == {}
