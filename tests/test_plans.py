"""Training, calibration, requests, store and stream on two short series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.plans import anomaly, forecast
from hourloom.schemas import SERIES, TS
from hourloom.sources import store
from hourloom.streaming.scoring import score_stream

HOURS = 1300


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(42)
    hours = pd.date_range("2022-01-01", periods=HOURS, freq="h")
    parts = []
    for station, item in ((204, 2), (205, 2)):
        v = np.maximum(0.5 + 0.2 * np.sin(2 * np.pi * hours.hour.to_numpy() / 24) + rng.normal(0, 0.05, HOURS), 0.01)
        status = np.zeros(HOURS, dtype=int)
        for start in (300, 700, 1000):
            status[start : start + 30], v[start : start + 30] = 9, 5.0 + rng.random(30)
        parts.append(pd.DataFrame({"station_code": station, "item_code": item, TS: hours, "clean_value": v, "instrument_status": status}))
    df = spark.createDataFrame(pd.concat(parts)).withColumn(TS, F.col(TS).cast("timestamp_ntz"))
    return df.cache()


def test_forecast_requests_store_and_calibration(spark, readings, tmp_path):
    series = readings.filter("instrument_status = 0").select(*SERIES, TS, "clean_value")
    train = series.filter(F.col(TS) < F.lit("2022-02-20").cast("timestamp_ntz"))
    held = series.filter(F.col(TS) >= F.lit("2022-02-20").cast("timestamp_ntz"))
    filled = forecast.fill_hourly(train, SERIES)
    model = forecast.train_forecast(filled, held, trees=3, depth=3, quantile_trees=6)
    weights = model.weights.toPandas()[["w_lgbm", "w_ridge", "w_naive"]]
    np.testing.assert_allclose(weights.sum(axis=1), 1, atol=1e-9)

    judged = forecast.predict_forecast(model, held).join(held, [*SERIES, TS]).toPandas()
    assert len(judged) == held.count() and (judged["q95"] >= judged["q05"]).all()
    inside = ((judged["clean_value"] >= judged["q05"]) & (judged["clean_value"] <= judged["q95"])).mean()
    assert inside >= 0.85
    assert judged.drop(columns=[TS]).notna().all().all()

    store.save_model(model, str(tmp_path))
    loaded = store.load_models(spark, str(tmp_path))
    assert list(loaded) == [("forecast", 1)]
    want, got = (sorted(map(tuple, forecast.predict_forecast(m, held).collect())) for m in (model, loaded["forecast", 1]))
    assert want == got

    requests = spark.createDataFrame(
        [(204, 2, "2022-02-25T00:00:00", "2022-02-25T23:00:00"), (999, 2, "2022-02-25T00:00:00", "2022-02-25T23:00:00"),
         (205, 2, "2022-02-25T05:00:00", "2022-02-25T00:00:00"), (205, 2, "2022-01-01T00:00:00", "2022-12-31T00:00:00")],
        "station_code long, item_code long, start string, end string",
    ).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    answer, rejects = forecast.forecast_requests(loaded["forecast", 1], requests)
    assert answer.count() == 24 + 364 * 24 + 1 and rejects.count() == 2  # no bound on the length of a range
    assert answer.filter("predicted_value IS NULL").count() == 0


def test_anomaly_scoring_and_stream(spark, readings, tmp_path):
    labelled = anomaly.labelled(readings)
    model = anomaly.train_anomaly(labelled, labelled, trees=4, depth=3, forest_trees=10)
    scored = anomaly.predict_anomalies(model, labelled).join(labelled.select(*SERIES, TS, "label"), [*SERIES, TS]).toPandas()
    assert len(scored) == 2 * HOURS and set(scored["is_anomaly"]) <= {0, 1}
    assert scored["anomaly_probability"].between(0, 1).all()
    seen = scored[scored["label"] == 1]
    assert seen["is_anomaly"].mean() > 0.6

    store.save_model(model, str(tmp_path / "models"))
    model = store.load_models(spark, str(tmp_path / "models"))["anomaly", 1]

    unknown = spark.createDataFrame([(999, 2)], "station_code long, item_code long").withColumns(
        {TS: F.lit("2022-03-01").cast("timestamp_ntz"), "clean_value": F.lit(1.0)}
    )
    few = readings.filter("station_code = 205").orderBy(TS).limit(2).select(*SERIES, TS, "clean_value")
    posted = readings.filter("station_code = 204").select(*SERIES, TS, "clean_value").unionByName(few).unionByName(unknown)
    posted.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(posted.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert {tuple(r) for r in got.select(*SERIES).distinct().collect()} == {(204, 2), (205, 2)}  # two readings are scored too
    assert got.count() == HOURS + 2
    assert spark.read.parquet(str(tmp_path / "out" / "rejects")).count() == 1
