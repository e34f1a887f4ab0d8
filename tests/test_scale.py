"""Plans of steps that must not grow with the number of stations, and their results on odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourloom.operators import evaluate, ordered, spatial
from hourloom.plans import layers
from hourloom.schemas import SERIES, TS, WEATHER_POINTS, WEATHER_VARIABLES

HOUR = dt.datetime(2021, 3, 1, 5)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weather_climatology_adds_up_no_rows_per_station_and_hour(spark):
    names = [p[0] for p in WEATHER_POINTS]
    rows = [
        (n, HOUR + dt.timedelta(hours=h), *[None if (h, i, n) == (1, 0, names[0]) else float(10 * k + i) for i in range(len(WEATHER_VARIABLES))])
        for k, n in enumerate(names)
        for h in range(2)
    ] + [("elsewhere", HOUR, *[1.0] * len(WEATHER_VARIABLES))]
    weather = spark.createDataFrame(
        rows, "point_name string, time timestamp_ntz, " + ", ".join(f"{v} double" for v in WEATHER_VARIABLES)
    )
    stations = spark.createDataFrame(
        [(1, *WEATHER_POINTS[0][1:]), (2, 37.5, 127.0), (2, 37.5, 127.0), (3, None, None)],
        "station_code long, latitude double, longitude double",
    )
    found = spatial.weather_climatology(weather, stations)
    grouped = [line for line in plan_of(found).splitlines() if "Aggregate(keys=[station_code" in line]
    assert grouped and not any("month" in line for line in grouped)
    got = {(r["station_code"], r["hour"]): r for r in found.collect()}
    assert sorted(got) == [(s, h) for s in (1, 2, 3) for h in (5, 6)]
    first, second = (f"weather_{v}" for v in WEATHER_VARIABLES[:2])
    weights = {r["point_name"]: r["weight"] for r in spatial.weather_weights(stations.filter("station_code = 1")).collect()}
    want = sum(weights[n] * (10.0 * k + 1) for k, n in enumerate(names))
    assert got[1, 5][second] == pytest.approx(want)
    assert got[1, 6][first] == pytest.approx(sum(weights[n] * 10.0 * k for k, n in enumerate(names)))  # filled from the hour before
    assert got[2, 5][second] is None and got[3, 5][second] is not None  # a station listed twice, one without a place


def test_metrics_of_series_sum_after_the_shuffle_only(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", 1.0, 2.0), (1, 0, "a", 3.0, 3.0), (1, 0, "b", 0.0, 1.0), (None, 0, "a", 2.0, None)],
        "station_code long, item_code long, model string, y_true double, y_pred double",
    )
    found = evaluate.forecast_metrics(rows, [*SERIES, "model"])
    plan = plan_of(found)
    assert f", {ordered.spread_over(rows)}), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    got = {(r["station_code"], r["model"]): r for r in found.collect()}
    assert got[1, "a"]["mae"] == 0.5 and got[1, "a"]["n_samples"] == 2 and got[None, "a"]["n_samples"] == 1
    assert evaluate.forecast_metrics(rows).collect()[0]["n_samples"] == 4


def test_presentation_table_shuffles_no_long_rows(spark):
    columns = ["so2_value", "no2_value", "co_value", "o3_value", "pm10_value", "pm2_5_value"]
    measurements = spark.createDataFrame(
        [(HOUR, 1, 1.0, 2.0, *[float(i) for i in range(6)]), (HOUR, 2, 1.0, 2.0, *[None] * 6), (None, 1, 1.0, 2.0, *[7.0] * 6)],
        f"{TS} timestamp_ntz, station_code long, latitude double, longitude double, " + ", ".join(f"{c} double" for c in columns),
    )
    instruments = spark.createDataFrame(
        [(HOUR, 1, 0, 0), (HOUR, 1, 8, 9), (HOUR, 1, 8, 4), (HOUR, 1, None, 8), (None, 1, 0, 1), (HOUR, 3, 0, 2)],
        f"{TS} timestamp_ntz, station_code long, item_code long, instrument_status long",
    )
    pollutants = spark.createDataFrame([(0, "so2")], "item_code long, item_name string")
    joined = layers.with_status(layers.to_long(layers.with_statuses(measurements, instruments)), instruments, pollutants)
    wide = layers.to_wide(joined.withColumn("clean_value", F.col("value")))
    shuffles = [line for line in plan_of(wide).splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and all("REPARTITION_BY_NUM" in line for line in shuffles)
    statuses = {(r[TS], r["station_code"]): r["instrument_status"] for r in wide.collect()}
    assert statuses == {(HOUR, 1): 9, (HOUR, 2): None, (None, 1): None}
    def rows_of(df):
        return sorted(((str(r[TS]), r["station_code"], r["item_code"], r["value"], r["instrument_status"]) for r in df.collect()), key=str)

    assert joined.count() == 19  # two statuses of one reading stay two rows
    assert rows_of(joined) == rows_of(layers.with_status(layers.to_long(measurements), instruments, pollutants))
