"""Readers, sinks and the layer build on files."""

import json

from pyspark.sql import functions as F

from hourloom import testbed as tb
from hourloom.operators.quality import run_checks
from hourloom.plans import dashboard
from hourloom.plans.layers import materialise
from hourloom.schemas import TS, WEATHER_VARIABLES
from hourloom.sources import readers, sinks

FOLDER = "/root/testdata/sf0.001"


def test_csv_layers_and_snapshot(spark, tmp_path):
    root = str(tmp_path)
    tb.measurement_data(spark, FOLDER).write.option("header", True).csv(f"{root}/m")
    tb.instrument_data(spark, FOLDER).write.option("header", True).csv(f"{root}/i")
    tb.pollutant_data(spark).write.option("header", True).csv(f"{root}/p")
    from hourloom.plans.layers import build_layers

    tables = build_layers(
        readers.read_measurements(spark, f"{root}/m"),
        readers.read_instruments(spark, f"{root}/i"),
        readers.read_pollutants(spark, f"{root}/p"),
    )
    built = materialise(spark, tables, f"{root}/warehouse")
    n = tb.wide(spark, FOLDER).count()
    assert built["dashboard_wide"].count() == n
    assert built["measurements_clean"].count() == 6 * n and len(built["measurements_clean"].columns) == 18
    failures = {(r["table"], r["check"]): r["failures"] for r in run_checks(built).collect()}
    assert failures["measurements_clean", f"unique:{TS}+station_code+item_code"] == 0
    assert failures["lnd_measurements", "agreement"] > 0

    assert sinks.write_snapshot(built["dashboard_wide"], f"{root}/snap") == n
    wide = readers.dashboard_wide(spark, f"{root}/snap")
    assert dict(wide.dtypes)["so2_value"] == "double"
    assert dashboard.time_series(wide, 5, [], "2021-01-01", "2022-01-01").count() == 0
    assert readers.query(spark, "SELECT count(*) AS n FROM dashboard_wide WHERE station_code = :s", {"s": 205}).first()["n"] > 0

    cleaned = built["measurements_clean"]
    series = readers.series_rows(cleaned, 205, 5, before="2021-02-20T00:00:00", ordered=True)
    bounds = series.agg(F.max(TS).alias("t"), F.max("instrument_status").alias("s")).first()
    assert bounds["t"].isoformat() < "2021-02-20T00:00:00" and bounds["s"] == 0
    assert readers.series_rows(cleaned, 205, 5, statuses=None).count() > series.count()
    assert readers.series_rows(cleaned, with_value=True).filter("clean_value IS NULL").count() == 0
    assert readers.series_rows(cleaned, statuses=()).count() == 0


def test_prediction_files(spark, tmp_path):
    rows = tb.predictions(spark, FOLDER)
    sinks.write_predictions(rows, f"{tmp_path}/f")
    assert readers.read_forecasts(spark, f"{tmp_path}/f").count() == rows.count()
    assert readers.read_anomalies(spark, f"{tmp_path}/absent") is None


def test_weather_json(spark, tmp_path):
    body = {"hourly": {"time": ["2021-01-01T00:00", "2021-01-01T01:00"], **{v: [1.5, None] for v in WEATHER_VARIABLES}}}
    (tmp_path / "center").mkdir()
    (tmp_path / "center" / "2021.json").write_text(json.dumps(body))
    got = readers.read_weather(spark, {("center", 37.55, 127.0): f"{tmp_path}/center"})
    assert got.count() == 2 and got.filter("precipitation IS NULL").count() == 1
    sinks.write_weather_cache(got, f"{tmp_path}/cache")
    again = readers.read_weather_cache(spark, f"{tmp_path}/cache")
    assert again.exceptAll(got.select(again.columns)).count() == 0


def test_readings_hold_every_line(spark):
    folder = "/root/testdata/sf0.001"
    line = tb.table(spark, folder, "lineitem")
    rows = tb.readings(spark, folder)
    assert rows.count() < line.count()  # some lines share hour, station and item
    got = rows.agg(F.sum("n"), F.sum("order"), F.sum(F.when(F.col("raw") >= 0, F.col("raw")))).first()
    assert tuple(got)[:2] == tuple(line.agg(F.count(F.lit(1)), F.sum("l_orderkey")).first())
    assert 0 < got[2] <= line.agg(F.sum("l_quantity")).first()[0]
