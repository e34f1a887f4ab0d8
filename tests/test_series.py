"""Window operators against pandas, with chunks small enough to cross many borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.functions.calendar import hour_index
from hourloom.operators import ordered, profiles, windows
from hourloom.schemas import SERIES, TS


def frame(n=600, seed=0, gaps=0.2, hot=3):
    """One long series and two short ones, with gaps, missing values, runs and a flat stretch."""
    rng = np.random.default_rng(seed)
    parts = []
    for station, size in ((204, n * hot), (205, n), (206, 1)):
        hours = np.flatnonzero(rng.random(size * 2) > gaps)[:size] if size > 1 else np.array([5])
        values = rng.integers(0, 4, len(hours)).astype(float)
        values[rng.random(len(hours)) < 0.1] = np.nan
        values[50:75] = 2.0
        parts.append(
            pd.DataFrame({"station_code": station, "item_code": 0, TS: pd.Timestamp("2021-01-01") + pd.to_timedelta(hours, "h"), "clean_value": values})
        )
    return pd.concat(parts, ignore_index=True)


def upload(spark, pdf):
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r)
        for r in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "station_code long, item_code long, measurement_datetime timestamp_ntz, clean_value double")


def collect(df, *columns):
    return df.select(*SERIES, TS, *columns).toPandas().sort_values([*SERIES, TS]).reset_index(drop=True)


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return upload(spark, pdf).repartition(5).cache()


def same(got, want):
    np.testing.assert_allclose(got.astype(float).to_numpy(), np.asarray(want, dtype=float), rtol=0, atol=1e-9, equal_nan=True)


def grouped(pdf, f):
    return np.concatenate([np.asarray(f(g["clean_value"].reset_index(drop=True)), dtype=float) for _, g in pdf.groupby("station_code")])


def test_positions_span_buckets(df):
    got = collect(ordered.row_positions(df, SERIES, chunk=64), "_pos")
    want = got.groupby("station_code").cumcount()
    assert (got["_pos"] == want).all()


def test_rolling_and_lags_cross_chunks(df, pdf):
    rows = ordered.row_positions(df, SERIES, chunk=64)
    out = ordered.over_chunks(
        rows,
        SERIES,
        "_pos",
        lambda w: windows.rolling_before(w, "clean_value", (3, 24)) | windows.lagged(w, "clean_value", (1, 48)),
        before=48,
        chunk=64,
    )
    got = collect(out, "rmean_24", "rstd_24", "rmin_3", "rmax_3", "zscore_24", "lag_48")
    assert len(got) == len(pdf)
    same(got["rmean_24"], grouped(pdf, lambda v: v.shift(1).rolling(24, min_periods=1).mean()))
    same(got["rmin_3"], grouped(pdf, lambda v: v.shift(1).rolling(3, min_periods=1).min()))
    same(got["lag_48"], grouped(pdf, lambda v: v.shift(48)))

    def zscore(v):
        r = v.shift(1).rolling(24, min_periods=1)
        return (v - r.mean()) / r.std().clip(lower=1e-10)

    moving = got["rstd_24"] > 1e-6
    np.testing.assert_allclose(
        got["zscore_24"].astype(float)[moving], grouped(pdf, zscore)[moving.to_numpy()], atol=1e-6, equal_nan=True
    )


def test_stuck_run_longer_than_a_chunk(spark):
    values = [1.0] * 3 + [5.0] * 300 + [2.0, 2.0, np.nan, np.nan, 2.0]
    pdf = pd.DataFrame({"station_code": 204, "item_code": 0, TS: pd.date_range("2021-01-01", periods=len(values), freq="h"), "clean_value": values})
    rows = ordered.row_positions(upload(spark, pdf), SERIES, chunk=32)
    marked = ordered.over_chunks(
        rows, SERIES, "_pos", lambda w: {"_same": windows.same_as_before(w, "clean_value")}, before=1, chunk=32, keep_chunk=True
    )
    got = collect(windows.count_identical(marked, SERIES, chunk=32), "consecutive_same")
    v = pd.Series(values)
    equal = v == v.shift(1)
    want = equal.groupby((~equal).cumsum()).cumsum()
    assert got["consecutive_same"].tolist() == want.tolist()


def test_flatline_and_spike(df, pdf):
    got = collect(windows.flatlines(df), "flatline_6h", "flatline_12h")
    want = grouped(pdf, lambda v: (v.rolling(6, min_periods=3).std() < 1e-10).astype(int))
    # pandas keeps rounding residue in a window after larger values; equality decides
    exact = grouped(pdf, lambda v: ((v.rolling(6, min_periods=3).max() == v.rolling(6, min_periods=3).min())).astype(int))
    assert (got["flatline_6h"].to_numpy() == exact).all() and want.sum() > 0
    spikes = collect(windows.spike_scores(df), "spike_score")
    same(spikes["spike_score"], grouped(pdf, lambda v: (v - (v.shift(1) + v.shift(-1)) / 2).abs()))


def test_fill_hourly_matches_reindex(spark, df, pdf):
    got = collect(ordered.fill_hourly(df, SERIES, chunk=100), "clean_value")
    want = []
    for _, g in pdf.groupby("station_code"):
        s = g.set_index(TS)["clean_value"]
        want.append(s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="h")).ffill().bfill().to_numpy())
    same(got["clean_value"], np.concatenate(want))


def test_fill_keeps_series_without_values_and_long_gaps(spark):
    rows = [(204, 0, "2021-01-01 00:00:00", None), (204, 0, "2021-01-01 05:00:00", None),
            (205, 0, "2021-01-01 00:00:00", None), (205, 0, "2021-03-01 00:00:00", 7.0), (205, 0, "2021-05-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "station_code long, item_code long, t string, clean_value double").select(
        *SERIES, F.col("t").cast("timestamp_ntz").alias(TS), "clean_value"
    )
    got = collect(ordered.fill_hourly(df, SERIES, chunk=48), "clean_value")
    empty, filled = got[got.station_code == 204], got[got.station_code == 205]
    assert len(empty) == 6 and empty["clean_value"].isna().all()
    assert len(filled) == 120 * 24 + 1 and (filled["clean_value"] == 7.0).all()


def test_fill_rows(spark, df, pdf):
    got = collect(ordered.fill_rows(ordered.row_positions(df, SERIES, chunk=50), SERIES, "clean_value", chunk=50), "clean_value")
    same(got["clean_value"], grouped(pdf, lambda v: v.ffill().bfill()))


def reference_filter(flags, n=3):
    out, i = list(flags), 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] == flags[i]:
            j += 1
        if flags[i] == 1 and j - i < n:
            out[i:j] = [0] * (j - i)
        i = j
    return out


def test_run_filter_any_chunk_border(spark):
    rng = np.random.default_rng(1)
    flags = (rng.random(500) < 0.6).astype(int).tolist() + [0, 1, 1]
    pdf = pd.DataFrame({"station_code": 204, "item_code": 0, TS: pd.date_range("2021-01-01", periods=len(flags), freq="h"), "clean_value": np.array(flags, dtype=float)})
    df = upload(spark, pdf).withColumn("raw_flag", F.col("clean_value").cast("int"))
    got = collect(windows.drop_short_runs(df, chunk=7), "is_anomaly")
    assert got["is_anomaly"].tolist() == reference_filter(flags)


def test_adaptive_smoothing_leaves_sparse_flags(spark):
    flags = [0] * 97 + [1, 0, 0]
    pdf = pd.DataFrame({"station_code": 204, "item_code": 0, TS: pd.date_range("2021-01-01", periods=100, freq="h"), "clean_value": np.array(flags, dtype=float)})
    df = upload(spark, pdf).withColumn("raw_flag", F.col("clean_value").cast("int"))
    assert collect(windows.smooth_flags(df), "is_anomaly")["is_anomaly"].sum() == 1


def test_folds(spark):
    pdf = pd.DataFrame({"station_code": 204, "item_code": 0, TS: pd.date_range("2021-01-01", periods=10000, freq="h"), "clean_value": 1.0})
    folds = windows.walk_forward_folds(upload(spark, pdf)).orderBy("fold").collect()
    assert [(f.fold, f.train_end, f.test_start, f.test_end) for f in folds] == [(0, 9280, 9280, 10000)]
    short = upload(spark, pdf.head(5000))
    assert windows.walk_forward_folds(short).count() == 0


def test_lookback_keeps_nulls(spark):
    pdf = pd.DataFrame({"station_code": 204, "item_code": 0, TS: pd.date_range("2021-01-01", periods=6, freq="h"), "clean_value": [1.0, np.nan, 3.0, 4.0, 5.0, 6.0]})
    got = windows.lookbacks(upload(spark, pdf), 3).orderBy(TS).collect()
    assert [r["lookback"] for r in got] == [[1.0, None, 3.0], [None, 3.0, 4.0], [3.0, 4.0, 5.0]]


def test_several_readings_in_an_hour_count_as_their_mean(spark):
    rows = [("2023-01-01 08:00:00", 1.0), ("2023-01-01 10:00:00", 2.0), ("2023-01-01 10:30:00", 4.0), ("2023-01-01 12:00:00", 5.0)]
    df = spark.createDataFrame([(1, t, v) for t, v in rows], "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    filled = ordered.fill_hourly(df, ["k"], "t", "v").orderBy("t").collect()
    assert [(r.t.hour, r.v) for r in filled] == [(8, 1.0), (9, 1.0), (10, 3.0), (11, 3.0), (12, 5.0)]
    bounds = spark.createDataFrame([(1,)], "k int").select("k", hour_index(F.lit("2023-01-01 08:00:00").cast("timestamp_ntz")).alias("_low"))
    held = ordered.hold(df, bounds.withColumn("_high", F.col("_low") + 4), ["k"], "t", "v").orderBy("_hour").collect()
    assert [r.last_value for r in held] == [1.0, 1.0, 3.0, 3.0, 5.0]


def test_lookbacks_over_chunks_and_missing_values(spark):
    n, values = 48, [None if i % 7 == 0 else float(i) for i in range(8192 + 500)]
    rows = spark.createDataFrame([(1, 2, i, v, f"x{i}") for i, v in enumerate(values)], "station_code long, item_code long, i long, clean_value double, note string")
    rows = rows.withColumn(TS, F.expr("timestamp_ntz'2021-01-20 00:00:00' + make_dt_interval(0, i * 2)"))
    got = windows.lookbacks(rows, n)
    assert set(got.columns) == {*rows.columns, "lookback"}
    found = {r["i"]: r for r in got.collect()}
    assert sorted(found) == list(range(n, len(values)))
    assert all(r["lookback"] == values[i - n : i] and r["note"] == f"x{i}" and r["clean_value"] == values[i] for i, r in found.items())


def test_profile_of_series_cut_by_batches(spark):
    rng = np.random.default_rng(5)
    hours = rng.integers(0, 900, 500)
    values = [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 90, 500)]
    rows = [(i % 9 or None, 0, (pd.Timestamp("2021-01-01") + pd.Timedelta(int(h), "h")).to_pydatetime(), v) for i, (h, v) in enumerate(zip(hours, values))]
    rows += [(5, 0, None, 7.0), (77, 0, rows[0][2], None)]
    df = spark.createDataFrame(rows, "station_code long, item_code long, measurement_datetime timestamp_ntz, clean_value double")
    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(at_once)
    spark.conf.set(at_once, 7)
    try:
        profile = profiles.calendar_profile(df)
        assert "Window" not in profile._jdf.queryExecution().executedPlan().toString()  # one sort serves all levels
        got = profile.toPandas()
    finally:
        spark.conf.set(at_once, before)
    pdf = pd.DataFrame(rows, columns=["station_code", "item_code", TS, "clean_value"])
    pdf[TS] = pd.to_datetime(pdf[TS])
    cells = {"month": pdf[TS].dt.month, "day_of_week": pdf[TS].dt.dayofweek, "hour": pdf[TS].dt.hour}
    keyed = pdf.assign(**cells)[["station_code", *cells, "clean_value", TS]].fillna({"station_code": -1, "month": -1, "day_of_week": -1, "hour": -1})
    got = got.fillna({"station_code": -1, "month": -1, "day_of_week": -1, "hour": -1})
    assert len(got) == len(keyed.groupby(["station_code", *cells]))
    for level, columns in profiles.LEVELS.items():
        want = keyed.groupby(["station_code", *columns])["clean_value"].agg(["count", "mean", "std"]).reset_index()
        both = got.merge(want, on=["station_code", *columns])
        assert len(both) == len(got) and (both[f"n_{level}"] == both["count"]).all()
        same(both[[f"mean_{level}", f"std_{level}"]], both[["mean", "std"]])
    first = keyed.groupby("station_code")[TS].min().rename("want").reset_index()
    both = got.merge(first, on="station_code")
    assert (both["epoch"] == both["want"]).all()


def test_hourly_rows_are_dealt_by_number(spark, df):
    plan = ordered.fill_hourly(df, SERIES)._jdf.queryExecution().executedPlan().toString()
    wanted = ordered.spread_over(df)
    assert wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {wanted}), REPARTITION_BY_NUM" in plan  # partitions that AQE leaves as they are
