"""The operators as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import testbed as tb
from hourloom.functions import calendar
from hourloom.functions.calendar import ntz
from hourloom.functions.scalars import abnormal_with_value, decimals_to_double, in_list, round_columns, usable
from hourloom.operators import calibrate, evaluate, lookback, models, panels, profiles, quality, spatial, windows
from hourloom.operators.ordered import attach, complete_rows, cut, fill_hourly
from hourloom.operators.quantile_trees import LEVELS, apply_quantile_trees, fit_quantile_trees
from hourloom.plans import anomaly, dashboard, features, forecast
from hourloom.schemas import ITEM_COLUMNS, READING_KEY, SERIES, TS, day_range
from hourloom.sources.readers import series_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = day_range("2021-02-01", "2021-04-15")


def query(build: Query) -> Query:
    """Register under the function name; doubles are rounded to 6 digits."""

    def rounded(spark: SparkSession, folder: str) -> DataFrame:
        return round_columns(build(spark, folder))

    QUERIES[build.__name__] = rounded
    return build


# --- layers ------------------------------------------------------------------


@query
def landing_pollutants(spark, folder):
    counts = tb.readings(spark, folder).groupBy("item_code").agg(F.sum("n").alias("n_readings"))
    return decimals_to_double(tb.layers(spark, folder)["lnd_pollutants"]).join(counts, "item_code", "left")


@query
def unpivot_long(spark, folder):
    return decimals_to_double(tb.layers(spark, folder)["measurements_long"])


@query
def join_status(spark, folder):
    return decimals_to_double(tb.layers(spark, folder)["measurements_with_status"])


@query
def clean_contract(spark, folder):
    return decimals_to_double(tb.layers(spark, folder)["measurements_clean"])


@query
def pivot_wide(spark, folder):
    return decimals_to_double(tb.layers(spark, folder)["dashboard_wide"])


# --- series scans --------------------------------------------------------------

SCANNED = [*READING_KEY, "clean_value", "instrument_status"]


@query
def series_scan(spark, folder):
    rows = series_rows(tb.cleaned(spark, folder), 205, 5, before="2021-04-01T00:00:00", ordered=True)
    return rows.select(*SCANNED)


@query
def series_every_status(spark, folder):
    return series_rows(tb.cleaned(spark, folder), 205, 5, statuses=None, ordered=True).select(*SCANNED)


@query
def series_abnormal(spark, folder):
    """All series, statuses by list."""
    return series_rows(tb.cleaned(spark, folder), statuses=(4, 8, 9)).select(*SCANNED)


@query
def series_all(spark, folder):
    rows = series_rows(tb.cleaned(spark, folder), before="2021-04-01T00:00:00", with_value=True)
    return rows.select(*READING_KEY, "clean_value", "latitude", "longitude")


@query
def stations(spark, folder):
    return spatial.stations_of(tb.readings(spark, folder))


@query
def one_target(spark, folder):
    rows = panels.pick_target(tb.predictions(spark, folder), 206, 7)
    return rows.select(*READING_KEY, "predicted_value")


@query
def named_period(spark, folder):
    """A named period and a named group of stations."""
    rows = dashboard.between(tb.cleaned(spark, folder), *dashboard.PERIODS["2021"])
    chosen = in_list(F.col("station_code"), dashboard.STATION_GROUPS["Central (212–216)"])
    return rows.filter(chosen).select(*SCANNED)


@query
def fault_labels(spark, folder):
    rows = anomaly.labelled(tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value", "instrument_status"))
    return rows.select(*READING_KEY, "label")


# --- quality -----------------------------------------------------------------


@query
def consistency_check(spark, folder):
    tables = tb.layers(spark, folder)
    return decimals_to_double(
        quality.disagreements(tables["lnd_measurements"], tables["lnd_instrument_data"], tables["lnd_pollutants"])
    )


@query
def dq_not_null(spark, folder):
    return quality.not_null(tb.layers(spark, folder)["measurements_long"], "value").select(*READING_KEY)


@query
def dq_unique_combo(spark, folder):
    return quality.unique_combination(tb.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_accepted(spark, folder):
    rows = tb.layers(spark, folder)["measurements_with_status"]
    return quality.accepted_values(rows, "instrument_status", (0, 1, 2, 9)).select(*READING_KEY, "instrument_status")


@query
def dq_orphans(spark, folder):
    orders = tb.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return quality.orphans(orders, "o_orderkey", tb.table(spark, folder, "lineitem"), "l_orderkey")


@query
def dq_fan_out(spark, folder):
    tables = tb.layers(spark, folder)
    return quality.fan_out(
        tables["measurements_long"], tables["lnd_instrument_data"], [TS, "station_code"]
    ).select(*READING_KEY)


@query
def dq_run_checks(spark, folder):
    tables = tb.layers(spark, folder)
    return quality.run_checks(tables)


# --- exploration -------------------------------------------------------------


def _clean(spark, folder):
    return tb.layers(spark, folder)["measurements_clean"]


@query
def overview(spark, folder):
    return dashboard.overview(_clean(spark, folder))


@query
def eda_q1_station_means(spark, folder):
    return dashboard.daily_station_means(tb.cleaned(spark, folder))


@query
def eda_q1_grand_mean(spark, folder):
    return dashboard.grand_mean(dashboard.daily_station_means(tb.cleaned(spark, folder)))


@query
def eda_q2_season_means(spark, folder):
    return dashboard.season_means(decimals_to_double(_clean(spark, folder)))


@query
def eda_q3_hour_spread(spark, folder):
    return dashboard.hour_spread(_clean(spark, folder))


@query
def eda_q3_peak_hour(spark, folder):
    return dashboard.peak_hour(dashboard.hour_spread(_clean(spark, folder)))


@query
def eda_q4_abnormal_data(spark, folder):
    return dashboard.abnormal_data_counts(_clean(spark, folder))


@query
def eda_q5_not_normal(spark, folder):
    return dashboard.not_normal_counts(_clean(spark, folder))


@query
def eda_q6_classes(spark, folder):
    return dashboard.class_counts(_clean(spark, folder))


# --- dashboard ---------------------------------------------------------------


def _series(spark, folder):
    """Ozone rows of every station in the range, timestamps kept."""
    return tb.wide(spark, folder).filter(dashboard.in_range(START, END)).select(
        TS, "station_code", F.col("o3_value").alias("value"), F.col("instrument_status").cast("int").alias("instrument_status")
    )


def _latest(spark, folder):
    return dashboard.stations_latest(tb.wide(spark, folder), 5, START, END)


@query
def timeseries(spark, folder):
    stations = tb.table(spark, folder, "supplier").select((F.col("s_suppkey") + 204).alias("station_code"))
    return dashboard.time_series(tb.wide(spark, folder), 5, stations, START, END)


@query
def stations_latest(spark, folder):
    return _latest(spark, folder)


@query
def missing_pct(spark, folder):
    return dashboard.missing_by_pollutant(tb.wide(spark, folder), START, END)


@query
def availability(spark, folder):
    return dashboard.status_availability(tb.wide(spark, folder), START, END)


@query
def monthly_quality(spark, folder):
    return dashboard.monthly_quality(tb.wide(spark, folder), START, END)


@query
def station_stats(spark, folder):
    return dashboard.station_stats(tb.wide(spark, folder), 5, START, END)


@query
def overall_stats(spark, folder):
    return panels.overall_statistics(_series(spark, folder))


@query
def axis_cap(spark, folder):
    return panels.axis_cap(_series(spark, folder))


@query
def histogram(spark, folder):
    return panels.histogram(_series(spark, folder), bins=40)


@query
def corr_matrix(spark, folder):
    return panels.correlations(tb.network(spark, folder), value="clean_value")


@query
def exceedance(spark, folder):
    return panels.exceedance(_series(spark, folder), 30.0)


@query
def status_mix(spark, folder):
    return panels.status_mix(_series(spark, folder))


@query
def series_kpis(spark, folder):
    return panels.series_kpis(_series(spark, folder), 30.0)


@query
def abnormal_readings(spark, folder):
    return _series(spark, folder).filter(abnormal_with_value(F.col("instrument_status"), F.col("value")))


@query
def geo_kpis(spark, folder):
    return panels.geo_kpis(_latest(spark, folder), 25.0)


@query
def map_points(spark, folder):
    return panels.map_points(_latest(spark, folder), 25.0)


@query
def top_bottom_k(spark, folder):
    return panels.top_and_bottom(_latest(spark, folder))


@query
def quality_kpis(spark, folder):
    wide = tb.wide(spark, folder)
    return panels.quality_kpis(
        dashboard.missing_by_pollutant(wide, START, END), dashboard.status_availability(wide, START, END)
    )


@query
def forecast_kpis(spark, folder):
    return panels.forecast_kpis(tb.predictions(spark, folder))


@query
def interval_widths(spark, folder):
    return panels.interval_widths(tb.predictions(spark, folder)).select(TS, "station_code", "item_code", "width")


@query
def forecast_summary(spark, folder):
    return panels.forecast_summary(tb.predictions(spark, folder))


@query
def anomaly_kpis(spark, folder):
    return panels.anomaly_kpis(tb.anomalies(spark, folder))


@query
def anomaly_summary(spark, folder):
    return panels.anomaly_summary(tb.anomalies(spark, folder))


@query
def list_targets(spark, folder):
    return panels.list_targets(tb.predictions(spark, folder))


@query
def score_grid(spark, folder):
    return panels.score_grid(tb.anomalies(spark, folder))


@query
def landing_kpis(spark, folder):
    return panels.landing_kpis(tb.wide(spark, folder), ITEM_COLUMNS.values())


@query
def sidebar_filter(spark, folder):
    labelled = dashboard.sidebar_columns(tb.wide(spark, folder))
    chosen = dashboard.sidebar_filter(labelled, "2021-02-10", "2021-03-20", (6, 18), ("Normal", "Missing Status"))
    return chosen.select(TS, "station_code", "date", "day_name", "hour", "status_label")


@query
def default_days(spark, folder):
    return dashboard.default_days(tb.wide(spark, folder))


@query
def contamination(spark, folder):
    return panels.contamination(tb.cleaned(spark, folder), SERIES)


# --- ordered series ----------------------------------------------------------


@query
def lags_diffs(spark, folder):
    return windows.lags_and_diffs(tb.network(spark, folder))


@query
def rolling_prev(spark, folder):
    out = windows.rolling_statistics(tb.network(spark, folder))
    return out.drop(*[c for c in out.columns if c.startswith("zscore")])


@query
def spike(spark, folder):
    return windows.spike_scores(tb.network(spark, folder)).drop("clean_value")


@query
def flatline(spark, folder):
    rows = tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value")
    return windows.flatlines(rows).drop("clean_value")


@query
def stuck_run(spark, folder):
    rows = tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value")
    return windows.stuck_runs(rows).drop("clean_value")


@query
def hourly_dev(spark, folder):
    return profiles.hourly_deviation(tb.network(spark, folder)).drop("clean_value")


@query
def spine_fill(spark, folder):
    return fill_hourly(tb.network(spark, folder), SERIES)


@query
def run_filter(spark, folder):
    return windows.drop_short_runs(tb.scored(spark, folder), "flag").select(*SERIES, TS, "flag", "is_anomaly")


@query
def adaptive_smoothing(spark, folder):
    return windows.smooth_flags(tb.scored(spark, folder), "flag", rate=0.4).select(*SERIES, TS, "flag", "is_anomaly")


@query
def last_rows(spark, folder):
    return windows.last_rows(tb.network(spark, folder), 100)


@query
def tail_stats(spark, folder):
    return windows.tail_statistics(fill_hourly(tb.network(spark, folder), SERIES))


def _folds(spark, folder):
    return windows.walk_forward_folds(
        fill_hourly(tb.network(spark, folder), SERIES), n_folds=3, test_size=168, min_train_size=2150
    )


@query
def folds(spark, folder):
    return _folds(spark, folder)


@query
def fold_rows(spark, folder):
    rows = windows.assign_folds(fill_hourly(tb.network(spark, folder), SERIES), _folds(spark, folder))
    return rows.groupBy(*SERIES, "fold").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("n_test"), F.sum("clean_value").alias("total")
    )


@query
def holdout(spark, folder):
    return windows.month_holdout(tb.network(spark, folder)).drop("clean_value")


@query
def chronological_split(spark, folder):
    return windows.chronological_split(tb.network(spark, folder)).drop("clean_value")


@query
def ordered_split(spark, folder):
    return windows.ordered_split(tb.network(spark, folder), [*SERIES, TS]).drop("clean_value")


@query
def lookback_window(spark, folder):
    filled = fill_hourly(tb.network(spark, folder), SERIES)
    rows = windows.lookbacks(filled, 48)
    return rows.select(
        *SERIES,
        TS,
        F.size("lookback").cast("long").alias("n"),
        F.aggregate("lookback", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.element_at("lookback", 1).alias("oldest"),
        F.element_at("lookback", 48).alias("newest"),
    )


# --- look-back joins and profiles --------------------------------------------

CUT = "2021-04-20 00:00:00"


def _split(spark, folder):
    rows = tb.network(spark, folder)
    return rows.filter(F.col(TS) < ntz(CUT)), rows.filter(F.col(TS) >= ntz(CUT)).drop("clean_value")


@query
def anchor_lags(spark, folder):
    train, targets = _split(spark, folder)
    return lookback.anchor_lags(targets, train)


@query
def seasonal_naive(spark, folder):
    train, targets = _split(spark, folder)
    return lookback.seasonal_naive(targets, train)


@query
def target_encoding(spark, folder):
    rows = profiles.target_encodings(tb.network(spark, folder))
    # many encodings end exactly between two sixth digits; the nudge keeps both engines on one side
    return rows.withColumns({f"enc_{level}": F.col(f"enc_{level}") + 1e-9 for level in profiles.ENCODED})


@query
def hour_stats(spark, folder):
    return profiles.hour_statistics(tb.network(spark, folder))


@query
def group_stats(spark, folder):
    return profiles.group_statistics(tb.network(spark, folder)).drop("clean_value")


@query
def hour_stats_later(spark, folder):
    """Statistics of the training hours on later hours, some in cells that training never saw."""
    train, targets = _split(spark, folder)
    return profiles.hour_statistics(train, targets)


@query
def group_stats_later(spark, folder):
    train, targets = _split(spark, folder)
    return profiles.group_statistics(train, targets)


@query
def unit_calendar(spark, folder):
    return tb.network(spark, folder).withColumns(calendar.unit_calendar(F.col(TS))).drop("clean_value")


@query
def cyclical(spark, folder):
    ts = F.col(TS)
    columns = calendar.calendar(ts) | calendar.cyclical(ts)
    return tb.network(spark, folder).withColumns(columns).drop("clean_value")


@query
def fourier(spark, folder):
    rows = tb.network(spark, folder)
    epochs = rows.groupBy(*SERIES).agg(F.min(TS).alias("_epoch"))
    return (
        attach(rows, epochs, SERIES)
        .withColumns(calendar.fourier(F.col(TS), F.col("_epoch")))
        .drop("clean_value", "_epoch")
    )


# --- space -------------------------------------------------------------------


def _usable(spark, folder):
    return tb.cleaned(spark, folder).filter(usable()).select(*SERIES, TS, "clean_value")


@query
def knn_stations(spark, folder):
    return spatial.nearest_stations(tb.network_stations(spark, folder)).withColumn(
        "neighbor_rank", F.col("neighbor_rank").cast("long")
    )


@query
def spatial_climatology(spark, folder):
    near = spatial.nearest_stations(tb.network_stations(spark, folder))
    return spatial.spatial_climatology(_usable(spark, folder), near)


@query
def knn_idw(spark, folder):
    near = spatial.nearest_stations(tb.network_stations(spark, folder))
    targets = fill_hourly(tb.network(spark, folder), SERIES).drop("clean_value")
    return spatial.spatial_features(targets, _usable(spark, folder), near)


@query
def weather_idw(spark, folder):
    targets = fill_hourly(tb.network(spark, folder), SERIES).drop("clean_value")
    return spatial.weather_features(targets, tb.weather(spark, folder), tb.network_stations(spark, folder))


@query
def weather_climatology(spark, folder):
    return spatial.weather_climatology(tb.weather(spark, folder), tb.network_stations(spark, folder))


# --- calibration and metrics -------------------------------------------------


@query
def blend(spark, folder):
    rows = tb.forecasts(spark, folder).withColumns(
        {f"w_{m}": F.lit(w) for m, w in calibrate.DEFAULT_WEIGHTS.items()}
    )
    return calibrate.blend(rows).select(*SERIES, TS, "fold", "ensemble")


@query
def cqr(spark, folder):
    return calibrate.conformal_correction(tb.forecasts(spark, folder))


@query
def cqr_applied(spark, folder):
    rows = tb.forecasts(spark, folder)
    applied = calibrate.calibrated(attach(rows, calibrate.conformal_correction(rows), SERIES))
    return applied.select(*SERIES, TS, "fold", "q05", "q95")


def _by_model(spark, folder):
    return tb.forecasts(spark, folder).unpivot(
        [*SERIES, "fold", "y_true"], list(calibrate.MODELS), "model", "y_pred"
    )


@query
def aligned(spark, folder):
    """Hours that occur in both of two tables of a series."""
    usable_rows = _usable(spark, folder).withColumnRenamed("clean_value", "reading")
    return evaluate.align(tb.network(spark, folder), usable_rows, [*SERIES, TS])


@query
def series_std(spark, folder):
    return evaluate.series_spread(fill_hourly(tb.network(spark, folder), SERIES), SERIES)


@query
def metrics(spark, folder):
    return evaluate.forecast_metrics(_by_model(spark, folder), [*SERIES, "fold", "model"])


def _averaged(spark, folder):
    per_fold = evaluate.forecast_metrics(_by_model(spark, folder), [*SERIES, "fold", "model"])
    return evaluate.average_folds(per_fold.select(*SERIES, "fold", "model", "rmse"))


@query
def cv_improvement(spark, folder):
    return evaluate.improvement(_averaged(spark, folder))


@query
def best_model(spark, folder):
    return evaluate.best_model(_averaged(spark, folder))


@query
def interval_metrics(spark, folder):
    return evaluate.interval_metrics(tb.forecasts(spark, folder), SERIES)


@query
def f1_report(spark, folder):
    return evaluate.detection_metrics(tb.scored(spark, folder), SERIES, "label", "flag")


@query
def pr_threshold(spark, folder):
    return calibrate.best_f1_threshold(tb.scored(spark, folder))


@query
def ensemble_loss(spark, folder):
    """Fitted weights, checked against each single model on the whole table."""
    rows = tb.forecasts(spark, folder)
    weighted = calibrate.blend(attach(rows, calibrate.ensemble_weights(rows), SERIES))
    y = F.col("y_true")

    def mse(name):
        return F.avg((y - F.col(name)) * (y - F.col(name)))

    best_single = F.least(*[mse(m) for m in calibrate.MODELS])
    return weighted.groupBy(*SERIES).agg(
        F.count("*").alias("n"),
        *[F.round(mse(m), 4).alias(f"mse_{m}") for m in calibrate.MODELS],
        (mse("ensemble") <= best_single + 1e-6).alias("never_worse"),
    )


# --- feature tables ----------------------------------------------------------


@query
def train_features(spark, folder):
    return features.train_features(fill_hourly(tb.network(spark, folder), SERIES))[0]


@query
def prediction_features(spark, folder):
    train, targets = _split(spark, folder)
    return features.prediction_features(targets, fill_hourly(train, SERIES))[0]


@query
def cross_item_features(spark, folder):
    targets = fill_hourly(tb.network(spark, folder), SERIES).drop("clean_value")
    return features.cross_item_features(targets, _usable(spark, folder))


@query
def cross_item_prediction(spark, folder):
    train, targets = _split(spark, folder)
    hours = fill_hourly(train, SERIES).drop("clean_value")
    return features.cross_item_features_for_prediction(targets, _usable(spark, folder), hours)


@query
def direct_features(spark, folder):
    return features.direct_features(tb.network(spark, folder))[0].select(*SERIES, TS, *features.DIRECT_COLUMNS)


@query
def global_features(spark, folder):
    rows = _usable(spark, folder).withColumns({"latitude": tb.latitude(), "longitude": tb.longitude()})
    built, columns = features.global_features(rows, None, ntz(tb.FIRST_HOUR))
    return built.select(TS, *columns)


@query
def anomaly_features(spark, folder):
    rows = tb.network(spark, folder)
    built, columns = features.anomaly_features(rows)
    kept = [c for c in columns if not c.startswith("zscore")]
    return built.select(*SERIES, TS, *kept)


@query
def anomaly_zscores(spark, folder):
    """z-scores; rows whose window does not move divide by the tiny floor and are left to the unit tests."""
    rows = windows.rolling_statistics(tb.network(spark, folder))
    moving = [F.when(F.col(f"rstd_{n}") > 1e-9, F.col(f"zscore_{n}")).alias(f"zscore_{n}") for n in windows.ROLLING_WINDOWS]
    return rows.select(*SERIES, TS, *moving)


@query
def baseline_anomaly_features(spark, folder):
    built, columns = features.baseline_anomaly_features(tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value"))
    kept = [c for c in columns if not c.startswith("dev_from")]
    return built.select(*SERIES, TS, *kept)


# --- models --------------------------------------------------------------------


def _ridge_rows(train):
    """The rows with the weights of their series, and the weights.

    Weights meet the rows in the join that brings the epoch, before the features are computed, which are not shuffled then.
    """
    rows, epochs = train.withColumn("y", F.log1p("clean_value")), features.series_epochs(train)
    weights = cut(models.fit_ridge(features.time_columns(rows, epochs), "y"))
    return features.time_columns(rows, epochs.join(weights, list(SERIES), "left")), weights


@query
def ridge(spark, folder):
    """Ridge in log space: error of the fitted values per series."""
    train = fill_hourly(tb.network(spark, folder), SERIES)
    fitted = models.apply_ridge(_ridge_rows(train)[0], None, "y_pred")
    return evaluate.forecast_metrics(fitted.withColumnRenamed("y", "y_true"), SERIES)


@query
def ridge_optimum(spark, folder):
    """Ridge in log space: what is left of the conditions that its weights solve, per series.

    The residuals add up to 0, and their products with each feature to the penalty times its weight.
    """
    train = fill_hourly(tb.network(spark, folder), SERIES)
    rows, weights = _ridge_rows(train)
    fitted = models.apply_ridge(rows, None, "y_pred").withColumn("_r", F.col("y") - F.col("y_pred"))
    products = [F.sum(F.col(c) * F.col("_r")).alias(f"_{i}") for i, c in enumerate(models.RIDGE_COLUMNS)]
    sums = fitted.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("_r").alias("_sum"), *products).join(weights, list(SERIES))
    gaps = [F.abs(F.col(f"_{i}") - models.RIDGE_ALPHA * F.col("coefficients")[i]) for i in range(len(models.RIDGE_COLUMNS))]
    return sums.select(*SERIES, "n", F.round(F.abs("_sum"), 4).alias("residual_sum"), F.round(F.greatest(*gaps), 3).alias("gradient"))


@query
def quantile_trees(spark, folder):
    """Boosted 5 % and 95 % quantiles: hours per series, and whether each quantile has its share of all hours below it."""
    train, _ = _holdout_week(spark, folder)
    rows, columns = features.direct_features(train)
    rows = complete_rows(rows.select(*SERIES, TS, "clean_value", *columns), ["clean_value", *columns])
    judged = rows
    for name, level in LEVELS.items():
        judged = apply_quantile_trees(fit_quantile_trees(rows, "clean_value", columns, level), judged, name)
    below = [F.sum((F.col("clean_value") <= F.col(name)).cast("int")).alias(f"_{name}") for name in LEVELS]
    counted = cut(judged.groupBy(*SERIES).agg(F.count("*").alias("n"), *below))
    gaps = [F.abs(F.sum(f"_{name}") / F.sum("n") - level) < 0.01 for name, level in LEVELS.items()]
    covers = counted.agg((gaps[0] & gaps[1]).alias("covers"))
    return counted.select(*SERIES, "n").join(F.broadcast(covers))


@query
def isolation_forest_share(spark, folder):
    """Readings of each series that the forest flags among those it was fitted on: no more than the expected share."""
    rows = tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value", "instrument_status")
    train = anomaly.labelled(rows)
    scored = anomaly.predict_baseline(anomaly.train_baseline(train), train)
    counted = scored.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("predicted_status").alias("_flagged"))
    joined = counted.join(panels.contamination(train, SERIES), list(SERIES))
    most = F.col("n") - 1 - F.floor((F.col("n") - 1) * (1 - F.col("contamination")))
    return joined.select(*SERIES, "n", most.alias("most"), (F.col("_flagged") <= most).alias("within"))


@query
def ensemble_weights(spark, folder):
    return calibrate.ensemble_weights(tb.forecasts(spark, folder))


@query
def isolation_forest(spark, folder):
    """Forest score of every reading on the baseline features, summed up per series."""
    rows = tb.cleaned(spark, folder).select(*SERIES, TS, "clean_value", "instrument_status")
    model = anomaly.train_baseline(anomaly.labelled(rows))
    scored = anomaly.predict_baseline(model, anomaly.fill_values(rows))
    return scored.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.sum("predicted_status").alias("anomalies"), F.max("anomaly_score").alias("max_score")
    )


@query
def gbt_anomaly(spark, folder):
    """Supervised detection with the last month of each series as validation."""
    rows = anomaly.labelled(_network_status(spark, folder))
    marked = windows.month_holdout(rows)
    train = marked.filter(~F.col("is_validation")).drop("is_validation")
    held = marked.filter("is_validation").drop("is_validation")
    model = anomaly.train_anomaly(train, held)
    judged = anomaly.predict_anomalies(model, held).join(held.select(*SERIES, TS, "label"), [*SERIES, TS])
    return evaluate.detection_metrics(judged, SERIES, "label", "is_anomaly")


@query
def gbt_anomaly_holdout(spark, folder):
    """Hours and true faults of the held-out month per series, as the detector judged them, and bounds of its report."""
    found = gbt_anomaly(spark, folder)
    shares = [F.col(c).between(0, 1) for c in ("f1_anomaly", "precision_anomaly", "recall_anomaly", "accuracy")]
    bounded = reduce(lambda a, b: a & b, shares) & (F.col("n_predicted_anomalies") <= F.col("n_total"))
    return found.select(*SERIES, "n_total", "n_true_anomalies", bounded.alias("bounded"))


def _network_status(spark, folder):
    """The network series; every 11th shipping unit total marks a faulty hour."""
    return tb.network(spark, folder).withColumn(
        "instrument_status", F.when(F.col("clean_value") % 11 == 0, 9).otherwise(0).cast("long")
    )


def _holdout_week(spark, folder):
    filled = fill_hourly(tb.network(spark, folder), SERIES)
    return filled.filter(F.col(TS) < ntz(CUT)), filled.filter(F.col(TS) >= ntz(CUT))


@query
def gbt_direct(spark, folder):
    train, held = _holdout_week(spark, folder)
    model = forecast.train_direct(train)
    judged = forecast.predict_direct(model, train, held.drop("clean_value")).join(held, [*SERIES, TS])
    return evaluate.forecast_metrics(judged, SERIES, "clean_value", "direct")


@query
def gbt_global(spark, folder):
    train, held = _holdout_week(spark, folder)
    place = {"latitude": tb.latitude(), "longitude": tb.longitude()}
    model, epoch, rows = forecast.train_global(train.withColumns(place))
    predicted = forecast.predict_global(model, epoch, rows, held.drop("clean_value").withColumns(place))
    return evaluate.forecast_metrics(predicted.join(held, [*SERIES, TS]), SERIES, "clean_value", "global")


@query
def forecast_pipeline(spark, folder):
    """Train, calibrate on the last weeks and predict the hours after the series."""
    train, held = _holdout_week(spark, folder)
    around = forecast.Surroundings(_usable(spark, folder), tb.network_stations(spark, folder))
    model = forecast.train_forecast(train, held, around)
    return forecast.predict_forecast(model, held)


@query
def gbt_direct_hours(spark, folder):
    """Hours that the direct model answers for, and that no answer is missing or negative."""
    train, held = _holdout_week(spark, folder)
    found = forecast.predict_direct(forecast.train_direct(train), train, held.drop("clean_value"))
    good = F.min(F.coalesce(F.col("direct") >= 0, F.lit(False)))
    return found.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min(TS).alias("first"), F.max(TS).alias("last"), good.alias("good"))
