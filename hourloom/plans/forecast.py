"""Month-ahead forecasts: train, calibrate, predict, cross-validate.

One plan covers every series in the training table.  The boosted model is one
Spark ML fit over all of them; everything else is a parameter table keyed by
series.  Pass a single series to get a model of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.calendar import hour_index, hour_to_ts
from hourloom.functions.scalars import decimals_to_double, ensure_columns, floor_at, usable
from hourloom.operators import evaluate, windows
from hourloom.operators.calibrate import (
    DEFAULT_WEIGHTS,
    MODELS,
    blend,
    calibrated,
    conformal_correction,
    ensemble_weights,
)
from hourloom.operators.lookback import seasonal_naive
from hourloom.operators.models import (
    TREE_COUNT,
    TREE_DEPTH,
    apply_boosted,
    apply_ridge,
    column_medians,
    fill_medians,
    fit_boosted,
    fit_ridge,
    scaling,
    standardise,
)
from hourloom.operators.quantile_trees import LEVELS, QUANTILE_TREES, QuantileTrees, apply_quantile_trees, fit_quantile_trees
from hourloom.operators.ordered import attach, complete_rows, cut, fill_hourly, hours_in
from hourloom.operators.spatial import (
    nearest_stations,
    spatial_climatology,
    spatial_features,
    spatial_features_for_prediction,
    weather_climatology,
    weather_features,
    weather_features_for_prediction,
)
from hourloom.plans import features as ft
from hourloom.schemas import SERIES, TS, WEATHER_VARIABLES

VALUE = "clean_value"
CROSS_ITEMS = (2,)  # pollutants that use the other pollutants of their station
WEATHER_COLUMNS = [f"weather_{v}" for v in WEATHER_VARIABLES]


@dataclass(frozen=True)
class Surroundings:
    """Optional inputs beyond the series itself."""

    readings: DataFrame | None = None  # usable readings of all stations and pollutants
    stations: DataFrame | None = None  # station_code, latitude, longitude
    weather: DataFrame | None = None
    neighbours: DataFrame | None = None  # derived from the stations where not given

    def prepared(self, last=None) -> Surroundings:
        """Inputs materialised once for their many uses, readings up to hour ``last`` only."""
        readings, neighbours = self.readings, self.neighbours
        if readings is not None:
            if last is not None:
                readings = readings.filter(F.col(TS) <= F.lit(last).cast("timestamp_ntz"))
            readings = cut(readings)
        if neighbours is None and self.stations is not None:
            neighbours = cut(nearest_stations(self.stations))
        weather = None if self.weather is None else cut(self.weather)
        return replace(self, readings=readings, neighbours=neighbours, weather=weather)

    @property
    def spatial(self) -> bool:
        return self.readings is not None and self.neighbours is not None


@dataclass(frozen=True)
class ForecastModel:
    boosted: PipelineModel
    features: list[str]
    train: DataFrame  # gap-filled series on the original scale
    ridge: DataFrame
    medians: DataFrame
    scales: DataFrame
    quantiles: dict[str, QuantileTrees]  # q05 and q95 of the standardised target
    weights: DataFrame
    correction: DataFrame
    surroundings: Surroundings


def forecast_series(cleaned: DataFrame, end_before: str | None = None) -> DataFrame:
    """Gap-filled hourly series of the normal readings before a date."""
    rows = cleaned.filter(F.col("instrument_status") == 0)
    if end_before:
        rows = rows.filter(F.col(TS) < F.lit(end_before).cast("timestamp_ntz"))
    return fill_hourly(decimals_to_double(rows.select(*SERIES, TS, VALUE)), SERIES)


def _log(rows: DataFrame) -> DataFrame:
    return rows.withColumn(VALUE, F.log1p(VALUE))


def _zero_nulls(rows: DataFrame, columns) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def _training_table(train: DataFrame, around: Surroundings):
    """Complete rows with every feature; the target is the log of the value."""
    rows, columns = ft.train_features(_log(train))
    hours = train.drop(VALUE)
    # each group of features is materialised on its own: one plan holding all
    # of them has far more stages than Spark replans quickly
    rows = cut(rows)
    if around.spatial:
        near = cut(spatial_features(hours, around.readings, around.neighbours))
        # a station with fewer than two neighbours has no spread
        rows = _zero_nulls(rows.join(near, [*SERIES, TS], "left"), ["spatial_std"])
        columns = [*columns, *ft.SPATIAL_COLUMNS]
    if around.readings is not None:
        crossed = cut(ft.cross_item_features(hours.filter(F.col("item_code").isin(*CROSS_ITEMS)), around.readings))
        # hours before the lags reach are dropped by the longer anchor lags anyway
        rows = _zero_nulls(rows.join(crossed, [*SERIES, TS], "left"), ft.CROSS_COLUMNS)
        columns = [*columns, *ft.CROSS_COLUMNS]
    if around.weather is not None and around.stations is not None:
        rows = rows.join(cut(weather_features(hours, around.weather, around.stations)), [*SERIES, TS], "left")
        columns = [*columns, *WEATHER_COLUMNS]
    rows = ft.log_cross_columns(rows).select(*SERIES, TS, VALUE, *columns)
    return complete_rows(rows, [VALUE, *columns]), columns


def _prediction_table(targets: DataFrame, train: DataFrame, around: Surroundings, columns, known_weather: bool):
    """Features of future hours; weather is looked up where known, else climatology."""
    rows, _ = ft.prediction_features(targets, _log(train))
    rows = cut(rows)
    if around.spatial:
        climatology = spatial_climatology(around.readings, around.neighbours)
        rows = spatial_features_for_prediction(rows, climatology)
    if around.readings is not None:
        of_cross = F.col("item_code").isin(*CROSS_ITEMS)
        hours = train.filter(of_cross).drop(VALUE)
        crossed = ft.cross_item_features_for_prediction(targets.filter(of_cross), around.readings, hours)
        rows = rows.join(cut(crossed.select(*SERIES, TS, *ft.CROSS_COLUMNS)), [*SERIES, TS], "left")
    if around.weather is not None and around.stations is not None:
        if known_weather:
            rows = rows.join(cut(weather_features(targets, around.weather, around.stations)), [*SERIES, TS], "left")
        else:
            rows = weather_features_for_prediction(rows, weather_climatology(around.weather, around.stations))
    return ensure_columns(ft.log_cross_columns(rows), columns)


def _lag_columns(columns) -> list[str]:
    """Features that a future hour may lack."""
    return [c for c in columns if "lag" in c or c.startswith(("xpol", "weather", "rolling"))]


def _components(rows: DataFrame, model: ForecastModel, targets: DataFrame) -> DataFrame:
    """Point models on the original scale and raw quantiles."""
    scored = _unscaled(apply_boosted(model.boosted, rows, "_lgbm_log"), model.scales, "_lgbm_log")
    scored = apply_ridge(scored, model.ridge, "_ridge_log")
    for name, trees in model.quantiles.items():
        scored = _unscaled(apply_quantile_trees(trees, scored, f"_{name}"), model.scales, f"_{name}")

    def back(log_value):
        return floor_at(F.expm1(log_value), 0.0)

    named = scored.select(
        *SERIES,
        TS,
        back(F.col("_lgbm_log")).alias("lgbm"),
        back(F.col("_ridge_log")).alias("ridge"),
        *[back(F.col(f"_{name}")).alias(name) for name in LEVELS],
    )
    naive = seasonal_naive(targets.select(*SERIES, TS), model.train)
    return named.join(naive, [*SERIES, TS])


def train_forecast(
    train: DataFrame,
    validation: DataFrame | None = None,
    around: Surroundings = Surroundings(),
    trees: int = TREE_COUNT,
    depth: int = TREE_DEPTH,
    quantile_trees: int = QUANTILE_TREES,
    allow_future: bool = False,
) -> ForecastModel:
    """Fit point models and quantile trees; with a validation part also weights and correction.

    ``train`` and ``validation`` are gap-filled (series, hour, value) tables.
    The validation part serves early stopping, weights and the conformal step.
    Readings of other series after the end of training are left out unless
    ``allow_future`` is set, which restores the source method's behaviour.
    """
    train = cut(train)
    around = around.prepared(None if allow_future else train.agg(F.max(TS)).first()[0])
    table, columns = _training_table(train, around)
    medians = cut(column_medians(table, _lag_columns(columns)))

    checked = None
    if validation is not None:
        targets = validation.select(*SERIES, TS)
        checked = _prediction_table(targets, train, around, columns, known_weather=True)
        own = column_medians(checked, _lag_columns(columns))
        checked = fill_medians(checked, own, _lag_columns(columns))
        checked = checked.join(_log(validation), [*SERIES, TS]).select(*SERIES, TS, VALUE, *columns)
        checked = complete_rows(checked, [VALUE, *columns])

    scales = cut(scaling(table, [VALUE]))  # one model over all series needs targets of one scale
    judged = None if checked is None else complete_rows(standardise(checked, scales, [VALUE]), [VALUE])
    judged = None if judged is None else cut(judged)
    table = cut(standardise(table, scales, [VALUE]))
    boosted = fit_boosted(table, VALUE, columns, judged, trees=trees, depth=depth)
    bounds = {n: fit_quantile_trees(table, VALUE, columns, q, judged, quantile_trees) for n, q in LEVELS.items()}
    ridge_rows = ft.time_columns(_log(train), ft.series_epochs(train))
    flat = train.select(*SERIES).distinct()
    model = ForecastModel(
        boosted=boosted,
        features=columns,
        train=train,
        ridge=cut(fit_ridge(ridge_rows, VALUE)),
        medians=medians,
        scales=scales,
        quantiles=bounds,
        weights=flat.withColumns({f"w_{m}": F.lit(w) for m, w in DEFAULT_WEIGHTS.items()}),
        correction=flat.withColumn("cqr", F.lit(0.0)),
        surroundings=around,
    )
    if checked is None:
        return model
    parts = _components(checked, model, validation)
    judged = cut(parts.join(validation.withColumnRenamed(VALUE, "y_true"), [*SERIES, TS]))
    return replace(
        model, weights=cut(ensemble_weights(judged)), correction=cut(conformal_correction(judged))
    )


def with_calibration(model: ForecastModel, validated: ForecastModel) -> ForecastModel:
    """A model refitted on all data with the weights and correction of the validated fit."""
    return replace(model, weights=validated.weights, correction=validated.correction)


def predict_forecast(model: ForecastModel, targets: DataFrame) -> DataFrame:
    """ensemble, lgbm, ridge, naive, q05 and q95 for every (series, hour)."""
    targets = targets.select(*SERIES, TS)
    rows = _prediction_table(targets, model.train, model.surroundings, model.features, known_weather=False)
    rows = fill_medians(rows, model.medians, _lag_columns(model.features))
    rows = _zero_nulls(rows, model.features)
    parts = _components(rows, model, targets)
    weighted = blend(attach(parts, model.weights, SERIES))
    bounded = calibrated(attach(weighted, model.correction, SERIES))
    return bounded.select(*SERIES, TS, "ensemble", *MODELS, "q05", "q95")


def final_forecast(series: DataFrame, around: Surroundings = Surroundings(), **options) -> ForecastModel:
    """Validate on the last calendar month, then refit on everything with that calibration."""
    marked = windows.month_holdout(series)
    train = marked.filter(~F.col("is_validation")).drop("is_validation")
    held = marked.filter("is_validation").drop("is_validation")
    validated = train_forecast(train, held, around, **options)
    return with_calibration(train_forecast(series, None, around, **options), validated)


def forecast_requests(model: ForecastModel, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch forecast of (station, item, start, end) rows; (predictions, rejects).

    Rejected are unknown series and empty ranges.
    """
    hours = hour_index(F.col("end")) - hour_index(F.col("start")) + 1
    known = model.ridge.select(*SERIES).withColumn("_known", F.lit(True))
    judged = requests.join(known, list(SERIES), "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "series not trained").when(hours <= 0, "range holds no hour"),
    )
    rejects = judged.filter(F.col("reason").isNotNull()).drop("_known")
    spans = judged.filter(F.col("reason").isNull()).select(
        *SERIES, hour_index(F.col("start")).alias("_a"), hour_index(F.col("end")).alias("_b")
    )
    targets = hours_in(spans, "_a", "_b", "_hour").select(*SERIES, hour_to_ts(F.col("_hour")).alias(TS)).distinct()
    answer = predict_forecast(model, targets).select(
        *SERIES,
        TS,
        F.round("ensemble", 6).alias("predicted_value"),
        F.round("q05", 6).alias("predicted_lower_90"),
        F.round("q95", 6).alias("predicted_upper_90"),
    )
    return answer, rejects


def cross_validate(
    series: DataFrame,
    around: Surroundings = Surroundings(),
    n_folds: int = 3,
    test_size: int = 720,
    min_train_size: int = 8760,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Walk-forward validation: (model metrics, interval metrics) per series and fold."""
    folds = windows.walk_forward_folds(series, n_folds, test_size, min_train_size)
    rows = cut(windows.assign_folds(series, folds))
    spread = evaluate.series_spread(series, SERIES)
    scores, intervals = [], []
    for fold in range(n_folds):
        part = rows.filter(F.col("fold") == fold)
        if part.isEmpty():
            continue
        train = part.filter(~F.col("is_test")).select(*SERIES, TS, VALUE)
        test = part.filter("is_test").select(*SERIES, TS, VALUE)
        model = train_forecast(train, test, around, **options)
        judged = cut(
            predict_forecast(model, test).join(test.withColumnRenamed(VALUE, "y_true"), [*SERIES, TS])
        )
        long = judged.unpivot([*SERIES, "y_true"], ["naive", "lgbm", "ensemble"], "model", "y_pred")
        scores.append(evaluate.forecast_metrics(long, [*SERIES, "model"]).withColumn("fold", F.lit(fold)))
        intervals.append(evaluate.interval_metrics(judged, SERIES).withColumn("fold", F.lit(fold)))
    if not scores:
        raise ValueError("no series is long enough for a fold")
    joined = reduce(DataFrame.unionByName, scores).join(spread, list(SERIES), "left")
    overall = joined.withColumn("nrmse_overall", F.try_divide("rmse", "overall_std")).drop("overall_std")
    return overall, reduce(DataFrame.unionByName, intervals)


# --- single-model variants -----------------------------------------------------


def _unscaled(rows: DataFrame, scales: DataFrame, column: str) -> DataFrame:
    """Predictions of the standardised target back on the scale of their series."""
    mean, std = f"{VALUE}__mean", f"{VALUE}__std"
    joined = attach(rows, scales, SERIES)
    return joined.withColumn(column, F.col(column) * F.col(std) + F.col(mean)).drop(mean, std)


def train_direct(train: DataFrame, trees: int = TREE_COUNT, depth: int = 6):
    """Boosted trees on 17 direct features; the last 10 % of each series stops the boosting."""
    rows, columns = ft.direct_features(train)
    parted = windows.chronological_split(
        complete_rows(rows.select(*SERIES, TS, VALUE, *columns), [VALUE, *columns])
    )
    parted = cut(parted.select(*SERIES, TS, VALUE, "is_train", *columns))
    return fit_boosted(
        parted.filter("is_train"), VALUE, columns, parted.filter(~F.col("is_train")), trees=trees, depth=depth, step=0.05
    )


def predict_direct(model: PipelineModel, train: DataFrame, targets: DataFrame) -> DataFrame:
    rows, columns = ft.direct_features(train, targets)
    scored = apply_boosted(model, _zero_nulls(rows, columns), "_p")
    return scored.select(*SERIES, TS, floor_at(F.col("_p"), 0.0).alias("direct"))


def train_global(
    readings: DataFrame, trees: int = TREE_COUNT, depth: int = 10, by_time: bool = False
):
    """One model over all series: (model, common origin, training rows).

    The evaluation tenth is cut in (station, item, time) order, or per series by
    time with ``by_time``.
    """
    rows = cut(readings.filter(F.col(VALUE).isNotNull()))
    epoch = rows.agg(F.min(TS)).first()[0]
    table, columns = ft.global_features(rows, None, F.lit(epoch).cast("timestamp_ntz"))
    table = _zero_nulls(table.withColumn("_y", F.log1p(VALUE)), columns)
    table = cut(table.select(*SERIES, TS, "_y", *[c for c in columns if c not in SERIES]))
    parted = windows.chronological_split(table) if by_time else windows.ordered_split(table, [*SERIES, TS])
    model = fit_boosted(
        parted.filter("is_train"), "_y", columns, parted.filter(~F.col("is_train")), trees=trees, depth=depth, share=0.7
    )
    return model, epoch, rows


def predict_global(model: PipelineModel, epoch, train: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets need station, item, hour and coordinates."""
    rows, columns = ft.global_features(train, targets, F.lit(epoch).cast("timestamp_ntz"))
    scored = apply_boosted(model, _zero_nulls(rows, columns), "_p")
    return scored.select(*SERIES, TS, floor_at(F.expm1("_p"), 0.0).alias("global"))


def usable_readings(cleaned: DataFrame) -> DataFrame:
    return decimals_to_double(cleaned.filter(usable()).select(*SERIES, TS, VALUE))
