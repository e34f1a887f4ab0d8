"""Feature tables for forecasting and anomaly detection, all series at once.

Builders return ``(DataFrame, feature columns)``.  ``value`` is the already
transformed target (log1p in the forecast plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.calendar import (
    CALENDAR_COLUMNS,
    CYCLICAL_COLUMNS,
    FOURIER_COLUMNS,
    calendar,
    cyclical,
    fourier,
    hour_index,
)
from hourloom.functions.scalars import floor_at
from hourloom.operators.lookback import ANCHOR_LAGS, anchor_lags
from hourloom.operators.ordered import attach, attach_by_chunk, chunk_of, chunk_window, over_chunks, row_positions, spread_over
from hourloom.operators.profiles import (
    ENCODED,
    encoding_arrays,
    group_statistics,
    hour_statistics,
    hourly_deviation,
    looked_up,
)
from hourloom.operators.spatial import fill_on_targets
from hourloom.operators.windows import (
    LAGS,
    ROLLING_WINDOWS,
    TINY,
    count_identical,
    differences,
    flatline,
    lagged,
    rolling_before,
    same_as_before,
    spike,
    tail_statistics,
)
from hourloom.schemas import ITEM_NAMES, SERIES, TS

# fixed values
ROLLING_HOURS = (24, 168)
CROSS_LAGS = (168, 336)
CROSS_MEAN = 24

ENCODING_COLUMNS = [f"enc_{level}" for level in ENCODED]
ANCHOR_COLUMNS = [f"anchor_lag_{k}h" for k in ANCHOR_LAGS]
ROLLING_COLUMNS = [f"rolling_{what}_{n}h" for n in ROLLING_HOURS for what in ("mean", "std")]
BASE_COLUMNS = (
    CALENDAR_COLUMNS + CYCLICAL_COLUMNS + FOURIER_COLUMNS + ENCODING_COLUMNS + ANCHOR_COLUMNS + ROLLING_COLUMNS
)
SPATIAL_COLUMNS = ["spatial_idw_mean", "spatial_std"]
DIRECT_COLUMNS = (
    CALENDAR_COLUMNS
    + CYCLICAL_COLUMNS
    + ["hour_mean", "hour_std", "hour_median", "hour_dow_mean", "hour_dow_std", "month_hour_mean"]
)
GLOBAL_COLUMNS = (
    list(SERIES)
    + CALENDAR_COLUMNS
    + CYCLICAL_COLUMNS
    + FOURIER_COLUMNS
    + ["latitude", "longitude", "enc_hour", "enc_hour_dow", "enc_month_hour", "group_mean", "group_std"]
)


def series_epochs(train: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """First hour of each series, the origin of its Fourier terms."""
    return train.groupBy(*keys).agg(F.min(ts).alias("epoch"))


def time_columns(df: DataFrame, epochs: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """Calendar, cyclical and Fourier columns with each series' own origin.

    ``epochs`` may hold more facts of the series; they reach the rows in the same join.
    """
    return _with_time(attach_by_chunk(df, epochs, keys, ts), ts)


def _with_time(df: DataFrame, ts: str) -> DataFrame:
    t = F.col(ts)
    return df.withColumns(calendar(t) | cyclical(t) | fourier(t, F.col("epoch"))).drop("epoch")


# --- forecasting -------------------------------------------------------------


def train_features(filled: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value"):
    """48 features on gap-filled hourly series; lags and rolling windows look back only."""
    keys = list(keys)

    def look_back(w):
        out = {name: F.lag(value, k).over(w) for name, k in zip(ANCHOR_COLUMNS, ANCHOR_LAGS)}
        for n in ROLLING_HOURS:
            frame = w.rowsBetween(-n, -1)
            out[f"rolling_mean_{n}h"] = F.avg(value).over(frame)
            out[f"rolling_std_{n}h"] = F.stddev_samp(value).over(frame)
        return out

    # the series is regular, so the hour itself is the row position
    rows = filled.withColumn("_hour", hour_index(F.col(ts)))
    tasks = spread_over(filled)
    rows = over_chunks(rows, keys, "_hour", look_back, before=max(ANCHOR_LAGS), keep_chunk=True, tasks=tasks).drop("_hour")
    arrays = encoding_arrays(filled, keys, ts, value)
    return _with_time(_encoded(rows, arrays, keys, ts, tasks, "epoch", "_last"), ts), list(BASE_COLUMNS)


def _encoded(rows: DataFrame, arrays: DataFrame, keys, ts: str, tasks: int, first: str, last: str) -> DataFrame:
    """Rows, dealt by (series, ``_chunk``) over ``tasks``, with their encodings and the ``epoch`` of their series.

    The arrays are copied for the chunks from hour ``first`` to ``last`` of ``arrays``; the rows stay where they are.
    """
    chunks = F.sequence(*[chunk_of(hour_index(F.col(c))) for c in (first, last)])
    copies = arrays.select(*keys, "epoch", "_enc", F.explode(chunks).alias("_chunk")).repartition(tasks, *keys, "_chunk")
    met = rows.join(copies, [*keys, "_chunk"], "left")
    rest = [c for c in rows.columns if c != "_chunk"]
    return met.select(*rest, "epoch", *[c.alias(n) for n, c in looked_up(F.col("_enc"), F.col(ts)).items()])


def prediction_features(targets: DataFrame, filled: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value"):
    """The same features for future hours, from the training series only.

    Anchor lags are looked up; the rolling columns hold the statistics of the
    end of the training series.  ``horizon_step`` counts the hours of each target.
    """
    keys = list(keys)
    rows = anchor_lags(targets, filled, keys, ts, value)
    tasks = spread_over(filled)
    spans = targets.groupBy(*keys).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to")).filter("_to IS NOT NULL")
    arrays = encoding_arrays(filled, keys, ts, value).join(spans, keys)
    rows = rows.withColumn("_chunk", chunk_of(hour_index(F.col(ts)))).repartition(tasks, *keys, "_chunk")
    rows = _encoded(rows, arrays, keys, ts, tasks, "_from", "_to")
    tails = tail_statistics(filled, keys, ts, value, ROLLING_HOURS).select(
        *keys, *[F.col(f"last_{n}h_{what}").alias(f"rolling_{what}_{n}h") for n in ROLLING_HOURS for what in ("mean", "std")]
    )
    starts = targets.groupBy(*keys).agg(F.min(ts).alias("_start"))
    rows = attach(rows, tails.join(starts, keys, "full"), keys, ts)
    step = F.timestamp_diff("HOUR", F.col("_start"), F.col(ts))
    return _with_time(rows.withColumn("horizon_step", step).drop("_start"), ts), list(BASE_COLUMNS)


def cross_column(item: int, what: str) -> str:
    return f"xpol_{ITEM_NAMES[item].replace('.', '_')}_{what}"


CROSS_COLUMNS = [
    cross_column(item, what)
    for item in ITEM_NAMES
    for what in [f"lag{k}h" for k in CROSS_LAGS] + [f"rmean{CROSS_MEAN}"]
]


def _other_items(targets: DataFrame) -> DataFrame:
    codes = F.explode(F.array(*[F.lit(c).cast("long") for c in ITEM_NAMES]))
    pairs = targets.select(*SERIES).distinct().withColumn("other_item", codes)
    return pairs.filter(F.col("other_item") != F.col("item_code"))


def _pivot_items(rows: DataFrame, columns: dict[str, str], time: str) -> DataFrame:
    """(series, hour, other item) rows to one row with a column per item and measure."""
    return rows.groupBy(*SERIES, time).agg(
        *[
            F.max(F.when(F.col("other_item") == item, F.col(source))).alias(cross_column(item, what))
            for item in ITEM_NAMES
            for what, source in columns.items()
        ]
    )


def _cross_filled(targets: DataFrame, readings: DataFrame, ts: str, value: str, before: int = 0) -> DataFrame:
    """Target rows with a filled column ``_<item>`` for each of the station's pollutants, empty for the target's own."""
    codes = list(ITEM_NAMES)
    slot = F.array_position(F.array(*[F.lit(c).cast("long") for c in codes]), F.col("other_item")) - 1
    links = _other_items(targets).withColumns({"_slot": slot, "_weight": F.lit(1.0)})
    source = readings.select("station_code", F.col("item_code").alias("other_item"), ts, value)
    rows = fill_on_targets(targets, links, source, ["station_code", "other_item"], len(codes), ts, value, before)
    return rows.withColumns({f"_{c}": F.col("_filled")[i]["v"] for i, c in enumerate(codes)}).drop("_filled")


def cross_item_features(targets: DataFrame, readings: DataFrame, ts: str = TS, value: str = "clean_value") -> DataFrame:
    """Lags and 24-hour mean of the other pollutants of the station on the target's hours."""
    rows = _cross_filled(targets, readings, ts, value, before=max(CROSS_LAGS))
    w = chunk_window(SERIES, "_hour")
    same_hour = Window.partitionBy(*SERIES, "_chunk", "_hour")
    looked = {}
    for item in ITEM_NAMES:
        looked |= {cross_column(item, f"lag{k}h"): F.lag(f"_{item}", k).over(w) for k in CROSS_LAGS}
        looked[cross_column(item, f"rmean{CROSS_MEAN}")] = F.avg(f"_{item}").over(w.rowsBetween(-CROSS_MEAN, -1))
    kept = rows.withColumns(looked).filter("_home")
    # rows of the same hour share what any of them found; without an hour nothing is found
    found = {c: F.when(F.col("_hour").isNotNull(), F.max(c).over(same_hour)) for c in CROSS_COLUMNS}
    rest = [c for c in targets.columns if c not in SERIES]
    return kept.withColumns(found).select(*SERIES, *rest, *CROSS_COLUMNS)


def cross_item_features_for_prediction(
    targets: DataFrame, readings: DataFrame, train_hours: DataFrame, ts: str = TS, value: str = "clean_value"
) -> DataFrame:
    """Looked-up lags of the other pollutants; their hourly mean stands in for the rolling mean.

    ``train_hours`` are the training hours the hourly means are taken over.
    """
    pairs = _other_items(targets)
    wanted = targets.select(*SERIES, ts).join(pairs, list(SERIES))
    source = readings.select("station_code", F.col("item_code").alias("other_item"), ts, value)
    lagged_rows = anchor_lags(wanted, source, ["station_code", "other_item"], ts, value, CROSS_LAGS, "_lag{}")
    means = (
        _cross_filled(train_hours, readings, ts, value)
        .withColumn("_h", F.pmod(F.col("_hour"), F.lit(24)).cast("int"))
        .groupBy(*SERIES, "_h")
        .agg(*[F.avg(f"_{item}").alias(f"_{item}") for item in ITEM_NAMES])
    )
    listed = F.explode(
        F.array(*[F.struct(F.lit(c).cast("long").alias("other_item"), F.col(f"_{c}").alias("_mean")) for c in ITEM_NAMES])
    )
    hourly = means.select(*SERIES, "_h", listed.alias("_i")).select(*SERIES, "_h", "_i.*")
    rows = lagged_rows.withColumn("_h", F.hour(ts)).join(hourly, [*SERIES, "other_item", "_h"], "left")
    columns = {f"lag{k}h": f"_lag{k}" for k in CROSS_LAGS} | {f"rmean{CROSS_MEAN}": "_mean"}
    return targets.join(_pivot_items(rows, columns, ts), [*SERIES, ts], "left")


def log_cross_columns(df: DataFrame) -> DataFrame:
    """log1p of the floored cross-pollutant columns and of the spatial mean."""
    present = set(df.columns)
    out: dict[str, Column] = {c: F.log1p(floor_at(F.col(c), 0.0)) for c in CROSS_COLUMNS if c in present}
    if "spatial_idw_mean" in present:
        out["spatial_idw_mean"] = F.log1p("spatial_idw_mean")
    return df.withColumns(out) if out else df


# --- direct and global models ------------------------------------------------


def direct_features(train: DataFrame, targets: DataFrame | None = None, keys=SERIES, ts: str = TS, value: str = "clean_value"):
    """17 features known for any future hour without earlier predictions."""
    rows = hour_statistics(train, targets, keys, ts, value)
    t = F.col(ts)
    return rows.withColumns(calendar(t) | cyclical(t)), list(DIRECT_COLUMNS)


def global_features(
    train: DataFrame, targets: DataFrame | None, epoch: Column, keys=SERIES, ts: str = TS, value: str = "clean_value"
):
    """Features of the one model over all series: codes, one common origin, coordinates, series statistics."""
    rows = group_statistics(train, targets, keys, ts, value)
    t = F.col(ts)
    return rows.withColumns(calendar(t) | cyclical(t) | fourier(t, epoch)), list(GLOBAL_COLUMNS)


# --- anomaly detection -------------------------------------------------------

ANOMALY_COLUMNS = (
    ["value", "log_value"]
    + [f"{what}_{n}" for n in ROLLING_WINDOWS for what in ("rmean", "rstd", "rmin", "rmax", "rrange", "zscore")]
    + [f"{what}_{k}" for k in LAGS for what in ("lag", "diff", "abs_diff")]
    + ["consecutive_same", "flatline_6h", "flatline_12h", "at_zero", "at_negative", "spike_score"]
    + ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month", "is_weekend", "dev_from_hourly_median"]
)
BASELINE_COLUMNS = (
    ["value"]
    + [f"dev_from_mean_{n}h" for n in (6, 12, 24)]
    + ["diff_1h", "diff_24h", "abs_diff_1h", "diff_from_yesterday", "same_as_prev", "consecutive_same"]
    + ["hour", "day_of_week"]
)


def anomaly_features(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value"):
    """75 features per reading; frames count rows, gaps are not filled here.

    The spike score sees the next reading and the hourly median the whole
    series, so the features are not causal.
    """
    keys = list(keys)
    v = F.col(value)
    rows = row_positions(hourly_deviation(df, keys, ts, value), keys, ts)

    def around(w):
        return (
            rolling_before(w, value, ROLLING_WINDOWS)
            | lagged(w, value, LAGS)
            | differences(w, value, LAGS)
            | {
                "flatline_6h": flatline(w, value, 6, 3),
                "flatline_12h": flatline(w, value, 12, 6),
                "spike_score": spike(w, value),
                "_same": same_as_before(w, value),
            }
        )

    marked = over_chunks(rows, keys, "_pos", around, before=max(ROLLING_WINDOWS), after=1, keep_chunk=True)
    t = F.col(ts)
    parts = calendar(t) | cyclical(t)
    out = count_identical(marked, keys).withColumns(
        {
            "value": v,
            "log_value": F.log1p(floor_at(v, 0.0)),
            "at_zero": F.coalesce((v == 0).cast("int"), F.lit(0)),
            "at_negative": F.coalesce((v < 0).cast("int"), F.lit(0)),
        }
        | {c: parts[c] for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month", "is_weekend")}
    )
    return out.select(*df.columns, *[c for c in ANOMALY_COLUMNS if c not in df.columns]), list(ANOMALY_COLUMNS)


def baseline_anomaly_features(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value"):
    """12 features of the unsupervised baseline."""
    keys = list(keys)
    v = F.col(value)

    def around(w):
        out = {}
        for n in (6, 12, 24):
            frame = w.rowsBetween(-n, -1)
            spread = floor_at(F.stddev_samp(value).over(frame), TINY)
            out[f"dev_from_mean_{n}h"] = (v - F.avg(value).over(frame)) / spread
        step, day = v - F.lag(value, 1).over(w), v - F.lag(value, 24).over(w)
        return out | {
            "diff_1h": step,
            "diff_24h": day,
            "abs_diff_1h": F.abs(step),
            "diff_from_yesterday": day,
            "_same": same_as_before(w, value),
        }

    marked = over_chunks(row_positions(df, keys, ts), keys, "_pos", around, before=24, keep_chunk=True)
    t = F.col(ts)
    out = count_identical(marked.withColumn("same_as_prev", F.col("_same").cast("int")), keys).withColumns(
        {"value": v, "hour": F.hour(t), "day_of_week": F.weekday(t)}
    )
    return out.select(*df.columns, *[c for c in BASELINE_COLUMNS if c not in df.columns]), list(BASELINE_COLUMNS)
