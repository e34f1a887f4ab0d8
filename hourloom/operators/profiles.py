"""Calendar profiles: statistics per hour, weekday, month and their crossings.

All levels come from one aggregation to (series, month, weekday, hour) cells,
at most 2016 per series; the coarser levels merge cells, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.operators.ordered import attach, spread_over
from hourloom.operators.ranks import quantiles
from hourloom.schemas import SERIES, TS

CELL = ["month", "day_of_week", "hour"]
LATEST = np.iinfo(np.int64).max

# level name -> cell columns it is made of
LEVELS = {
    "all": [],
    "hour": ["hour"],
    "dow": ["day_of_week"],
    "month": ["month"],
    "hour_dow": ["hour", "day_of_week"],
    "month_hour": ["month", "hour"],
}
ENCODED_SIZES = {"hour": 24, "dow": 7, "month": 12, "hour_dow": 168, "month_hour": 288}
ENCODED = tuple(ENCODED_SIZES)


def with_cells(df: DataFrame, ts: str = TS) -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"month": F.month(t), "day_of_week": F.weekday(t), "hour": F.hour(t)})


def calendar_profile(
    train: DataFrame,
    targets: DataFrame | None = None,
    keys=SERIES,
    ts: str = TS,
    value: str = "clean_value",
    levels=tuple(LEVELS),
) -> DataFrame:
    """``n_``, ``mean_`` and ``std_`` of each level and the first hour (``epoch``) for every cell.

    Cells that only occur in ``targets`` are included, so that an unseen
    combination still finds the coarser levels; a level without data is NULL.
    """
    keys = list(keys)
    cells = (
        with_cells(train, ts)
        .groupBy(*keys, *CELL)
        .agg(
            F.count(value).alias("_n"),
            F.avg(value).alias("_mean"),
            (F.var_pop(value) * F.count(value)).alias("_spread"),
            F.min(ts).alias("_first"),
        )
    )
    if targets is not None:
        wanted = with_cells(targets, ts).select(*keys, *CELL).distinct()
        cells = (
            cells.unionByName(wanted, allowMissingColumns=True)
            .groupBy(*keys, *CELL)
            .agg(*[F.max(c).alias(c) for c in ("_n", "_mean", "_spread", "_first")])
        )
    # one exchange and one sort on the series serve every level below
    n_tasks = spread_over(cells)
    dealt = cells.select(
        *keys,
        *CELL,
        F.coalesce(F.col("_n"), F.lit(0).cast("long")).alias("_n"),
        F.col("_mean").cast("double").alias("_mean"),
        F.col("_spread").cast("double").alias("_spread"),
        F.col("_first").alias("epoch"),
    ).repartition(n_tasks, *keys).sortWithinPartitions(*keys)
    fields = [dealt.schema[c] for c in [*keys, *CELL]]
    fields += [T.StructField(f"n_{m}", T.LongType()) for m in levels]
    fields += [dealt.schema["epoch"]]
    fields += [T.StructField(f"{what}_{m}", T.DoubleType()) for what in ("mean", "std") for m in levels]
    return dealt.mapInArrow(_by_series(keys, lambda rows, starts: _levels_of(rows, starts, keys, levels)), T.StructType(fields))


def _by_series(keys: list[str], build):
    """``build(rows, first rows of the series)`` for rows of cells sorted by series; a series has few cells and is seen whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            starts = _run_starts(rows, keys)
            if len(starts) > 1:
                yield from build(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]) if len(starts) else None
        if held is not None and held.num_rows:
            yield from build(held, np.zeros(1, np.int64))

    return run


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers that are equal where the values are, nulls included."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _run_starts(rows: pa.Table, keys) -> np.ndarray:
    moved = np.arange(rows.num_rows) == 0
    for k in keys:
        codes = _codes(rows[k])
        moved[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(moved)


def _levels_of(rows: pa.Table, starts: np.ndarray, keys, levels) -> Iterator[pa.RecordBatch]:
    size = np.diff([*starts, rows.num_rows])
    series = np.repeat(np.arange(len(starts)), size)
    n = rows["_n"].to_numpy()
    filled = n > 0
    mean, spread = (np.where(filled, pc.fill_null(rows[c], 0.0).to_numpy(), 0.0) for c in ("_mean", "_spread"))
    counts, means, stds = {}, {}, {}
    for level in levels:
        group = series
        for c in LEVELS[level]:
            codes = _codes(rows[c])
            group = group * (codes.max(initial=0) + 1) + codes
        total = np.bincount(group, n).astype(np.int64)[group]
        with np.errstate(invalid="ignore", divide="ignore"):
            middle = np.bincount(group, n * mean)[group] / total
            gap = np.where(filled, mean - middle, 0.0)
            std = np.sqrt(np.bincount(group, spread + n * gap * gap)[group] / (total - 1))
        counts[f"n_{level}"] = pa.array(total, pa.int64())
        means[f"mean_{level}"] = pa.array(middle, pa.float64(), mask=total == 0)
        stds[f"std_{level}"] = pa.array(std, pa.float64(), mask=total < 2)
    first = rows["epoch"].cast(pa.int64())
    least = np.minimum.reduceat(pc.fill_null(first, LATEST).to_numpy(), starts)[series]
    epoch = pa.array(least, pa.int64(), mask=least == LATEST).cast(rows["epoch"].type)
    named = {c: rows[c].combine_chunks() for c in [*keys, *CELL]} | counts | {"epoch": epoch} | means | stds
    yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))


def join_cells(df: DataFrame, facts: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """Left join of cell facts to the rows of that cell."""
    t = F.col(ts)
    rows = df.withColumns({"_month": F.month(t), "_day_of_week": F.weekday(t), "_hour": F.hour(t)})
    named = {c: f"_{c}" for c in CELL}
    on, n_tasks = [*keys, *named.values()], spread_over(df)
    dealt = facts.withColumnsRenamed(named).repartition(n_tasks, *on)
    return rows.repartition(n_tasks, *on).join(dealt, on, "left").drop(*named.values())


def smoothed(level: str, smoothing: float) -> Column:
    """Group mean pulled towards the series mean; unseen groups get the series mean."""
    weight = F.col(f"n_{level}") / (F.col(f"n_{level}") + F.lit(smoothing))
    return F.coalesce(weight * F.col(f"mean_{level}") + (1 - weight) * F.col("mean_all"), F.col("mean_all"))


def encoding_arrays(train: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value", smoothing: float = 10.0) -> DataFrame:
    """Per series the encodings of all levels as one array (``_enc``), and the first and last training hour.

    The values are those of :func:`encoding_table`, but 499 numbers instead of five for each of 2016 cells.  Groups that
    training never saw hold the series mean.
    """
    keys = list(keys)
    cells = with_cells(train, ts).groupBy(*keys, *CELL).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.min(ts).alias("epoch"), F.max(ts).alias("_last")
    )
    dealt = cells.withColumn("_mean", F.col("_mean").cast("double")).repartition(spread_over(train), *keys).sortWithinPartitions(*keys)
    fields = [dealt.schema[c] for c in [*keys, "epoch", "_last"]] + [T.StructField("_enc", T.ArrayType(T.DoubleType()))]
    return dealt.mapInArrow(_by_series(keys, lambda rows, starts: _encodings_of(rows, starts, keys, smoothing)), T.StructType(fields))


def _extreme(column: pa.ChunkedArray, starts: np.ndarray, least: bool) -> pa.Array:
    """Least or greatest time of each series."""
    numbers, none = column.cast(pa.int64()), LATEST if least else -LATEST
    found = (np.minimum if least else np.maximum).reduceat(pc.fill_null(numbers, none).to_numpy(), starts)
    return pa.array(found, pa.int64(), mask=found == none).cast(column.type)


def _encodings_of(rows: pa.Table, starts: np.ndarray, keys, smoothing: float) -> Iterator[pa.RecordBatch]:
    series = np.repeat(np.arange(len(starts)), np.diff([*starts, rows.num_rows]))
    n = rows["_n"].to_numpy()
    mean = np.where(n > 0, pc.fill_null(rows["_mean"], 0.0).to_numpy(), 0.0)

    def merged(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(group, n).astype(np.int64)[group]
        with np.errstate(invalid="ignore", divide="ignore"):
            return total, np.bincount(group, n * mean)[group] / total

    total, overall = merged(series)
    out = np.repeat(overall[starts][:, None], sum(ENCODED_SIZES.values()), axis=1)
    known = np.logical_and.reduce([rows[c].is_valid().to_numpy() for c in CELL])  # not so without a time
    number = {c: pc.fill_null(rows[c], 1).to_numpy().astype(np.int64) for c in CELL}
    first = 0
    for level, size in ENCODED_SIZES.items():
        at = _spot(level, number["month"], number["day_of_week"], number["hour"])
        # without a time a cell is in a group of its own level
        group = np.unique(np.stack([series, np.where(known, at, -1)]), axis=1, return_inverse=True)[1].ravel()
        count, middle = merged(group)
        weight = count / (count + smoothing)
        with np.errstate(invalid="ignore"):
            value = np.where(count > 0, weight * middle + (1 - weight) * overall, overall)
        out[series[known], first + at[known]] = value[known]
        first += size
    arrays = [None if t == 0 else own.tolist() for t, own in zip(total[starts], out)]
    columns = [rows[k].combine_chunks().take(pa.array(starts)) for k in keys]
    columns += [_extreme(rows["epoch"], starts, True), _extreme(rows["_last"], starts, False)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(arrays, pa.list_(pa.float64()))], [*keys, "epoch", "_last", "_enc"])


def _spot(level: str, month, day_of_week, hour):
    """Place of a group among those of its level."""
    return {
        "hour": hour,
        "dow": day_of_week,
        "month": month - 1,
        "hour_dow": hour * 7 + day_of_week,
        "month_hour": (month - 1) * 24 + hour,
    }[level]


def looked_up(arrays: Column, t: Column) -> dict[str, Column]:
    """The encodings of an hour from the array of its series."""
    out, first = {}, 0
    for level, size in ENCODED_SIZES.items():
        out[f"enc_{level}"] = F.get(arrays, _spot(level, F.month(t), F.weekday(t), F.hour(t)) + first)
        first += size
    return out


def target_encodings(
    train: DataFrame,
    targets: DataFrame | None = None,
    keys=SERIES,
    ts: str = TS,
    value: str = "clean_value",
    smoothing: float = 10.0,
) -> DataFrame:
    """Five smoothed encodings on the target rows (the training rows by default).

    Training rows contribute to their own encoding, as the source method does.
    """
    encoded = encoding_table(train, targets, keys, ts, value, smoothing)
    return join_cells(train if targets is None else targets, encoded.drop("epoch"), keys, ts)


def encoding_table(train, targets=None, keys=SERIES, ts: str = TS, value: str = "clean_value", smoothing: float = 10.0):
    """The encodings and the first training hour per (series, month, weekday, hour) cell."""
    profile = calendar_profile(train, targets, keys, ts, value)
    return profile.select(*keys, *CELL, "epoch", *[smoothed(level, smoothing).alias(f"enc_{level}") for level in ENCODED])


def hour_statistics(
    train: DataFrame, targets: DataFrame | None = None, keys=SERIES, ts: str = TS, value: str = "clean_value"
) -> DataFrame:
    """Same-hour, same-hour-and-weekday and same-month-and-hour statistics.

    On unseen (hour, weekday) or (month, hour) the same-hour statistic steps in;
    the std of a seen group of one row stays NULL.
    """
    keys = list(keys)
    profile = calendar_profile(train, targets, keys, ts, value, ("hour", "hour_dow", "month_hour"))
    medians = quantiles(with_cells(train, ts), [*keys, "hour"], value, {"hour_median": 0.5})
    seen = F.col("n_hour_dow") > 0
    on, n_tasks = [*keys, "hour"], spread_over(train)
    facts = profile.repartition(n_tasks, *on).join(medians.repartition(n_tasks, *on), on, "left").select(
        *keys,
        *CELL,
        F.col("mean_hour").alias("hour_mean"),
        F.col("std_hour").alias("hour_std"),
        "hour_median",
        F.when(seen, F.col("mean_hour_dow")).otherwise(F.col("mean_hour")).alias("hour_dow_mean"),
        F.when(seen, F.col("std_hour_dow")).otherwise(F.col("std_hour")).alias("hour_dow_std"),
        F.coalesce("mean_month_hour", "mean_hour").alias("month_hour_mean"),
    )
    return join_cells(train if targets is None else targets, facts, keys, ts)


def group_statistics(
    train: DataFrame, targets: DataFrame | None = None, keys=SERIES, ts: str = TS, value: str = "clean_value"
) -> DataFrame:
    """Series means by hour, hour and weekday, month and hour, overall mean and std.

    Unseen groups get the series mean; an unknown series gets mean 0 and std 1.
    """
    profile = calendar_profile(train, targets, keys, ts, value, ("all", "hour", "hour_dow", "month_hour"))
    known = F.col("n_all") > 0
    mean = F.when(known, F.col("mean_all")).otherwise(0.0)
    facts = profile.select(
        *keys,
        *CELL,
        F.coalesce("mean_hour", mean).alias("enc_hour"),
        F.coalesce("mean_hour_dow", mean).alias("enc_hour_dow"),
        F.coalesce("mean_month_hour", mean).alias("enc_month_hour"),
        mean.alias("group_mean"),
        F.when(known, F.col("std_all")).otherwise(1.0).alias("group_std"),
    )
    return join_cells(train if targets is None else targets, facts, keys, ts)


def hourly_deviation(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value") -> DataFrame:
    """Distance to the same-hour median in units of the same-hour std (floored)."""
    keys = list(keys)
    hours = df.withColumn("_h", F.hour(ts))
    medians = quantiles(hours, [*keys, "_h"], value, {"_median": 0.5})
    spreads = hours.groupBy(*keys, "_h").agg(F.stddev_samp(value).alias("_std"))
    facts = spreads.join(medians, [*keys, "_h"], "left")
    scale = F.when(F.col("_std").isNotNull(), F.greatest("_std", F.lit(1e-10)))
    return (
        attach(hours, facts, [*keys, "_h"], ts)
        .withColumn("dev_from_hourly_median", (F.col(value) - F.col("_median")) / scale)
        .drop("_h", "_median", "_std")
    )
