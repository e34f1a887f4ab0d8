"""Row-based window operators over every series at once.

Frames count rows, not hours; NULL readings take a place in the frame but are
skipped by the aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.scalars import floor_at
from hourloom.operators.ordered import (
    CHUNK,
    attach,
    chunk_carry,
    over_chunks,
    row_positions,
    with_halo,
)
from hourloom.schemas import SERIES, TS

# fixed values: window lengths and lags in rows
ROLLING_WINDOWS = (3, 6, 12, 24, 48, 168)
LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
TINY = 1e-10


# --- column builders, given the window of the series --------------------------


def lagged(w, value: str, lags) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def differences(w, value: str, lags) -> dict[str, Column]:
    out = {}
    for k in lags:
        step = F.col(value) - F.lag(value, k).over(w)
        out[f"diff_{k}"] = step
        out[f"abs_diff_{k}"] = F.abs(step)
    return out


def rolling_before(w, value: str, windows) -> dict[str, Column]:
    """Mean, std, min, max, range and z-score against the previous n rows."""
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        mean, std = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
        low, high = F.min(value).over(frame), F.max(value).over(frame)
        out[f"rmean_{n}"] = mean
        out[f"rstd_{n}"] = std
        out[f"rmin_{n}"] = low
        out[f"rmax_{n}"] = high
        out[f"rrange_{n}"] = high - low
        out[f"zscore_{n}"] = (F.col(value) - mean) / floor_at(std, TINY)
    return out


def flatline(w, value: str, n: int, needed: int) -> Column:
    """1 when the last n rows, current included, do not move."""
    frame = w.rowsBetween(-(n - 1), 0)
    enough = F.count(value).over(frame) >= needed
    return F.coalesce(enough & (F.stddev_samp(value).over(frame) < TINY), F.lit(False)).cast("int")


def spike(w, value: str) -> Column:
    """Distance to the mean of the two neighbours; NULL at both ends."""
    return F.abs(F.col(value) - (F.lag(value).over(w) + F.lead(value).over(w)) / 2)


# --- frame operators ---------------------------------------------------------


def lookbacks(df: DataFrame, n: int, keys=SERIES, ts: str = TS, value: str = "clean_value") -> DataFrame:
    """Rows that have n predecessors, with those values as an array."""
    keys, rows = list(keys), row_positions(df, keys, ts)
    framed = with_halo(rows, "_pos", before=n).repartition(*keys, "_chunk")
    block = F.floor((F.col("_pos") - F.col("_chunk") * CHUNK) / n)  # -1: the copies from the chunk before
    other = [c for c in rows.columns if c not in [*keys, "_pos"]]
    blocks = framed.groupBy(*keys, "_chunk", block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", *other))).alias("_rows")
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy("_block")
    held = F.concat(F.lag(f"_rows.{value}").over(w), F.col(f"_rows.{value}"))
    # a row's n predecessors end the block before and begin its own
    around = blocks.select(*keys, "_block", "_rows", held.alias("_held")).filter("_block >= 0")
    each = around.select(*keys, "_held", F.posexplode("_rows").alias("_i", "_row")).filter(F.col("_row._pos") >= n)
    out = each.withColumn("lookback", F.slice("_held", F.col("_i") + 1, n))
    return out.select(*[F.col(c if c in keys else f"_row.{c}") for c in rows.columns if c != "_pos"], "lookback")


def lags_and_diffs(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value", lags=LAGS) -> DataFrame:
    rows = row_positions(df, keys, ts)
    return over_chunks(
        rows, keys, "_pos", lambda w: lagged(w, value, lags) | differences(w, value, lags), before=max(lags)
    ).drop("_pos")


def rolling_statistics(
    df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value", windows=ROLLING_WINDOWS
) -> DataFrame:
    rows = row_positions(df, keys, ts)
    return over_chunks(
        rows, keys, "_pos", lambda w: rolling_before(w, value, windows), before=max(windows)
    ).drop("_pos")


def spike_scores(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value") -> DataFrame:
    rows = row_positions(df, keys, ts)
    return over_chunks(rows, keys, "_pos", lambda w: {"spike_score": spike(w, value)}, before=1, after=1).drop("_pos")


def flatlines(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value") -> DataFrame:
    rows = row_positions(df, keys, ts)
    return over_chunks(
        rows,
        keys,
        "_pos",
        lambda w: {"flatline_6h": flatline(w, value, 6, 3), "flatline_12h": flatline(w, value, 12, 6)},
        before=11,
    ).drop("_pos")


def same_as_before(w, value: str) -> Column:
    return F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))


def count_identical(marked: DataFrame, keys, chunk: int = CHUNK, out: str = "consecutive_same") -> DataFrame:
    """Readings in a row equal to their predecessor; 0 when the value changed.

    ``marked`` carries ``_pos``, ``_chunk`` and ``_same``.  A run may span any
    number of chunks: the position of the last change before a chunk arrives as
    one row per chunk.
    """
    keys = list(keys)
    change = F.when(~F.col("_same"), F.col("_pos"))
    carry = chunk_carry(marked.select(*keys, "_pos", "_same"), keys, "_pos", {"_carry": change}, chunk=chunk)
    running = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_change", F.max(change).over(running))
        .join(carry, [*keys, "_chunk"])
        .withColumn(out, F.col("_pos") - F.coalesce("_change", "_carry"))
        .drop("_chunk", "_carry", "_change", "_same")
    )


def stuck_runs(df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value") -> DataFrame:
    rows = row_positions(df, keys, ts)
    marked = over_chunks(
        rows, keys, "_pos", lambda w: {"_same": same_as_before(w, value)}, before=1, keep_chunk=True
    )
    return count_identical(marked, keys).drop("_pos")


def drop_short_runs(
    df: DataFrame,
    flag: str = "raw_flag",
    out: str = "is_anomaly",
    keys=SERIES,
    ts: str = TS,
    min_length: int = 3,
    chunk: int = CHUNK,
) -> DataFrame:
    """Set flags to 0 that belong to a run of ones shorter than ``min_length``.

    Whether a run reaches the length shows within ``min_length`` rows on either
    side, so a halo of that size decides it exactly.
    """
    keys = list(keys)
    rows = row_positions(df, keys, ts, chunk)

    def run_long_enough(w):
        zero = F.when(F.col(flag) == 0, F.col("_pos"))
        before = F.max(zero).over(w.rowsBetween(-min_length, 0))
        after = F.min(zero).over(w.rowsBetween(0, min_length))
        first = F.min("_pos").over(w.rowsBetween(-min_length, 0))
        last = F.max("_pos").over(w.rowsBetween(0, min_length))
        length = F.coalesce(after, last + 1) - F.coalesce(before, first - 1) - 1
        return {"_long": length >= min_length}

    kept = over_chunks(rows, keys, "_pos", run_long_enough, min_length, min_length, chunk)
    return kept.withColumn(out, F.when((F.col(flag) == 1) & ~F.col("_long"), 0).otherwise(F.col(flag))).drop(
        "_long", "_pos"
    )


def smooth_flags(
    df: DataFrame,
    flag: str = "raw_flag",
    out: str = "is_anomaly",
    keys=SERIES,
    ts: str = TS,
    min_length: int = 3,
    rate: float = 0.05,
) -> DataFrame:
    """Drop short runs only in series whose share of raw flags exceeds ``rate``."""
    keys = list(keys)
    rates = df.groupBy(*keys).agg(F.avg(flag).alias("_rate"))
    filtered = drop_short_runs(df, flag, out, keys, ts, min_length)
    return (
        attach(filtered, rates, keys, ts)
        .withColumn(out, F.when(F.col("_rate") > rate, F.col(out)).otherwise(F.col(flag)))
        .drop("_rate")
    )


def last_rows(df: DataFrame, n: int, keys=SERIES, ts: str = TS) -> DataFrame:
    """The last n rows of every series, whatever n is."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    rows = attach(row_positions(df, keys, ts), sizes, keys, ts)
    return rows.filter(F.col("_pos") >= F.col("_size") - n).drop("_pos", "_size")


def numbered(df: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """Rows with ``_pos`` and the series length ``_size``."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    return attach(row_positions(df, keys, ts), sizes, keys, ts)


def chronological_split(df: DataFrame, keys=SERIES, ts: str = TS, share: float = 0.9) -> DataFrame:
    """Add ``is_train``: the first ``share`` of the rows of each series by time."""
    return numbered(df, keys, ts).withColumn(
        "is_train", F.col("_pos") < F.floor(F.col("_size") * F.lit(share))
    ).drop("_pos", "_size")


def ordered_split(df: DataFrame, order, share: float = 0.9) -> DataFrame:
    """Add ``is_train`` by position in one overall order (station, item, time).

    The cut then falls between series, not between earlier and later hours;
    use :func:`chronological_split` for a split by time.
    """
    from hourloom.operators.ranks import running_totals

    rows = df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    ranked = running_totals(rows, ["_all"], [F.col(c) for c in order], ["_one"])
    return ranked.withColumn(
        "is_train", F.col("_one_run") <= F.floor(F.col("_one_all") * F.lit(share))
    ).drop("_all", "_one", "_one_run", "_one_all")


def walk_forward_folds(
    df: DataFrame,
    n_folds: int = 3,
    test_size: int = 720,
    min_train_size: int = 8760,
    keys=SERIES,
) -> DataFrame:
    """Fold bounds by row position per series, oldest fold first.

    ``fold`` counts from 0; a series keeps only the folds whose training part
    has at least ``min_train_size`` rows.
    """
    keys = list(keys)
    back = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("_back")
    bounds = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_size"))
        .select(*keys, "_size", back)
        .withColumn("test_end", F.col("_size") - F.col("_back") * test_size)
        .withColumn("test_start", F.col("test_end") - test_size)
        .withColumn("train_end", F.col("test_start"))
        .filter(F.col("train_end") >= min_train_size)
    )
    w = Window.partitionBy(*keys).orderBy("test_start")
    return bounds.select(*keys, (F.row_number().over(w) - 1).alias("fold"), "train_end", "test_start", "test_end")


def assign_folds(df: DataFrame, folds: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """Rows repeated per fold with ``is_test``; rows after the test part are left out."""
    keys = list(keys)
    packed = folds.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("fold", "train_end", "test_start", "test_end"))).alias("_folds")
    )
    rows = attach(row_positions(df, keys, ts), packed, keys, ts)
    return (
        rows.withColumn("_f", F.explode("_folds"))
        .filter(F.col("_pos") < F.col("_f.test_end"))
        .select(*df.columns, F.col("_f.fold").alias("fold"), (F.col("_pos") >= F.col("_f.test_start")).alias("is_test"))
    )


def month_holdout(df: DataFrame, keys=SERIES, ts: str = TS) -> DataFrame:
    """Add ``is_validation``: the last calendar month of each series."""
    from hourloom.functions.calendar import last_month_start

    ends = df.groupBy(*keys).agg(last_month_start(F.max(ts)).alias("_cut"))
    return attach(df, ends, keys, ts).withColumn("is_validation", F.col(ts) >= F.col("_cut")).drop("_cut")


def tail_statistics(
    df: DataFrame, keys=SERIES, ts: str = TS, value: str = "clean_value", windows=(24, 168, 720)
) -> DataFrame:
    """Mean, std, min and max of the last n rows of each series."""
    keys = list(keys)
    # partial: each task keeps at most max(windows) rows per series before the shuffle
    latest = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    tail = (
        df.select(*keys, ts, value).withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= max(windows))
    )
    aggregates = []
    for n in windows:
        v = F.when(F.col("_back") <= n, F.col(value))
        aggregates += [
            F.avg(v).alias(f"last_{n}h_mean"),
            F.stddev_samp(v).alias(f"last_{n}h_std"),
            F.min(v).alias(f"last_{n}h_min"),
            F.max(v).alias(f"last_{n}h_max"),
        ]
    return tail.groupBy(*keys).agg(*aggregates)
