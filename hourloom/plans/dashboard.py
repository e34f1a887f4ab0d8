"""Named dashboard and exploration queries over ``dashboard_wide`` and ``measurements_clean``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.calendar import day_name, iso_text, ntz, year_month
from hourloom.functions.scalars import all_of, in_list, percent, status_label, usable
from hourloom.operators.panels import station_statistics
from hourloom.schemas import (
    AIR_QUALITY,
    DATA_WINDOW,
    DEFAULT_RANGE,
    ITEM_COLUMNS,
    ITEM_LABELS,
    STATION_CODES,
    STATUS_ABNORMAL_DATA,
    STATUS_NORMAL,
    TS,
    item_column,
)

# fixed values: named periods and station groups
PERIODS = {
    "Dec 2023": DEFAULT_RANGE,
    "Q4 2023": ("2023-10-01T00:00:00", "2023-12-31T23:00:00"),
    "2023": ("2023-01-01T00:00:00", "2023-12-31T23:00:00"),
    "2022": ("2022-01-01T00:00:00", "2022-12-31T23:00:00"),
    "2021": ("2021-01-01T00:00:00", "2021-12-31T23:00:00"),
    "All": DATA_WINDOW,
}
STATION_GROUPS = {
    "All 25": STATION_CODES,
    "First 5": STATION_CODES[:5],
    "Central (212–216)": (212, 213, 214, 215, 216),
}
SEASON_ORDER = ("Spring", "Summer", "Fall", "Winter")


def in_range(start: str, end: str) -> Column:
    """Closed time range on the raw column, so it reaches the file scan."""
    return F.col(TS).between(ntz(start), ntz(end))


def between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a closed time range; on a table stored by year and month only the months concerned are read."""
    if {"year", "month"} <= set(rows.columns):
        month = F.col("year") * 12 + F.col("month")
        first, last = (int(t[:4]) * 12 + int(t[5:7]) for t in (start, end))
        rows = rows.filter(month.between(first, last))
    return rows.filter(in_range(start, end))


def rank_of(value: Column, order) -> Column:
    out = None
    for i, name in enumerate(order):
        out = F.when(value == name, i) if out is None else out.when(value == name, i)
    return out


# --- dashboard ---------------------------------------------------------------


def time_series(wide: DataFrame, item_code: int, stations, start: str, end: str) -> DataFrame:
    """Rows of the chosen stations: a list of codes (empty keeps nothing) or a table with ``station_code``."""
    rows = between(wide, start, end)
    if isinstance(stations, DataFrame):
        rows = rows.join(stations.select("station_code"), "station_code", "left_semi")
    else:
        rows = rows.filter(in_list(F.col("station_code"), stations))
    return (
        rows.select(
            iso_text(F.col(TS)).alias(TS),
            "station_code",
            F.col(item_column(item_code)).cast("double").alias("value"),
            F.col("instrument_status").cast("int").alias("instrument_status"),
        )
        .orderBy(TS, "station_code")
    )


def stations_latest(wide: DataFrame, item_code: int, start: str, end: str) -> DataFrame:
    """Mean, count and most frequent status per station; stations without rows in range stay.

    Coordinates are the smallest seen; among equally frequent statuses the
    lowest code wins, a missing status comes last.
    """
    value = F.col(item_column(item_code)).cast("double")
    stations = wide.groupBy("station_code").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude")
    )
    # one pass: per (station, status) partial sums serve both the mean and the mode
    by_status = (
        between(wide, start, end)
        .groupBy("station_code", "instrument_status")
        .agg(F.count("*").alias("_rows"), F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    )
    frequent = F.struct(
        (-F.col("_rows")).alias("rows"),
        F.col("instrument_status").isNull().alias("missing"),
        F.col("instrument_status").alias("status"),
    )
    facts = by_status.groupBy("station_code").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n").cast("double")).alias("value"),
        F.sum("_n").alias("record_count"),
        F.min(frequent)["status"].alias("dominant_status"),
    )
    return (
        stations.join(facts, "station_code", "left")
        .select(
            "station_code",
            "latitude",
            "longitude",
            "value",
            F.coalesce("record_count", F.lit(0)).alias("record_count"),
            F.col("dominant_status").cast("int").alias("dominant_status"),
        )
        .orderBy("station_code")
    )


def missing_by_pollutant(wide: DataFrame, start: str, end: str) -> DataFrame:
    """Share of NULL per pollutant from one scan and one aggregate row."""
    labels = {ITEM_COLUMNS[c]: ITEM_LABELS[c] for c in (0, 2, 5, 4, 7, 8)}
    shares = between(wide, start, end).agg(
        *[percent(F.count_if(F.col(c).isNull()), F.count("*")).alias(label) for c, label in labels.items()]
    )
    return shares.unpivot([], [F.col(f"`{name}`") for name in labels.values()], "pollutant", "missing_pct")


def status_availability(wide: DataFrame, start: str, end: str) -> DataFrame:
    """Share of rows that have a status, whatever its code."""
    return (
        between(wide, start, end)
        .groupBy("station_code")
        .agg(percent(F.count("instrument_status"), F.count("*")).alias("availability_pct"))
        .orderBy("availability_pct", "station_code")
    )


def monthly_quality(wide: DataFrame, start: str, end: str) -> DataFrame:
    """Status share and valid share per month; validity looks at SO2 only."""
    return (
        between(wide, start, end)
        .groupBy(year_month(F.col(TS)).alias("month"))
        .agg(
            percent(F.count("instrument_status"), F.count("*")).alias("status_pct"),
            percent(F.count("so2_value"), F.count("*")).alias("valid_pct"),
        )
        .orderBy("month")
    )


def station_stats(wide: DataFrame, item_code: int, start: str, end: str, exact: bool = True) -> DataFrame:
    values = between(wide, start, end).select(
        "station_code", F.col(item_column(item_code)).cast("double").alias("value")
    )
    return station_statistics(values, exact=exact).orderBy("station_code")


def sidebar_columns(wide: DataFrame) -> DataFrame:
    """Date, hour, day name and status label used by the filters."""
    ts = F.col(TS)
    return wide.withColumns(
        {
            "date": F.to_date(ts),
            "day_name": day_name(ts),
            "hour": F.hour(ts),
            "status_label": status_label(F.col("instrument_status")),
        }
    )


def sidebar_filter(
    labelled: DataFrame, first_day: str, last_day: str, hours=(0, 23), statuses=("All",)
) -> DataFrame:
    """Closed day and hour ranges; 'All' or an empty list switches the status filter off."""
    conditions = [F.col("date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))]
    conditions.append(F.col("hour").between(*hours))
    if statuses and "All" not in statuses:
        conditions.append(F.col("status_label").isin(*statuses))
    return labelled.filter(all_of(conditions))


def default_days(wide: DataFrame) -> DataFrame:
    """Last 30 days, clipped to the first day of the data."""
    first, last = F.to_date(F.min(TS)), F.to_date(F.max(TS))
    return wide.agg(F.greatest(first, F.date_sub(last, 30)).alias("first_day"), last.alias("last_day"))


# --- exploration -------------------------------------------------------------


def overview(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("total_rows"),
        F.count_if(usable()).alias("normal_rows"),
        F.min(TS).alias("min_dt"),
        F.max(TS).alias("max_dt"),
        F.count_distinct("station_code").alias("n_stations"),
        F.count_distinct("item_code").alias("n_pollutants"),
    )


def daily_station_means(cleaned: DataFrame, item_code: int = 0) -> DataFrame:
    """Mean over days of the daily mean, per station."""
    return (
        cleaned.filter((F.col("item_code") == item_code) & usable())
        .groupBy("station_code", F.to_date(TS).alias("day"))
        .agg(F.avg("clean_value").alias("daily_avg"))
        .groupBy("station_code")
        .agg(F.avg("daily_avg").alias("station_avg"))
        .orderBy("station_code")
    )


def grand_mean(station_means: DataFrame) -> DataFrame:
    return station_means.agg(F.round(F.avg("station_avg"), 5).alias("grand_avg"))


def season_means(cleaned: DataFrame, station_code: int = 209, item_code: int = 4) -> DataFrame:
    return (
        cleaned.filter((F.col("item_code") == item_code) & (F.col("station_code") == station_code) & usable())
        .groupBy("season")
        .agg(F.round(F.avg("clean_value"), 5).alias("avg_value"))
        .orderBy(rank_of(F.col("season"), SEASON_ORDER))
    )


def hour_spread(cleaned: DataFrame, item_code: int = 5) -> DataFrame:
    value = F.col("clean_value").cast("double")
    return (
        cleaned.filter((F.col("item_code") == item_code) & usable())
        .groupBy("hour")
        .agg(
            F.round(F.stddev_samp(value), 5).alias("std_value"),
            F.round(F.avg(value), 5).alias("avg_value"),
            F.count("*").alias("n"),
        )
        .orderBy("hour")
    )


def peak_hour(spread: DataFrame) -> DataFrame:
    """Hour with the largest std; the earliest hour wins a tie."""
    best = F.max(F.struct(F.col("std_value"), (-F.col("hour")).alias("neg"), F.col("hour")))
    return spread.filter(F.col("std_value").isNotNull()).agg(best.alias("_b")).select(
        F.col("_b.hour").alias("hour"), F.col("_b.std_value").alias("std_value")
    )


def _count_by_station(cleaned: DataFrame, condition: Column, name: str) -> DataFrame:
    return (
        cleaned.filter(condition)
        .groupBy("station_code")
        .agg(F.count("*").alias(name))
        .orderBy(F.desc(name), "station_code")
    )


def abnormal_data_counts(cleaned: DataFrame) -> DataFrame:
    return _count_by_station(cleaned, F.col("instrument_status") == STATUS_ABNORMAL_DATA, "abnormal_data_count")


def not_normal_counts(cleaned: DataFrame) -> DataFrame:
    """Rows with a status other than normal; rows without a status do not count."""
    return _count_by_station(cleaned, F.col("instrument_status") != STATUS_NORMAL, "not_normal_count")


def class_counts(cleaned: DataFrame, item_code: int = 8) -> DataFrame:
    """Rows per air-quality class with the total over all classes."""
    counts = (
        cleaned.filter((F.col("item_code") == item_code) & F.col("air_quality").isNotNull())
        .groupBy("air_quality")
        .agg(F.count("*").alias("cnt"))
    )
    # at most four rows
    return counts.withColumn("total", F.sum("cnt").over(Window.partitionBy())).orderBy(
        rank_of(F.col("air_quality"), AIR_QUALITY)
    )
