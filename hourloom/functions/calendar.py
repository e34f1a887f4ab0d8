"""Calendar, cyclical and Fourier columns.

Hour arithmetic casts ``timestamp_ntz`` through the session time zone, which
must be UTC (see ``hourloom.sources.readers.session``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.schemas import SEASONS

# fixed values: Fourier period in hours and number of harmonics
FOURIER = {"daily": (24, 4), "weekly": (168, 3), "yearly": (8766, 5)}

FOURIER_COLUMNS = [
    f"four_{name}_{wave}_{k}"
    for name, (_, terms) in FOURIER.items()
    for k in range(1, terms + 1)
    for wave in ("sin", "cos")
]
CALENDAR_COLUMNS = ["hour", "day_of_week", "month", "day_of_year", "is_weekend"]
CYCLICAL_COLUMNS = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]


def ntz(text: str) -> Column:
    """Timestamp literal without zone."""
    return F.lit(text).cast("timestamp_ntz")


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970-01-01 as a long."""
    return F.timestamp_diff("HOUR", ntz("1970-01-01 00:00:00"), ts)


def hour_to_ts(index: Column) -> Column:
    """Inverse of :func:`hour_index`."""
    return F.timestamp_add("HOUR", index.cast("int"), ntz("1970-01-01 00:00:00"))


def add_hours(ts: Column, hours) -> Column:
    amount = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_add("HOUR", amount.cast("int"), ts)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end as a double, fractions kept."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(3600.0)


def last_month_start(last: Column) -> Column:
    """First hour of the one-month holdout that ends at ``last``."""
    return last - F.expr("INTERVAL 1 MONTH") + F.expr("INTERVAL 1 HOUR")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def season(month: Column) -> Column:
    out = None
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name) if out is None else out.when(month.isin(*months), name)
    return out


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, Monday-based weekday, month, day of year and weekend flag."""
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "month": F.month(ts),
        "day_of_year": F.dayofyear(ts),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def cyclical(ts: Column) -> dict[str, Column]:
    turns = {
        "hour": F.hour(ts) / F.lit(24.0),
        "dow": F.weekday(ts) / F.lit(7.0),
        "month": F.month(ts) / F.lit(12.0),
    }
    out = {}
    for name, turn in turns.items():
        out[f"{name}_sin"] = F.sin(turn * (2 * math.pi))
        out[f"{name}_cos"] = F.cos(turn * (2 * math.pi))
    return out


def fourier(ts: Column, epoch: Column) -> dict[str, Column]:
    """24 sine and cosine terms of the hours since ``epoch``."""
    t = hours_between(epoch, ts)
    out = {}
    for name, (period, terms) in FOURIER.items():
        for k in range(1, terms + 1):
            angle = t * F.lit(2 * math.pi * k / period)
            out[f"four_{name}_sin_{k}"] = F.sin(angle)
            out[f"four_{name}_cos_{k}"] = F.cos(angle)
    return out


def unit_calendar(ts: Column) -> dict[str, Column]:
    """Calendar parts scaled to [0, 1]."""
    return {
        "hour": F.hour(ts) / F.lit(23.0),
        "dow": F.weekday(ts) / F.lit(6.0),
        "month": (F.month(ts) - 1) / F.lit(11.0),
        "day_of_year": (F.dayofyear(ts) - 1) / F.lit(365.0),
    }
