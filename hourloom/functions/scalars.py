"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.schemas import (
    ITEM_NAMES,
    MISSING_STATUS_LABEL,
    MISSING_VALUE,
    STATUS_LABELS,
    STATUS_NORMAL,
)


def floor_at(value: Column, low: float) -> Column:
    """Clip from below; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def all_of(conditions) -> Column:
    """Conjunction of any number of predicates; none means true."""
    return reduce(and_, conditions, F.lit(True))


def in_list(value: Column, members) -> Column:
    """IN list that keeps no row when the list is empty."""
    members = list(members)
    return value.isin(*members) if members else F.lit(False)


def sentinel_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(MISSING_VALUE).cast("decimal(38,9)"))


def usable(status="instrument_status", value="clean_value") -> Column:
    """Normal instrument status and a value present."""
    return (F.col(status) == STATUS_NORMAL) & F.col(value).isNotNull()


def abnormal_with_value(status: Column, value: Column) -> Column:
    """Anything but a normal status, NULL status included, with a value."""
    return ~status.eqNullSafe(F.lit(STATUS_NORMAL)) & value.isNotNull()


def _label(code: Column, labels: dict[int, str]) -> Column:
    out = None
    for key, text in labels.items():
        out = F.when(code == key, text) if out is None else out.when(code == key, text)
    return out


def status_label(status: Column, labels=STATUS_LABELS) -> Column:
    return F.coalesce(_label(status, labels), F.lit(MISSING_STATUS_LABEL))


def item_name(item: Column) -> Column:
    return _label(item, ITEM_NAMES)


def air_quality(value: Column, good: Column, normal: Column, bad: Column) -> Column:
    """Class ladder; a NULL value or missing thresholds end in 'Very bad'."""
    return (
        F.when(value == MISSING_VALUE, None)
        .when(value <= good, "Good")
        .when(value <= normal, "Normal")
        .when(value <= bad, "Bad")
        .otherwise("Very bad")
    )


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal column as double."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in df.columns]
    )


def ensure_columns(df: DataFrame, columns, fill: float = 0.0) -> DataFrame:
    """Add missing feature columns as a constant."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(fill) for c in missing}) if missing else df


def round_columns(df: DataFrame, digits: int = 6, columns=None) -> DataFrame:
    """Round the double columns (all of them by default)."""
    kinds = dict(df.dtypes)
    chosen = set(columns if columns is not None else [c for c in df.columns if kinds[c] == "double"])
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])
