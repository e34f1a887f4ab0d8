"""Writers for snapshots and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalars import decimals_to_double, item_name
from hourloom.schemas import ANOMALY_ROWS, FORECAST_ROWS, ITEM_COLUMNS, TS

SNAPSHOT_COLUMNS = [TS, "station_code", "latitude", "longitude", *ITEM_COLUMNS.values(), "instrument_status"]


def write_snapshot(wide: DataFrame, path: str) -> int:
    """Sorted zstd Parquet with doubles; returns the row count read back."""
    ordered = decimals_to_double(wide.select(*SNAPSHOT_COLUMNS)).sort(TS, "station_code")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return wide.sparkSession.read.parquet(path).count()


def forecast_rows(predictions: DataFrame) -> DataFrame:
    """Seven export columns from ensemble, q05 and q95."""
    return predictions.select(
        TS,
        F.col("station_code").cast("long").alias("station_code"),
        F.col("item_code").cast("long").alias("item_code"),
        item_name(F.col("item_code")).alias("item_name"),
        F.col("ensemble").alias("predicted_value"),
        F.col("q05").alias("predicted_lower_90"),
        F.col("q95").alias("predicted_upper_90"),
    )


def anomaly_rows(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Six export columns, score rounded to 5 digits."""
    return scored.select(
        TS,
        F.col("station_code").cast("long").alias("station_code"),
        F.col("item_code").cast("long").alias("item_code"),
        item_name(F.col("item_code")).alias("item_name"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.round(score, 5).alias("anomaly_score"),
    )


def write_predictions(rows: DataFrame, path: str) -> None:
    """CSV with header; all targets are already rows of one DataFrame."""
    known = ({f.name for f in FORECAST_ROWS}, {f.name for f in ANOMALY_ROWS})
    if set(rows.columns) not in known:
        raise ValueError("neither forecast nor anomaly columns")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_weather_cache(weather: DataFrame, path: str) -> None:
    weather.write.mode("overwrite").option("header", True).csv(path)
