"""Sessions and readers."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.calendar import ntz
from hourloom.functions.scalars import all_of, decimals_to_double, in_list
from hourloom.schemas import (
    ANOMALY_ROWS,
    FORECAST_ROWS,
    INSTRUMENT_DATA,
    ITEM_COLUMNS,
    MEASUREMENT_DATA,
    POLLUTANT_DATA,
    STATUS_NORMAL,
    TS,
    WEATHER_ROWS,
    WEATHER_VARIABLES,
)


def session(name: str = "hourloom", **conf) -> SparkSession:
    """Session with the settings the library relies on; cluster settings win."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# --- source files ------------------------------------------------------------


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT_DATA).option("header", True).csv(path)


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTRUMENT_DATA).option("header", True).csv(path)


def read_pollutants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLLUTANT_DATA).option("header", True).csv(path)


def _predictions(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """CSV with header; a bad row fails the job, a missing file gives None."""
    try:
        return spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_forecasts(spark: SparkSession, path: str) -> DataFrame | None:
    return _predictions(spark, path, FORECAST_ROWS)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame | None:
    return _predictions(spark, path, ANOMALY_ROWS)


# --- warehouse ---------------------------------------------------------------


def query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL to DataFrame with NUMERIC columns as double."""
    return decimals_to_double(spark.sql(sql, args=args or {}))


def dashboard_wide(spark: SparkSession, location: str, backend: str = "parquet") -> DataFrame:
    """The wide presentation table from a Parquet snapshot or a catalog table.

    The Parquet branch also registers the view ``dashboard_wide``.
    """
    if backend == "parquet":
        df = spark.read.parquet(location)
        df.createOrReplaceTempView("dashboard_wide")
        return df
    if backend == "table":
        columns = [TS, "station_code", "latitude", "longitude", *ITEM_COLUMNS.values(), "instrument_status"]
        return decimals_to_double(spark.table(location).select(*columns)).orderBy(TS, "station_code")
    raise ValueError(f"unknown backend: {backend}")


def series_rows(
    cleaned: DataFrame,
    station_code: int | None = None,
    item_code: int | None = None,
    statuses=(STATUS_NORMAL,),
    before: str | None = None,
    with_value: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Readings of one series, station or pollutant, or of all.

    ``statuses=None`` keeps every status, NULL included; an empty list keeps no row.  ``before`` is exclusive.
    Sorting is left to the caller unless asked for.
    """
    conditions = []
    if station_code is not None:
        conditions.append(F.col("station_code") == station_code)
    if item_code is not None:
        conditions.append(F.col("item_code") == item_code)
    if statuses is not None:
        conditions.append(in_list(F.col("instrument_status"), statuses))
    if with_value:
        conditions.append(F.col("clean_value").isNotNull())
    if before:
        conditions.append(F.col(TS) < ntz(before))
    rows = decimals_to_double(cleaned.filter(all_of(conditions)))
    return rows.orderBy("station_code", "item_code", TS) if ordered else rows


# --- weather -----------------------------------------------------------------


def read_weather_json(spark: SparkSession, path: str, point: tuple[str, float, float]) -> DataFrame:
    """Landed weather responses (one array per variable) of one point as hourly rows."""
    arrays = ", ".join(["time array<string>"] + [f"{v} array<double>" for v in WEATHER_VARIABLES])
    raw = spark.read.schema(f"hourly struct<{arrays.replace(' array', ': array')}>").option("multiLine", True).json(path)
    fields = ["time", *WEATHER_VARIABLES]
    zipped = raw.select(F.inline(F.arrays_zip(*[F.col(f"hourly.{f}").alias(f) for f in fields])))
    name, lat, lon = point
    return zipped.select(
        F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("time"),
        *WEATHER_VARIABLES,
        F.lit(name).alias("point_name"),
        F.lit(lat).alias("point_lat"),
        F.lit(lon).alias("point_lon"),
    )


def read_weather(spark: SparkSession, folders: dict[tuple[str, float, float], str]) -> DataFrame:
    """Union over the points; a folder may hold any number of yearly files."""
    out = None
    for point, path in folders.items():
        rows = read_weather_json(spark, path, point)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no weather folders given")
    return out


def read_weather_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_ROWS).option("header", True).csv(path)


def hadoop_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the session's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; a missing folder has none."""
    if not hadoop_exists(spark, path):
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)
    return sorted(os.path.basename(e.getPath().toString().rstrip("/")) for e in entries)


