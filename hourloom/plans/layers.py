"""The three layers: landing (typed), logic (long, joined, cleaned), presentation (wide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.calendar import season
from hourloom.functions.scalars import air_quality, sentinel_to_null
from hourloom.operators.ordered import spread_over
from hourloom.schemas import ITEM_COLUMNS, MISSING_STATUS, READING_KEY, TS

# fixed values: seed column -> landing column; seed unit typo -> unit
MEASUREMENT_COLUMNS = {
    "SO2": "so2_value",
    "NO2": "no2_value",
    "O3": "o3_value",
    "CO": "co_value",
    "PM10": "pm10_value",
    "PM2_5": "pm2_5_value",
}
UNIT_TYPO = ("Mircrogram/m3", "mg/m3")
LAYERS = {
    "lnd_measurements": "landing",
    "lnd_instrument_data": "landing",
    "lnd_pollutants": "landing",
    "measurements_long": "logic",
    "measurements_with_status": "logic",
    "measurements_clean": "logic",
    "dashboard_wide": "presentation",
}
NUMERIC = "decimal(38,9)"
STATUSES = "_statuses"


def land_measurements(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("measurement_date").cast("timestamp_ntz").alias(TS),
        F.col("station_code").cast("long").alias("station_code"),
        "latitude",
        "longitude",
        *[F.col(c).cast(NUMERIC).alias(name) for c, name in MEASUREMENT_COLUMNS.items()],
    )


def land_instruments(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("measurement_date").cast("timestamp_ntz").alias(TS),
        F.col("station_code").cast("long").alias("station_code"),
        F.col("item_code").cast("long").alias("item_code"),
        F.col("average_value").cast(NUMERIC).alias("average_value"),
        F.col("instrument_status").cast("long").alias("instrument_status"),
    )


def land_pollutants(raw: DataFrame) -> DataFrame:
    wrong, right = UNIT_TYPO
    unit = F.col("unit_of_measurement")
    return raw.select(
        F.col("item_code").cast("long").alias("item_code"),
        F.lower("item_name").alias("item_name"),
        F.when(unit == wrong, right).otherwise(unit).alias("unit_of_measurement"),
        *[F.col(c).cast(NUMERIC).alias(c) for c in ("good", "normal", "bad", "very_bad")],
    )


def to_long(measurements: DataFrame) -> DataFrame:
    """One row per station, hour and pollutant; a single pass over the wide table, whose partitions stay as they are."""
    ids = [TS, "station_code", "latitude", "longitude"]
    kept = [STATUSES] if STATUSES in measurements.columns else []
    listed = F.array(
        *[
            F.struct(F.lit(code).cast("long").alias("item_code"), F.col(name).alias("value"))
            for code, name in ITEM_COLUMNS.items()
        ]
    )
    return measurements.select(*ids, *kept, F.inline(listed))


def with_statuses(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Adds the (item, status) pairs of each row's station-hour, NULL if there are none.

    Whole station-hours are dealt over partitions, so picking a status and grouping by station and hour need no shuffle.
    """
    hour = [TS, "station_code"]
    listed = (
        instruments.select(*READING_KEY, "instrument_status")
        .dropna(subset=list(READING_KEY))
        .repartition(spread_over(instruments), *hour)
        .groupBy(*hour)
        .agg(F.collect_list(F.struct("item_code", "instrument_status")).alias(STATUSES))
    )
    return rows.repartition(spread_over(rows), *hour).join(listed, hour, "left")


def with_status(long: DataFrame, instruments: DataFrame, pollutants: DataFrame) -> DataFrame:
    """1:1 status join on all three keys; leaving out the item would fan out sixfold.

    Rows that already hold the statuses of their station-hour are not joined again.
    """
    rows = long if STATUSES in long.columns else with_statuses(long, instruments)
    names = _per_code(pollutants, "item_name")
    own = F.filter(STATUSES, lambda s: s["item_code"] == F.col("item_code"))
    columns = [TS, "station_code", "latitude", "longitude", "item_code"]
    return (
        rows.select(*columns, "value", F.explode_outer(own).alias("_own"))
        .join(names, "item_code", "left")
        .select(*columns, "item_name", "value", F.col("_own.instrument_status").alias("instrument_status"))
    )


def _per_code(pollutants: DataFrame, *columns: str) -> DataFrame:
    """One row for each of the known codes, so a handful at most: safe to send to every executor."""
    known = pollutants.filter(F.col("item_code").isin(*ITEM_COLUMNS))
    return F.broadcast(known.groupBy("item_code").agg(*[F.max(c).alias(c) for c in columns]))


def clean(joined: DataFrame, pollutants: DataFrame) -> DataFrame:
    """The contract table every analysis reads (18 columns)."""
    limits = _per_code(pollutants, "good", "normal", "bad")
    ts, value = F.col(TS), F.col("value")
    return joined.join(limits, "item_code", "left").select(
        TS,
        "station_code",
        "latitude",
        "longitude",
        "item_code",
        "item_name",
        value.alias("raw_value"),
        sentinel_to_null(value).alias("clean_value"),
        "instrument_status",
        F.coalesce("instrument_status", F.lit(MISSING_STATUS)).alias("status_filled"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
        F.dayofweek(ts).alias("day_of_week"),
        F.dayofyear(ts).alias("day_of_year"),
        season(F.month(ts)).alias("season"),
        air_quality(value, F.col("good"), F.col("normal"), F.col("bad")).alias("air_quality"),
    )


def to_wide(cleaned: DataFrame) -> DataFrame:
    """One row per station and hour with the worst status across pollutants."""
    return cleaned.groupBy(TS, "station_code", "latitude", "longitude").agg(
        *[F.max(F.when(F.col("item_code") == code, F.col("clean_value"))).alias(name) for code, name in ITEM_COLUMNS.items()],
        F.max("instrument_status").alias("instrument_status"),
    )


def build_layers(measurement_data: DataFrame, instrument_data: DataFrame, pollutant_data: DataFrame) -> dict[str, DataFrame]:
    """All layer tables as lazy DataFrames, keyed by table name."""
    measurements = land_measurements(measurement_data)
    instruments = land_instruments(instrument_data)
    pollutants = land_pollutants(pollutant_data)
    long = to_long(measurements)
    # wide rows are shuffled, a sixth of the long ones
    joined = with_status(to_long(with_statuses(measurements, instruments)), instruments, pollutants)
    cleaned = clean(joined, pollutants)
    return {
        "lnd_measurements": measurements,
        "lnd_instrument_data": instruments,
        "lnd_pollutants": pollutants,
        "measurements_long": long,
        "measurements_with_status": joined,
        "measurements_clean": cleaned,
        "dashboard_wide": to_wide(cleaned),
    }


def materialise(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Landing becomes views, the pollutant dimension and the later layers become Parquet.

    Large tables are partitioned by year and month, so that a time range prunes
    files; each written table feeds the next, so no layer is computed twice.
    """
    out: dict[str, DataFrame] = {}
    for name in ("lnd_measurements", "lnd_instrument_data"):
        tables[name].createOrReplaceTempView(name)
        out[name] = tables[name]
    out["lnd_pollutants"] = _write(spark, tables["lnd_pollutants"], f"{root}/landing/lnd_pollutants", [])
    out["measurements_long"] = _write(
        spark, to_long(out["lnd_measurements"]), f"{root}/logic/measurements_long", ["year", "month"]
    )
    out["measurements_with_status"] = _write(
        spark,
        with_status(out["measurements_long"], out["lnd_instrument_data"], out["lnd_pollutants"]),
        f"{root}/logic/measurements_with_status",
        ["year", "month"],
    )
    out["measurements_clean"] = _write(
        spark,
        clean(out["measurements_with_status"], out["lnd_pollutants"]),
        f"{root}/logic/measurements_clean",
        ["year", "month"],
    )
    out["dashboard_wide"] = _write(
        spark, to_wide(out["measurements_clean"]), f"{root}/presentation/dashboard_wide", ["year", "month"]
    )
    for name, table in out.items():
        table.createOrReplaceTempView(name)
    return out


def _write(spark: SparkSession, df: DataFrame, path: str, partitions: list[str]) -> DataFrame:
    columns = [c for c in df.columns if c not in partitions] + partitions
    if partitions:
        df = df.withColumns({"year": F.year(TS), "month": F.month(TS)})
        slot = F.pmod(F.xxhash64("station_code"), F.lit(8))  # a month is written by eight tasks, not by all of them
        df = df.repartition("year", "month", slot)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return spark.read.parquet(path).select(*columns)
