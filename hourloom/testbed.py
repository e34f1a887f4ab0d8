"""Sensor tables derived from the driver's relational tables.

Only integer arithmetic decides keys and values, so the same rules hold in any
SQL engine.  Suppliers play stations, shipping days play hours (one day is one
hour from 2021-01-20 on), line numbers play pollutants.  The number of stations
and readings grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.calendar import hour_index
from hourloom.operators.ordered import spread_over
from hourloom.schemas import ITEM_COLUMNS, TS, WEATHER_POINTS, WEATHER_VARIABLES

# fixed values
FIRST_DAY = "1995-01-01 00:00:00"
FIRST_HOUR = "2021-01-20 00:00:00"
SEED_COLUMNS = {0: "SO2", 2: "NO2", 5: "O3", 4: "CO", 7: "PM10", 8: "PM2_5"}
POLLUTANTS = [
    (0, "SO2", "ppm", 10.0, 20.0, 35.0, 50.0),
    (2, "NO2", "ppm", 12.0, 24.0, 36.0, 50.0),
    (4, "CO", "ppm", 5.0, 15.0, 40.0, 50.0),
    (5, "O3", "ppm", 10.0, 25.0, 45.0, 50.0),
    (7, "PM10", "Mircrogram/m3", 8.0, 16.0, 32.0, 50.0),
    (8, "PM2.5", "Mircrogram/m3", 15.0, 35.0, 45.0, 50.0),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hour_of(day: str):
    return F.expr(
        f"timestampadd(HOUR, datediff({day}, timestamp_ntz'{FIRST_DAY}'), timestamp_ntz'{FIRST_HOUR}')"
    )


def latitude(station="station_code"):
    return F.lit(37.4) + (F.col(station) * 37 % 1009) / F.lit(5000.0)


def longitude(station="station_code"):
    return F.lit(126.8) + (F.col(station) * 101 % 1013) / F.lit(5000.0)


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One reading per (hour, station, item), from all its lines.

    Columns: key, ``raw`` (double, the sum of the quantities, -1 for missing), ``status`` (NULL without an
    instrument row), ``order`` (sum of the order keys), ``n`` (number of lines) and coordinates.
    """
    line = table(spark, folder, "lineitem")
    item = F.element_at(F.array(*[F.lit(c) for c in ITEM_COLUMNS]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    sums = line.groupBy(
        _hour_of("l_shipdate").alias(TS),
        (F.col("l_suppkey") + 204).alias("station_code"),
        item.cast("long").alias("item_code"),
    ).agg(
        F.sum("l_orderkey").alias("order"),
        F.sum("l_linenumber").cast("long").alias("_number"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("_total"),
        F.count(F.lit(1)).alias("n"),
    )
    turn = (F.col("order") * 3 + F.col("_number")) % 20
    return sums.select(
        TS,
        "station_code",
        "item_code",
        "order",
        F.when((F.col("order") + F.col("_number")) % 17 == 0, -1.0).otherwise(F.col("_total")).alias("raw"),
        F.when(turn == 0, 9).when(turn == 1, 4).when(turn == 2, 8).when(turn == 3, 1).when(turn == 4, None)
        .otherwise(0).cast("long").alias("status"),
        "n",
        latitude().alias("latitude"),
        longitude().alias("longitude"),
    )


def measurement_data(spark: SparkSession, folder: str) -> DataFrame:
    """Wide seed table; an absent pollutant is -1 in two of three station-hours, else NULL."""
    rows = readings(spark, folder)
    absent = F.when((hour_index(F.col(TS)) + F.col("station_code")) % 3 != 0, -1.0)
    wide = rows.groupBy(TS, "station_code", "latitude", "longitude").agg(
        *[F.max(F.when(F.col("item_code") == code, F.col("raw"))).alias(name) for code, name in SEED_COLUMNS.items()]
    )
    return wide.select(
        F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("measurement_date"),
        "station_code",
        "latitude",
        "longitude",
        *[F.coalesce(name, absent).alias(name) for name in SEED_COLUMNS.values()],
    )


def instrument_data(spark: SparkSession, folder: str) -> DataFrame:
    """Instrument rows where a status exists; every 23rd order disagrees by 1."""
    rows = readings(spark, folder).filter(F.col("status").isNotNull())
    return rows.select(
        F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("measurement_date"),
        "station_code",
        "item_code",
        (F.col("raw") + F.when(F.col("order") % 23 == 0, 1.0).otherwise(0.0)).alias("average_value"),
        F.col("status").alias("instrument_status"),
    )


def pollutant_data(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        POLLUTANTS,
        "item_code long, item_name string, unit_of_measurement string, "
        "good double, normal double, bad double, very_bad double",
    )


def layers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from hourloom.plans.layers import build_layers

    return build_layers(
        measurement_data(spark, folder), instrument_data(spark, folder), pollutant_data(spark)
    )


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in the shape of the contract table, without the absent pollutants."""
    return readings(spark, folder).select(
        TS,
        "station_code",
        "item_code",
        "latitude",
        "longitude",
        F.nullif(F.col("raw"), F.lit(-1.0)).alias("clean_value"),
        F.col("status").alias("instrument_status"),
    )


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """The presentation table straight from the readings."""
    from hourloom.plans.layers import to_wide

    return to_wide(cleaned(spark, folder))


def network(spark: SparkSession, folder: str) -> DataFrame:
    """One series per station: units shipped per hour, pollutant by station.

    Hours without shipment are gaps; a total that is a multiple of 13 is a missing value.
    """
    line = table(spark, folder, "lineitem")
    station = F.col("l_suppkey") + 204
    item = F.element_at(F.array(*[F.lit(c) for c in ITEM_COLUMNS]), (station % 6 + 1).cast("int")).cast("long")
    total = F.sum("l_quantity")
    lines = line.select(
        _hour_of("l_shipdate").alias(TS), station.alias("station_code"), item.alias("item_code"), "l_quantity"
    )
    # few lines share an hour, so sums before the shuffle would only fill memory
    dealt = lines.repartition(spread_over(lines), TS, "station_code", "item_code")
    return dealt.groupBy(TS, "station_code", "item_code").agg(F.when(total % 13 != 0, total).alias("clean_value"))


def network_stations(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.select((F.col("l_suppkey") + 204).alias("station_code")).distinct().select(
        "station_code", latitude().alias("latitude"), longitude().alias("longitude")
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scored hours per user: score from the sum of the event values, label if one is an error, flag if one is high."""
    events = table(spark, folder, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    hours = events.groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias(TS), (F.col("user_id") + 204).alias("station_code")
    ).agg(
        F.sum(cents).alias("cents"),
        F.max((F.col("event_type") == "error").cast("int")).alias("label"),
        F.max((F.col("value") > 30).cast("int")).alias("flag"),
    )
    return hours.select(
        TS,
        "station_code",
        F.element_at(F.array(*[F.lit(c) for c in ITEM_COLUMNS]), (F.col("station_code") % 6 + 1).cast("int"))
        .cast("long").alias("item_code"),
        (F.col("cents") / 65536).alias("score"),
        "label",
        "flag",
    )


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Actual and predicted values per station, item and line."""
    line = table(spark, folder, "lineitem")
    item = F.element_at(F.array(*[F.lit(c) for c in ITEM_COLUMNS]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    y = F.col("l_quantity") - 1
    return line.select(
        (F.col("l_suppkey") + 204).alias("station_code"),
        item.cast("long").alias("item_code"),
        _hour_of("l_shipdate").alias(TS),
        (F.col("l_orderkey") % 3).cast("int").alias("fold"),
        y.alias("y_true"),
        (y * (1 + F.col("l_discount")) + F.col("l_tax") * 10).alias("lgbm"),
        (y * (1 - F.col("l_tax")) - F.col("l_discount") * 10).alias("ridge"),
        (y + F.col("l_discount") * 50 - F.col("l_tax") * 50).alias("naive"),
        (y - F.col("l_discount") * 40 + 1).alias("q05"),
        (y + F.col("l_tax") * 60 - 1).alias("q95"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly weather of the fixed points from order prices; some values are missing."""
    orders = table(spark, folder, "orders")
    point = (F.col("o_custkey") % 3).cast("int")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = orders.groupBy(_hour_of("o_orderdate").alias("time"), point.alias("_p")).agg(F.sum(cents).alias("_c"))
    names, lats, lons = zip(*WEATHER_POINTS)

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_p") + 1)

    return rows.select(
        "time",
        *[
            F.when((F.col("_c") + i) % 11 != 0, (F.col("_c") % (1000 + 7 * i)) / F.lit(10.0)).alias(v)
            for i, v in enumerate(WEATHER_VARIABLES)
        ],
        pick(names).alias("point_name"),
        pick(lats).alias("point_lat"),
        pick(lons).alias("point_lon"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the shape of an exported forecast."""
    from hourloom.functions.scalars import item_name

    return readings(spark, folder).select(
        TS,
        "station_code",
        "item_code",
        item_name(F.col("item_code")).alias("item_name"),
        F.col("raw").alias("predicted_value"),
        (F.col("raw") - F.col("order") % 7).alias("predicted_lower_90"),
        (F.col("raw") + F.col("order") % 5).alias("predicted_upper_90"),
    )


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the shape of an exported anomaly table."""
    from hourloom.functions.scalars import item_name

    return scored(spark, folder).select(
        TS,
        "station_code",
        "item_code",
        item_name(F.col("item_code")).alias("item_name"),
        F.col("flag").alias("is_anomaly"),
        F.col("score").alias("anomaly_score"),
    )
