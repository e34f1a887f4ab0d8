"""Schemas, code tables and request defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NTZ = T.TimestampNTZType()
NUMERIC = T.DecimalType(38, 9)

SERIES = ("station_code", "item_code")
TS = "measurement_datetime"
READING_KEY = (TS, "station_code", "item_code")


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- source files -----------------------------------------------------------

MEASUREMENT_DATA = _struct(
    measurement_date=T.StringType(),
    station_code=T.LongType(),
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
    SO2=T.DoubleType(),
    NO2=T.DoubleType(),
    O3=T.DoubleType(),
    CO=T.DoubleType(),
    PM10=T.DoubleType(),
    PM2_5=T.DoubleType(),
)
INSTRUMENT_DATA = _struct(
    measurement_date=T.StringType(),
    station_code=T.LongType(),
    item_code=T.LongType(),
    average_value=T.DoubleType(),
    instrument_status=T.LongType(),
)
POLLUTANT_DATA = _struct(
    item_code=T.LongType(),
    item_name=T.StringType(),
    unit_of_measurement=T.StringType(),
    good=T.DoubleType(),
    normal=T.DoubleType(),
    bad=T.DoubleType(),
    very_bad=T.DoubleType(),
)
FORECAST_ROWS = _struct(
    measurement_datetime=NTZ,
    station_code=T.LongType(),
    item_code=T.LongType(),
    item_name=T.StringType(),
    predicted_value=T.DoubleType(),
    predicted_lower_90=T.DoubleType(),
    predicted_upper_90=T.DoubleType(),
)
ANOMALY_ROWS = _struct(
    measurement_datetime=NTZ,
    station_code=T.LongType(),
    item_code=T.LongType(),
    item_name=T.StringType(),
    is_anomaly=T.IntegerType(),
    anomaly_score=T.DoubleType(),
)

# --- fixed values: codes, labels, thresholds, targets ------------------------

ITEM_NAMES = {0: "so2", 2: "no2", 4: "co", 5: "o3", 7: "pm10", 8: "pm2.5"}
ITEM_COLUMNS = {
    0: "so2_value",
    2: "no2_value",
    4: "co_value",
    5: "o3_value",
    7: "pm10_value",
    8: "pm2_5_value",
}
ITEM_LABELS = {0: "SO₂", 2: "NO₂", 4: "CO", 5: "O₃", 7: "PM10", 8: "PM2.5"}
ITEM_UNITS = {0: "ppm", 2: "ppm", 4: "ppm", 5: "ppm", 7: "mg/m³", 8: "mg/m³"}
HEALTH_THRESHOLDS = {0: 0.02, 2: 0.03, 4: 2.0, 5: 0.03, 7: 30.0, 8: 15.0}

STATUS_CODES = (0, 1, 2, 4, 8, 9)
STATUS_NORMAL = 0
STATUS_ABNORMAL_DATA = 9
MISSING_VALUE = -1
MISSING_STATUS = -1
MISSING_STATUS_LABEL = "Missing Status"
STATUS_LABELS = {
    0: "Normal",
    1: "Need Calibration",
    2: "Abnormal",
    4: "Power cut",
    8: "Under repair",
    9: "Bad Data",
}
STATUS_LABELS_WEB = {
    0: "Normal",
    1: "Calibration",
    2: "Abnormal",
    4: "Power cut",
    8: "Under repair",
    9: "Abnormal data",
}
SEASONS = {"Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11), "Winter": (12, 1, 2)}
AIR_QUALITY = ("Good", "Normal", "Bad", "Very bad")

STATION_CODES = tuple(range(204, 229))
DATA_WINDOW = ("2021-01-01T00:00:00", "2023-12-31T23:00:00")
DEFAULT_RANGE = ("2023-12-01T00:00:00", "2023-12-31T23:00:00")
DEFAULT_STATIONS = (212, 213, 214, 215, 216)
DEFAULT_ITEM = 8

# (station, item, first hour, last hour)
FORECAST_TARGETS = (
    (206, 0, "2023-07-01 00:00:00", "2023-07-31 23:00:00"),
    (211, 2, "2023-08-01 00:00:00", "2023-08-31 23:00:00"),
    (217, 5, "2023-09-01 00:00:00", "2023-09-30 23:00:00"),
    (219, 4, "2023-10-01 00:00:00", "2023-10-31 23:00:00"),
    (225, 7, "2023-11-01 00:00:00", "2023-11-30 23:00:00"),
    (228, 8, "2023-12-01 00:00:00", "2023-12-31 23:00:00"),
)
ANOMALY_TARGETS = (
    (205, 0, "2023-11-01 00:00:00", "2023-11-30 23:00:00"),
    (209, 2, "2023-09-01 00:00:00", "2023-09-30 23:00:00"),
    (223, 5, "2023-07-01 00:00:00", "2023-07-31 23:00:00"),
    (224, 4, "2023-10-01 00:00:00", "2023-10-31 23:00:00"),
    (226, 7, "2023-08-01 00:00:00", "2023-08-31 23:00:00"),
    (227, 8, "2023-12-01 00:00:00", "2023-12-31 23:00:00"),
)

WEATHER_POINTS = (("center", 37.55, 127.00), ("nw", 37.65, 126.90), ("se", 37.47, 127.10))
WEATHER_VARIABLES = (
    "temperature_2m",
    "relative_humidity_2m",
    "pressure_msl",
    "wind_speed_10m",
    "wind_direction_10m",
    "precipitation",
    "cloud_cover",
    "shortwave_radiation",
)
WEATHER_ROWS = T.StructType(
    [T.StructField("time", NTZ)]
    + [T.StructField(v, T.DoubleType()) for v in WEATHER_VARIABLES]
    + [
        T.StructField("point_name", T.StringType()),
        T.StructField("point_lat", T.DoubleType()),
        T.StructField("point_lon", T.DoubleType()),
    ]
)



# --- request parameters ------------------------------------------------------


def item_column(item_code: int) -> str:
    """Value column of the wide table for one pollutant; unknown codes raise."""
    try:
        return ITEM_COLUMNS[item_code]
    except KeyError:
        raise ValueError(f"unknown pollutant code: {item_code}") from None


@dataclass(frozen=True)
class DashboardRequest:
    item_code: int
    stations: tuple[int, ...]
    start: str
    end: str


def _as_number(text) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def dashboard_request(params: dict, stations_allowed=STATION_CODES) -> DashboardRequest:
    """Request defaults and allow-list: unknown values fall back to the defaults.

    ``stations="none"`` asks for no station at all; an unusable list falls back
    to the default stations.
    """
    item = _as_number(params.get("pollutant"))
    item_code = int(item) if item in ITEM_COLUMNS else DEFAULT_ITEM

    wanted = params.get("stations")
    if wanted == "none":
        stations: tuple[int, ...] = ()
    else:
        numbers = [_as_number(s) for s in wanted.split(",")] if wanted else []
        stations = tuple(int(n) for n in numbers if n in stations_allowed) or DEFAULT_STATIONS

    first, last = DEFAULT_RANGE
    start, end = params.get("start"), params.get("end")
    return DashboardRequest(
        item_code,
        stations,
        first if start is None else start,
        last if end is None else end,
    )


def day_range(first_day: str, last_day: str) -> tuple[str, str]:
    """Day range to closed hour range."""
    return f"{first_day}T00:00:00", f"{last_day}T23:00:00"
