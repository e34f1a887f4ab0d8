"""Reference SQL (DuckDB) for the registered queries."""

from __future__ import annotations

LAT = "CAST(37.4 AS DOUBLE) + ({0} * 37 % 1009) / CAST(5000 AS DOUBLE)"
LON = "CAST(126.8 AS DOUBLE) + ({0} * 101 % 1013) / CAST(5000 AS DOUBLE)"
ITEMS = "CAST([0, 2, 4, 5, 7, 8][CAST({0} % 6 AS INTEGER) + 1] AS BIGINT)"
HOUR = "TIMESTAMP '2021-01-20 00:00:00' + to_hours(CAST(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', {0}) AS BIGINT))"
COLUMNS = {0: "so2_value", 2: "no2_value", 4: "co_value", 5: "o3_value", 7: "pm10_value", 8: "pm2_5_value"}
NAMES = {0: "so2", 2: "no2", 4: "co", 5: "o3", 7: "pm10", 8: "pm2.5"}
NAME_CASE = "CASE item_code " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in NAMES.items()) + " END"
WEATHER = [
    "temperature_2m",
    "relative_humidity_2m",
    "pressure_msl",
    "wind_speed_10m",
    "wind_direction_10m",
    "precipitation",
    "cloud_cover",
    "shortwave_radiation",
]

BASE: dict[str, str] = {}

BASE["line_sums"] = f"""
SELECT {HOUR.format('l_shipdate')} AS measurement_datetime, l_suppkey + 204 AS station_code,
  {ITEMS.format('l_linenumber')} AS item_code, CAST(sum(l_orderkey) AS BIGINT) AS ord, CAST(sum(l_linenumber) AS BIGINT) AS num,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n
FROM lineitem GROUP BY ALL"""
BASE["readings"] = f"""
SELECT measurement_datetime, station_code, item_code, ord, n,
  CASE WHEN (ord + num) % 17 = 0 THEN -1.0 ELSE total END::DOUBLE AS raw,
  CAST(CASE (ord * 3 + num) % 20 WHEN 0 THEN 9 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN NULL ELSE 0 END AS BIGINT) AS status,
  {LAT.format('station_code')} AS latitude, {LON.format('station_code')} AS longitude
FROM line_sums"""
BASE["lnd_measurements"] = (
    "SELECT measurement_datetime, station_code, latitude, longitude, "
    + ", ".join(
        f"""coalesce(max(CASE WHEN item_code = {c} THEN raw END),
  CASE WHEN (epoch(measurement_datetime)::BIGINT // 3600 + station_code) % 3 <> 0 THEN -1.0 END) AS {n}"""
        for c, n in COLUMNS.items()
    )
    + " FROM readings GROUP BY measurement_datetime, station_code, latitude, longitude"
)
BASE["lnd_instrument_data"] = """
SELECT measurement_datetime, station_code, item_code,
  raw + CASE WHEN ord % 23 = 0 THEN 1.0 ELSE 0.0 END AS average_value, status AS instrument_status
FROM readings WHERE status IS NOT NULL"""
BASE["lnd_pollutants"] = """
SELECT * FROM (VALUES (0, 'so2', 'ppm', 10, 20, 35, 50), (2, 'no2', 'ppm', 12, 24, 36, 50), (4, 'co', 'ppm', 5, 15, 40, 50),
  (5, 'o3', 'ppm', 10, 25, 45, 50), (7, 'pm10', 'mg/m3', 8, 16, 32, 50), (8, 'pm2.5', 'mg/m3', 15, 35, 45, 50))
  t(item_code, item_name, unit_of_measurement, good, normal, bad, very_bad)"""
BASE["measurements_long"] = " UNION ALL ".join(
    f"SELECT measurement_datetime, station_code, latitude, longitude, {c}::BIGINT AS item_code, {n} AS value FROM lnd_measurements"
    for c, n in COLUMNS.items()
)
BASE["measurements_with_status"] = """
SELECT m.*, p.item_name, i.instrument_status FROM measurements_long m
LEFT JOIN lnd_instrument_data i USING (measurement_datetime, station_code, item_code)
LEFT JOIN lnd_pollutants p USING (item_code)"""
BASE["measurements_clean"] = """
SELECT m.measurement_datetime, m.station_code, m.latitude, m.longitude, m.item_code, m.item_name, m.value AS raw_value,
  CASE WHEN m.value = -1 THEN NULL ELSE m.value END AS clean_value, m.instrument_status,
  coalesce(m.instrument_status, -1) AS status_filled,
  year(measurement_datetime)::INTEGER AS year, month(measurement_datetime)::INTEGER AS month,
  day(measurement_datetime)::INTEGER AS day, hour(measurement_datetime)::INTEGER AS hour,
  (dayofweek(measurement_datetime) + 1)::INTEGER AS day_of_week, dayofyear(measurement_datetime)::INTEGER AS day_of_year,
  CASE WHEN month(measurement_datetime) IN (12, 1, 2) THEN 'Winter' WHEN month(measurement_datetime) IN (3, 4, 5) THEN 'Spring'
    WHEN month(measurement_datetime) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
  CASE WHEN m.value = -1 THEN NULL WHEN m.value <= p.good THEN 'Good' WHEN m.value <= p.normal THEN 'Normal'
    WHEN m.value <= p.bad THEN 'Bad' ELSE 'Very bad' END AS air_quality
FROM measurements_with_status m LEFT JOIN lnd_pollutants p USING (item_code)"""
BASE["cleaned"] = """
SELECT measurement_datetime, station_code, item_code, latitude, longitude, nullif(raw, -1.0) AS clean_value,
  status AS instrument_status FROM readings"""
BASE["dashboard_wide"] = (
    "SELECT measurement_datetime, station_code, latitude, longitude, "
    + ", ".join(f"max(CASE WHEN item_code = {c} THEN clean_value END) AS {n}" for c, n in COLUMNS.items())
    + ", max(instrument_status) AS instrument_status FROM cleaned GROUP BY ALL"
)
BASE["usable"] = "SELECT * FROM cleaned WHERE instrument_status = 0 AND clean_value IS NOT NULL"
BASE["network"] = f"""
SELECT measurement_datetime, station_code, item_code, CASE WHEN total % 13 <> 0 THEN total END AS clean_value FROM (
  SELECT {HOUR.format('l_shipdate')} AS measurement_datetime, l_suppkey + 204 AS station_code,
    {ITEMS.format('(l_suppkey + 204)')} AS item_code, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)"""
BASE["stations"] = f"""
SELECT station_code, {LAT.format('station_code')} AS latitude, {LON.format('station_code')} AS longitude
FROM (SELECT DISTINCT l_suppkey + 204 AS station_code FROM lineitem)"""
BASE["spine"] = """
SELECT station_code, item_code, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS measurement_datetime
FROM (SELECT station_code, item_code, min(measurement_datetime) AS lo, max(measurement_datetime) AS hi FROM network GROUP BY ALL)"""
BASE["filled"] = """
SELECT station_code, item_code, measurement_datetime, coalesce(
  last_value(clean_value IGNORE NULLS) OVER (PARTITION BY station_code, item_code ORDER BY measurement_datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(clean_value IGNORE NULLS) OVER (PARTITION BY station_code, item_code ORDER BY measurement_datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS clean_value
FROM spine LEFT JOIN network USING (station_code, item_code, measurement_datetime)"""
BASE["scored"] = f"""
SELECT measurement_datetime, station_code, {ITEMS.format('station_code')} AS item_code, cents / CAST(65536 AS DOUBLE) AS score, label, flag FROM (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS measurement_datetime, user_id + 204 AS station_code,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(CAST(event_type = 'error' AS INTEGER)) AS label,
    max(CAST(value > 30 AS INTEGER)) AS flag FROM events GROUP BY ALL)"""
BASE["forecasts"] = f"""
SELECT l_suppkey + 204 AS station_code, {ITEMS.format('l_linenumber')} AS item_code, {HOUR.format('l_shipdate')} AS measurement_datetime,
  CAST(l_orderkey % 3 AS INTEGER) AS fold, l_quantity - 1 AS y_true,
  (l_quantity - 1) * (1 + l_discount) + l_tax * 10 AS lgbm, (l_quantity - 1) * (1 - l_tax) - l_discount * 10 AS ridge,
  (l_quantity - 1) + l_discount * 50 - l_tax * 50 AS naive, (l_quantity - 1) - l_discount * 40 + 1 AS q05,
  (l_quantity - 1) + l_tax * 60 - 1 AS q95 FROM lineitem"""
BASE["weather"] = (
    f"""SELECT time, ['center', 'nw', 'se'][p + 1] AS point_name, CAST([37.55, 37.65, 37.47][p + 1] AS DOUBLE) AS point_lat,
  CAST([127.0, 126.9, 127.1][p + 1] AS DOUBLE) AS point_lon, """
    + ", ".join(f"CASE WHEN (c + {i}) % 11 <> 0 THEN (c % {1000 + 7 * i}) / CAST(10 AS DOUBLE) END AS {v}" for i, v in enumerate(WEATHER))
    + f""" FROM (SELECT {HOUR.format('o_orderdate')} AS time, CAST(o_custkey % 3 AS INTEGER) AS p,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY ALL)"""
)
BASE["predictions"] = f"""
SELECT measurement_datetime, station_code, item_code, {NAME_CASE} AS item_name, raw AS predicted_value,
  raw - ord % 7 AS predicted_lower_90, raw + ord % 5 AS predicted_upper_90 FROM readings"""
BASE["anomalies"] = f"""
SELECT measurement_datetime, station_code, item_code, {NAME_CASE} AS item_name, flag AS is_anomaly, score AS anomaly_score FROM scored"""
BASE["knn"] = """
SELECT *, w / sum(w) OVER (PARTITION BY station_code) AS weight FROM (
  SELECT *, 1.0 / pow(greatest(distance, 1e-6), 2.0) AS w FROM (
    SELECT a.station_code, b.station_code AS neighbor_code,
      sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude)) AS distance,
      row_number() OVER (PARTITION BY a.station_code ORDER BY distance, b.station_code) AS neighbor_rank
    FROM stations a JOIN stations b ON a.station_code <> b.station_code) WHERE neighbor_rank <= 5)"""


def with_base(select: str, **extra: str) -> str:
    ctes = {**BASE, **extra}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + "\n" + select


SQL: dict[str, str] = {}


def oracle(name: str, select: str, **extra: str) -> None:
    SQL[name] = with_base(select, **extra)


RANGE = "measurement_datetime BETWEEN TIMESTAMP '2021-02-01 00:00:00' AND TIMESTAMP '2021-04-15 23:00:00'"
SERIES_W = "PARTITION BY station_code, item_code ORDER BY measurement_datetime"


def share(part: str, whole: str = "count(*)") -> str:
    return f"round({part} / CAST(nullif({whole}, 0) AS DOUBLE) * 100, 6)"


# --- layers ------------------------------------------------------------------

oracle("landing_pollutants", "SELECT item_code::BIGINT AS item_code, item_name, unit_of_measurement, good::DOUBLE AS good, normal::DOUBLE AS normal, bad::DOUBLE AS bad, very_bad::DOUBLE AS very_bad, n_readings FROM lnd_pollutants LEFT JOIN (SELECT item_code, CAST(sum(n) AS BIGINT) AS n_readings FROM readings GROUP BY ALL) USING (item_code)")
oracle("unpivot_long", "SELECT measurement_datetime, station_code, latitude, longitude, item_code, value FROM measurements_long")
oracle("join_status", "SELECT measurement_datetime, station_code, latitude, longitude, item_code, item_name, value, instrument_status FROM measurements_with_status")
oracle("clean_contract", "SELECT * FROM measurements_clean")
oracle(
    "pivot_wide",
    "SELECT measurement_datetime, station_code, latitude, longitude, "
    + ", ".join(f"max(CASE WHEN item_code = {c} THEN clean_value END) AS {n}" for c, n in COLUMNS.items())
    + ", max(instrument_status) AS instrument_status FROM measurements_clean GROUP BY measurement_datetime, station_code, latitude, longitude",
)

# --- quality -----------------------------------------------------------------

DIFFERS = " OR ".join(f"(i.{n} IS NOT NULL AND coalesce(m.{n}, 0) <> coalesce(i.{n}, 0))" for n in COLUMNS.values())
PIVOTED = (
    "SELECT measurement_datetime, station_code, instrument_status, "
    + ", ".join(f"sum(CASE WHEN item_code = {c} THEN average_value END) AS {n}" for c, n in COLUMNS.items())
    + " FROM lnd_instrument_data GROUP BY ALL"
)
DISAGREE = (
    "SELECT coalesce(m.measurement_datetime, i.measurement_datetime) AS measurement_datetime, coalesce(m.station_code, i.station_code) AS station_code, i.instrument_status, "
    + ", ".join(f"m.{n} AS {n}_meas, i.{n} AS {n}_instr" for n in COLUMNS.values())
    + f" FROM lnd_measurements m FULL JOIN pivoted i ON m.station_code = i.station_code AND m.measurement_datetime = i.measurement_datetime WHERE {DIFFERS}"
)
oracle("consistency_check", DISAGREE, pivoted=PIVOTED)
oracle("dq_not_null", "SELECT measurement_datetime, station_code, item_code FROM measurements_long WHERE value IS NULL")
oracle("dq_unique_combo", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
oracle("dq_accepted", "SELECT measurement_datetime, station_code, item_code, instrument_status FROM measurements_with_status WHERE instrument_status IS NOT NULL AND instrument_status NOT IN (0, 1, 2, 9)")
oracle("dq_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
oracle("dq_fan_out", "SELECT measurement_datetime, station_code, item_code FROM measurements_long SEMI JOIN (SELECT measurement_datetime, station_code FROM lnd_instrument_data GROUP BY ALL HAVING count(*) > 1) USING (measurement_datetime, station_code)")


def _zero(check: str, table: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", 0::BIGINT AS failures"


_CHECKS = [_zero(f"not_null:{c}", "lnd_pollutants") for c in ("item_code", "item_name", "unit_of_measurement", "good", "normal", "bad", "very_bad")]
_CHECKS += [_zero("unique:item_code", "lnd_pollutants")]
_KEY = ("measurement_datetime", "station_code", "item_code")
_CHECKS += [
    f"SELECT 'not_null:{c}', 'lnd_measurements', count(*) FILTER ({c} IS NULL) FROM lnd_measurements"
    for c in ("measurement_datetime", "station_code", "latitude", "longitude")
]
_CHECKS += [
    f"SELECT 'not_null:{c}', '{t}', count(*) FILTER ({c} IS NULL) FROM {t}"
    for t, cols in (
        ("lnd_instrument_data", (*_KEY, "instrument_status")),
        ("measurements_long", (*_KEY, "value")),
        ("measurements_with_status", _KEY),
        ("measurements_clean", _KEY),
        ("dashboard_wide", _KEY[:2]),
    )
    for c in cols
]
_CHECKS += [
    f"SELECT 'unique:{'+'.join(k)}', '{t}', count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
    for t, k in (
        ("lnd_measurements", _KEY[:2]),
        ("lnd_instrument_data", _KEY),
        ("measurements_long", _KEY),
        ("measurements_with_status", _KEY),
        ("measurements_clean", _KEY),
        ("dashboard_wide", _KEY[:2]),
    )
]
_CHECKS += [
    "SELECT 'relationship:station_code', 'lnd_measurements', count(*) FROM lnd_measurements WHERE station_code NOT IN (SELECT station_code FROM lnd_instrument_data)",
    "SELECT 'accepted:item_code', 'lnd_instrument_data', count(*) FILTER (item_code NOT IN (0, 2, 4, 5, 7, 8)) FROM lnd_instrument_data",
    "SELECT 'accepted:instrument_status', 'lnd_instrument_data', count(*) FILTER (instrument_status NOT IN (0, 1, 2, 4, 8, 9)) FROM lnd_instrument_data",
    f"SELECT 'agreement', 'lnd_measurements', count(*) FROM ({DISAGREE})",
    "SELECT 'fan_out:status', 'measurements_long', count(*) FROM measurements_long SEMI JOIN (SELECT measurement_datetime, station_code, item_code FROM lnd_instrument_data GROUP BY ALL HAVING count(*) > 1) USING (measurement_datetime, station_code, item_code)",
    "SELECT 'accepted:item_code', 'measurements_long', count(*) FILTER (item_code NOT IN (0, 2, 4, 5, 7, 8)) FROM measurements_long",
    "SELECT 'accepted:air_quality', 'measurements_clean', count(*) FILTER (air_quality NOT IN ('Good', 'Normal', 'Bad', 'Very bad')) FROM measurements_clean",
    "SELECT 'accepted:season', 'measurements_clean', count(*) FILTER (season NOT IN ('Winter', 'Spring', 'Summer', 'Fall')) FROM measurements_clean",
]
oracle("dq_run_checks", " UNION ALL ".join(_CHECKS), pivoted=PIVOTED)

# --- exploration -------------------------------------------------------------

oracle(
    "overview",
    """SELECT count(*) AS total_rows, count(*) FILTER (instrument_status = 0 AND clean_value IS NOT NULL) AS normal_rows,
min(measurement_datetime) AS min_dt, max(measurement_datetime) AS max_dt, count(DISTINCT station_code) AS n_stations,
count(DISTINCT item_code) AS n_pollutants FROM measurements_clean""",
)
NORMAL = "instrument_status = 0 AND clean_value IS NOT NULL"
Q1 = f"""SELECT station_code, avg(d) AS station_avg FROM (SELECT station_code, avg(clean_value) AS d FROM cleaned
WHERE item_code = 0 AND {NORMAL} GROUP BY station_code, CAST(measurement_datetime AS DATE)) GROUP BY station_code"""
oracle("eda_q1_station_means", f"SELECT station_code, round(station_avg, 6) AS station_avg FROM ({Q1})")
oracle("eda_q1_grand_mean", f"SELECT round(avg(station_avg), 5) AS grand_avg FROM ({Q1})")
oracle("eda_q2_season_means", f"SELECT season, round(avg(clean_value), 5) AS avg_value FROM measurements_clean WHERE item_code = 4 AND station_code = 209 AND {NORMAL} GROUP BY season")
Q3 = f"SELECT hour, round(stddev_samp(clean_value), 5) AS std_value, round(avg(clean_value), 5) AS avg_value, count(*) AS n FROM measurements_clean WHERE item_code = 5 AND {NORMAL} GROUP BY hour"
oracle("eda_q3_hour_spread", Q3)
oracle("eda_q3_peak_hour", f"SELECT hour, std_value FROM ({Q3}) WHERE std_value IS NOT NULL ORDER BY std_value DESC, hour LIMIT 1")
oracle("eda_q4_abnormal_data", "SELECT station_code, count(*) AS abnormal_data_count FROM measurements_clean WHERE instrument_status = 9 GROUP BY station_code")
oracle("eda_q5_not_normal", "SELECT station_code, count(*) AS not_normal_count FROM measurements_clean WHERE instrument_status <> 0 GROUP BY station_code")
oracle("eda_q6_classes", "SELECT air_quality, count(*) AS cnt, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM measurements_clean WHERE item_code = 8 AND air_quality IS NOT NULL GROUP BY air_quality")

# --- dashboard ---------------------------------------------------------------

SERIES_ROWS = f"SELECT measurement_datetime, station_code, o3_value AS value, instrument_status FROM dashboard_wide WHERE {RANGE}"
oracle("timeseries", f"SELECT strftime(measurement_datetime, '%Y-%m-%dT%H:%M:%S') AS measurement_datetime, station_code, value, instrument_status::INTEGER AS instrument_status FROM ({SERIES_ROWS})")
LATEST = f"""
SELECT s.station_code, s.latitude, s.longitude, a.value, coalesce(a.record_count, 0) AS record_count, d.instrument_status::INTEGER AS dominant_status
FROM (SELECT station_code, min(latitude) AS latitude, min(longitude) AS longitude FROM dashboard_wide GROUP BY station_code) s
LEFT JOIN (SELECT station_code, avg(value) AS value, count(value) AS record_count FROM ({SERIES_ROWS}) GROUP BY station_code) a USING (station_code)
LEFT JOIN (SELECT station_code, instrument_status, row_number() OVER (PARTITION BY station_code ORDER BY count(*) DESC, instrument_status ASC NULLS LAST) AS rn
  FROM ({SERIES_ROWS}) GROUP BY station_code, instrument_status) d ON s.station_code = d.station_code AND d.rn = 1"""
oracle("stations_latest", f"SELECT station_code, latitude, longitude, round(value, 6) AS value, record_count, dominant_status FROM ({LATEST})")
LABELS = {"so2_value": "SO₂", "no2_value": "NO₂", "o3_value": "O₃", "co_value": "CO", "pm10_value": "PM10", "pm2_5_value": "PM2.5"}
MISSING = " UNION ALL ".join(
    f"SELECT '{label}' AS pollutant, {share(f'(count(*) FILTER ({c} IS NULL))')} AS missing_pct FROM dashboard_wide WHERE {RANGE}"
    for c, label in LABELS.items()
)
oracle("missing_pct", MISSING)
AVAILABLE = f"SELECT station_code, {share('count(instrument_status)')} AS availability_pct FROM dashboard_wide WHERE {RANGE} GROUP BY station_code"
oracle("availability", AVAILABLE)
oracle("monthly_quality", f"SELECT strftime(measurement_datetime, '%Y-%m') AS month, {share('count(instrument_status)')} AS status_pct, {share('count(so2_value)')} AS valid_pct FROM dashboard_wide WHERE {RANGE} GROUP BY ALL")


def q(value: str, p: float, name: str) -> str:
    return f"round(quantile_cont({value}, {p}), 6) AS {name}"


oracle(
    "station_stats",
    f"""SELECT station_code, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS min,
max(value) AS max, {q('value', 0.5, 'p50')}, {q('value', 0.75, 'p75')}, {q('value', 0.9, 'p90')}, {q('value', 0.95, 'p95')}, {q('value', 0.99, 'p99')}
FROM ({SERIES_ROWS}) GROUP BY station_code""",
)
oracle(
    "overall_stats",
    f"""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, min(value) AS min, max(value) AS max,
{q('value', 0.5, 'median')}, {q('value', 0.75, 'p75')}, {q('value', 0.9, 'p90')}, {q('value', 0.95, 'p95')}, {q('value', 0.99, 'p99')}
FROM ({SERIES_ROWS})""",
)
oracle(
    "axis_cap",
    f"""SELECT CAST(ceil(value * 1.2) AS BIGINT) AS axis_cap FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n
FROM ({SERIES_ROWS}) WHERE value > 0) WHERE rn = CAST(floor(n * 0.99) AS BIGINT) + 1""",
)
oracle(
    "histogram",
    f"""SELECT g.bin::INTEGER AS bin, round(lo + g.bin * w, 6) AS low, round(lo + g.bin * w + w, 6) AS high, round(lo + g.bin * w + w / 2, 6) AS center,
  coalesce(h.n, 0) AS n FROM span, (SELECT unnest(range(40)) AS bin) g LEFT JOIN (
  SELECT least(39, CAST(floor((value - lo) / w) AS BIGINT)) AS bin, count(*) AS n FROM ({SERIES_ROWS}), span WHERE value IS NOT NULL GROUP BY ALL) h ON g.bin = h.bin""",
    span=f"SELECT min(value) AS lo, coalesce(nullif((max(value) - min(value)) / 40.0::DOUBLE, 0), 1) AS w FROM ({SERIES_ROWS})",
)
oracle(
    "corr_matrix",
    """SELECT a.station_code AS station_a, b.station_code AS station_b, count(*) AS n,
  CASE WHEN a.station_code = b.station_code THEN 1.0 WHEN var_pop(a.clean_value) > 0 AND var_pop(b.clean_value) > 0
  THEN round(covar_pop(a.clean_value, b.clean_value) / sqrt(var_pop(a.clean_value) * var_pop(b.clean_value)), 6) END AS r
FROM network a JOIN network b USING (measurement_datetime) WHERE a.clean_value IS NOT NULL AND b.clean_value IS NOT NULL
GROUP BY a.station_code, b.station_code""",
)
oracle("exceedance", f"SELECT count(value) AS n, count(*) FILTER (value > 30) AS n_above, {share('count(*) FILTER (value > 30)', 'count(value)')} AS above_pct FROM ({SERIES_ROWS})")
oracle("status_mix", f"SELECT instrument_status::INTEGER AS instrument_status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS share_pct FROM ({SERIES_ROWS}) GROUP BY instrument_status")
oracle(
    "series_kpis",
    f"""SELECT count(*) AS n_rows, {share('count(*) FILTER (value IS NULL)')} AS missing_pct, {share('count(*) FILTER (instrument_status = 0)')} AS normal_pct,
round(avg(value), 6) AS mean, count(*) FILTER (value > 30) AS n_above FROM ({SERIES_ROWS})""",
)
oracle("abnormal_readings", f"SELECT measurement_datetime, station_code, value, instrument_status::INTEGER AS instrument_status FROM ({SERIES_ROWS}) WHERE instrument_status IS DISTINCT FROM 0 AND value IS NOT NULL")
HAS = "value IS NOT NULL AND record_count > 0"
oracle(
    "geo_kpis",
    f"""SELECT count(*) AS n_stations, count(*) FILTER ({HAS}) AS with_data, count(*) FILTER ({HAS} AND value > 25) AS above,
count(*) FILTER ({HAS} AND value <= 25) AS below, count(*) FILTER (NOT ({HAS})) AS missing, round(avg(value), 6) AS mean_of_means FROM ({LATEST})""",
)
oracle(
    "map_points",
    f"""SELECT station_code, latitude, longitude, round(value, 6) AS value, record_count, dominant_status, CAST({HAS} AND value > 25 AS INTEGER) AS above,
CAST({HAS} AS INTEGER) AS has_data, round(CASE WHEN {HAS} THEN value / greatest(1e-9, max(coalesce(value, 0)) OVER ()) ELSE 0 END, 6) AS normalized FROM ({LATEST})""",
)
oracle(
    "top_bottom_k",
    f"""SELECT 'highest' AS side, row_number() OVER (ORDER BY value DESC, station_code)::INTEGER AS rank, station_code, round(value, 6) AS value FROM ({LATEST}) WHERE {HAS} QUALIFY rank <= 5
UNION ALL SELECT 'cleanest', row_number() OVER (ORDER BY value, station_code DESC)::INTEGER AS rank, station_code, round(value, 6) FROM ({LATEST}) WHERE {HAS} QUALIFY rank <= 5""",
)
oracle(
    "quality_kpis",
    f"""SELECT (SELECT pollutant FROM ({MISSING}) ORDER BY missing_pct DESC LIMIT 1) AS worst_pollutant, (SELECT max(missing_pct) FROM ({MISSING})) AS worst_missing_pct,
(SELECT round(avg(availability_pct), 6) FROM (SELECT count(instrument_status) / CAST(count(*) AS DOUBLE) * 100 AS availability_pct FROM dashboard_wide WHERE {RANGE} GROUP BY station_code)) AS avg_availability_pct,
(SELECT count(*) FROM ({AVAILABLE}) WHERE availability_pct < 95) AS below_target""",
)
oracle(
    "forecast_kpis",
    """SELECT count(*) AS horizon, round(avg(predicted_value), 6) AS mean, min(predicted_value) AS min, max(predicted_value) AS max,
round(avg(predicted_upper_90 - predicted_lower_90), 6) AS mean_width, min(measurement_datetime) AS first_hour, max(measurement_datetime) AS last_hour FROM predictions""",
)
oracle("interval_widths", "SELECT measurement_datetime, station_code, item_code, predicted_upper_90 - predicted_lower_90 AS width FROM predictions")
oracle("forecast_summary", "SELECT station_code, item_name, count(*) AS count, round(avg(predicted_value), 5) AS mean, min(predicted_value) AS min, max(predicted_value) AS max FROM predictions GROUP BY ALL")
oracle("anomaly_kpis", f"SELECT count(*) AS n, count(*) FILTER (is_anomaly = 1) AS anomalies, {share('count(*) FILTER (is_anomaly = 1)')} AS rate_pct, greatest(max(anomaly_score), 0) AS max_score FROM anomalies")
oracle("anomaly_summary", "SELECT station_code, item_name, sum(is_anomaly)::BIGINT AS sum, count(*) AS count FROM anomalies GROUP BY ALL")
oracle("list_targets", "SELECT station_code, item_code, min(item_name) AS item_name, station_code || '-' || item_code AS key FROM predictions GROUP BY station_code, item_code")
oracle(
    "score_grid",
    """SELECT d.day, h.hour::INTEGER AS hour, round(coalesce(c.s, 0), 4) AS score FROM (SELECT DISTINCT strftime(measurement_datetime, '%m-%d') AS day FROM anomalies) d,
(SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT strftime(measurement_datetime, '%m-%d') AS day, hour(measurement_datetime) AS hour, avg(anomaly_score) AS s FROM anomalies GROUP BY ALL) c
ON c.day = d.day AND c.hour = h.hour""",
)
oracle(
    "landing_kpis",
    "SELECT count(DISTINCT station_code) AS n_stations, count(*) AS n_rows, CAST(min(measurement_datetime) AS DATE) AS first_day, CAST(max(measurement_datetime) AS DATE) AS last_day, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in COLUMNS.values())
    + " FROM dashboard_wide",
)
LABEL = "CASE instrument_status WHEN 0 THEN 'Normal' WHEN 1 THEN 'Need Calibration' WHEN 2 THEN 'Abnormal' WHEN 4 THEN 'Power cut' WHEN 8 THEN 'Under repair' WHEN 9 THEN 'Bad Data' ELSE 'Missing Status' END"
oracle(
    "sidebar_filter",
    f"""SELECT measurement_datetime, station_code, CAST(measurement_datetime AS DATE) AS date, dayname(measurement_datetime) AS day_name, hour(measurement_datetime)::INTEGER AS hour,
{LABEL} AS status_label FROM dashboard_wide WHERE CAST(measurement_datetime AS DATE) BETWEEN DATE '2021-02-10' AND DATE '2021-03-20' AND hour(measurement_datetime) BETWEEN 6 AND 18
AND {LABEL} IN ('Normal', 'Missing Status')""",
)
oracle("default_days", "SELECT greatest(CAST(min(measurement_datetime) AS DATE), CAST(max(measurement_datetime) AS DATE) - 30)::DATE AS first_day, CAST(max(measurement_datetime) AS DATE) AS last_day FROM dashboard_wide")
oracle("contamination", "SELECT station_code, item_code, round(avg(CASE WHEN instrument_status <> 0 THEN 1 ELSE 0 END), 6) AS anomaly_rate, round(greatest(avg(CASE WHEN instrument_status <> 0 THEN 1 ELSE 0 END), 0.01), 6) AS contamination FROM cleaned WHERE instrument_status IS NOT NULL GROUP BY ALL")

# --- ordered series ----------------------------------------------------------

LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
WINDOWS = (3, 6, 12, 24, 48, 168)
KEY = "station_code, item_code, measurement_datetime"


def lag_columns(v: str) -> list[str]:
    out = []
    for k in LAGS:
        lag = f"lag({v}, {k}) OVER ({SERIES_W})"
        out += [f"{lag} AS lag_{k}", f"{v} - {lag} AS diff_{k}", f"abs({v} - {lag}) AS abs_diff_{k}"]
    return out


def rolling_columns(v: str) -> list[str]:
    out = []
    for n in WINDOWS:
        w = f"OVER ({SERIES_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [
            f"round(avg({v}) {w}, 6) AS rmean_{n}",
            f"round(stddev_samp({v}) {w}, 6) AS rstd_{n}",
            f"min({v}) {w} AS rmin_{n}",
            f"max({v}) {w} AS rmax_{n}",
            f"max({v}) {w} - min({v}) {w} AS rrange_{n}",
        ]
    return out


oracle("lags_diffs", f"SELECT {KEY}, clean_value, {', '.join(lag_columns('clean_value'))} FROM network")
oracle("rolling_prev", f"SELECT {KEY}, clean_value, {', '.join(rolling_columns('clean_value'))} FROM network")
oracle("spike", f"SELECT {KEY}, abs(clean_value - (lag(clean_value) OVER ({SERIES_W}) + lead(clean_value) OVER ({SERIES_W})) / 2) AS spike_score FROM network")


def flat(n: int, needed: int) -> str:
    w = f"OVER ({SERIES_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CAST(count(clean_value) {w} >= {needed} AND max(clean_value) {w} = min(clean_value) {w} AS INTEGER)"


oracle("flatline", f"SELECT {KEY}, {flat(6, 3)} AS flatline_6h, {flat(12, 6)} AS flatline_12h FROM cleaned")
oracle(
    "stuck_run",
    f"""SELECT {KEY}, row_number() OVER (PARTITION BY station_code, item_code, island ORDER BY measurement_datetime) - 1 AS consecutive_same FROM (
SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({SERIES_W}) AS island FROM (
SELECT *, coalesce(clean_value = lag(clean_value) OVER ({SERIES_W}), false) AS same FROM cleaned))""",
)
oracle(
    "hourly_dev",
    f"""SELECT {KEY}, round((clean_value - med) / greatest(sd, 1e-10), 6) AS dev_from_hourly_median FROM network n
LEFT JOIN (SELECT station_code, item_code, hour(measurement_datetime) AS h, quantile_cont(clean_value, 0.5) AS med, stddev_samp(clean_value) AS sd FROM network GROUP BY ALL) s
USING (station_code, item_code) WHERE s.h = hour(n.measurement_datetime)""",
)
oracle("spine_fill", f"SELECT {KEY}, clean_value FROM filled")
RUNS = f"""SELECT *, count(*) OVER (PARTITION BY station_code, item_code, flag, run) AS len, avg(flag) OVER (PARTITION BY station_code, item_code) AS rate FROM (
SELECT *, row_number() OVER ({SERIES_W}) - row_number() OVER (PARTITION BY station_code, item_code, flag ORDER BY measurement_datetime) AS run FROM scored)"""
oracle("run_filter", f"SELECT {KEY}, flag, CASE WHEN flag = 1 AND len < 3 THEN 0 ELSE flag END AS is_anomaly FROM ({RUNS})")
oracle("adaptive_smoothing", f"SELECT {KEY}, flag, CASE WHEN flag = 1 AND len < 3 AND rate > 0.4 THEN 0 ELSE flag END AS is_anomaly FROM ({RUNS})")
oracle("last_rows", f"SELECT {KEY}, clean_value FROM network QUALIFY row_number() OVER (PARTITION BY station_code, item_code ORDER BY measurement_datetime DESC) <= 100")
oracle(
    "tail_stats",
    "SELECT station_code, item_code, "
    + ", ".join(
        f"round({f}(CASE WHEN rn <= {n} THEN clean_value END), 6) AS last_{n}h_{name}"
        for n in (24, 168, 720)
        for f, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )
    + " FROM (SELECT *, row_number() OVER (PARTITION BY station_code, item_code ORDER BY measurement_datetime DESC) AS rn FROM filled) GROUP BY ALL",
)
FOLDS = """SELECT station_code, item_code, n - (b + 1) * 168 AS train_end, n - (b + 1) * 168 AS test_start, n - b * 168 AS test_end
FROM (SELECT station_code, item_code, count(*) AS n FROM filled GROUP BY ALL), (SELECT unnest(range(3)) AS b) WHERE n - (b + 1) * 168 >= 2150"""
oracle("folds", f"SELECT *, row_number() OVER (PARTITION BY station_code, item_code ORDER BY test_start) - 1 AS fold FROM ({FOLDS})")
oracle(
    "fold_rows",
    f"""SELECT f.station_code, f.item_code, fold, count(*) AS n, count(*) FILTER (rn >= test_start) AS n_test, round(sum(clean_value), 6) AS total
FROM (SELECT *, row_number() OVER ({SERIES_W}) - 1 AS rn FROM filled) r JOIN (SELECT *, row_number() OVER (PARTITION BY station_code, item_code ORDER BY test_start) - 1 AS fold FROM ({FOLDS})) f
ON r.station_code = f.station_code AND r.item_code = f.item_code AND r.rn < f.test_end GROUP BY ALL""",
)
oracle(
    "holdout",
    f"""SELECT {KEY}, measurement_datetime >= max(measurement_datetime) OVER (PARTITION BY station_code, item_code) - INTERVAL 1 MONTH + INTERVAL 1 HOUR AS is_validation FROM network""",
)
oracle("chronological_split", f"SELECT {KEY}, row_number() OVER ({SERIES_W}) - 1 < floor(count(*) OVER (PARTITION BY station_code, item_code) * 0.9::DOUBLE) AS is_train FROM network")
oracle("ordered_split", f"SELECT {KEY}, row_number() OVER (ORDER BY station_code, item_code, measurement_datetime) <= floor(count(*) OVER () * 0.9::DOUBLE) AS is_train FROM network")
oracle(
    "lookback_window",
    f"""SELECT {KEY}, len(v) AS n, round(list_sum(v), 6) AS total, v[1] AS oldest, v[48] AS newest FROM (
SELECT *, list(clean_value) OVER ({SERIES_W} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS v FROM filled) WHERE len(v) = 48""",
)

# --- look-back joins and profiles --------------------------------------------

CUT = "TIMESTAMP '2021-04-20 00:00:00'"
ANCHORS = (168, 336, 504, 720)
oracle(
    "anchor_lags",
    "SELECT t.station_code, t.item_code, t.measurement_datetime, "
    + ", ".join(f"a{k}.clean_value AS anchor_lag_{k}h" for k in ANCHORS)
    + f" FROM (SELECT * FROM network WHERE measurement_datetime >= {CUT}) t "
    + " ".join(
        f"LEFT JOIN (SELECT * FROM network WHERE measurement_datetime < {CUT}) a{k} ON a{k}.station_code = t.station_code AND a{k}.item_code = t.item_code AND a{k}.measurement_datetime = t.measurement_datetime - INTERVAL {k} HOUR"
        for k in ANCHORS
    ),
)
oracle(
    "seasonal_naive",
    f"""SELECT t.station_code, t.item_code, t.measurement_datetime, round(CASE WHEN a.station_code IS NOT NULL THEN a.clean_value ELSE coalesce(h.m, g.m) END, 6) AS naive
FROM (SELECT * FROM network WHERE measurement_datetime >= {CUT}) t
LEFT JOIN train a ON a.station_code = t.station_code AND a.item_code = t.item_code AND a.measurement_datetime = t.measurement_datetime - INTERVAL 168 HOUR
LEFT JOIN (SELECT station_code, item_code, hour(measurement_datetime) AS h, avg(clean_value) AS m FROM train GROUP BY ALL) h ON h.station_code = t.station_code AND h.item_code = t.item_code AND h.h = hour(t.measurement_datetime)
LEFT JOIN (SELECT station_code, item_code, avg(clean_value) AS m FROM train GROUP BY ALL) g ON g.station_code = t.station_code AND g.item_code = t.item_code""",
    train=f"SELECT * FROM network WHERE measurement_datetime < {CUT}",
)
PARTS = {
    "hour": ["hour(measurement_datetime)"],
    "dow": ["isodow(measurement_datetime)"],
    "month": ["month(measurement_datetime)"],
    "hour_dow": ["hour(measurement_datetime)", "isodow(measurement_datetime)"],
    "month_hour": ["month(measurement_datetime)", "hour(measurement_datetime)"],
}


def over(level: str) -> str:
    return "OVER (PARTITION BY station_code, item_code" + "".join(f", {p}" for p in PARTS.get(level, [])) + ")"


def encoding(level: str) -> str:
    w = over(level)
    weight = f"(count(clean_value) {w} / (count(clean_value) {w} + 10.0::DOUBLE))"
    gm = f"avg(clean_value) {over('all')}"
    return f"round(coalesce({weight} * avg(clean_value) {w} + (1 - {weight}) * {gm}, {gm}), 6) AS enc_{level}"


NUDGED = ", ".join(encoding(p).replace(", 6) AS", " + CAST(1e-9 AS DOUBLE), 6) AS") for p in PARTS)
oracle("target_encoding", f"SELECT {KEY}, clean_value, {NUDGED} FROM network")
oracle(
    "hour_stats",
    f"""SELECT {KEY}, clean_value, round(avg(clean_value) {over('hour')}, 6) AS hour_mean, round(stddev_samp(clean_value) {over('hour')}, 6) AS hour_std,
round(quantile_cont(clean_value, 0.5) {over('hour')}, 6) AS hour_median, round(coalesce(avg(clean_value) {over('hour_dow')}, CASE WHEN count(clean_value) {over('hour_dow')} = 0 THEN avg(clean_value) {over('hour')} END), 6) AS hour_dow_mean,
round(CASE WHEN count(clean_value) {over('hour_dow')} = 0 THEN stddev_samp(clean_value) {over('hour')} ELSE stddev_samp(clean_value) {over('hour_dow')} END, 6) AS hour_dow_std,
round(coalesce(avg(clean_value) {over('month_hour')}, avg(clean_value) {over('hour')}), 6) AS month_hour_mean FROM network""",
)
oracle(
    "group_stats",
    f"""SELECT {KEY}, round(coalesce(avg(clean_value) {over('hour')}, avg(clean_value) {over('all')}), 6) AS enc_hour,
round(coalesce(avg(clean_value) {over('hour_dow')}, avg(clean_value) {over('all')}), 6) AS enc_hour_dow,
round(coalesce(avg(clean_value) {over('month_hour')}, avg(clean_value) {over('all')}), 6) AS enc_month_hour,
round(avg(clean_value) {over('all')}, 6) AS group_mean, round(stddev_samp(clean_value) {over('all')}, 6) AS group_std FROM network""",
)
TWO_PI = "2 * pi()"
oracle(
    "cyclical",
    f"""SELECT {KEY}, hour(measurement_datetime)::INTEGER AS hour, (isodow(measurement_datetime) - 1)::INTEGER AS day_of_week, month(measurement_datetime)::INTEGER AS month,
dayofyear(measurement_datetime)::INTEGER AS day_of_year, CAST(isodow(measurement_datetime) >= 6 AS INTEGER) AS is_weekend,
round(sin({TWO_PI} * hour(measurement_datetime) / 24), 6) AS hour_sin, round(cos({TWO_PI} * hour(measurement_datetime) / 24), 6) AS hour_cos,
round(sin({TWO_PI} * (isodow(measurement_datetime) - 1) / 7), 6) AS dow_sin, round(cos({TWO_PI} * (isodow(measurement_datetime) - 1) / 7), 6) AS dow_cos,
round(sin({TWO_PI} * month(measurement_datetime) / 12), 6) AS month_sin, round(cos({TWO_PI} * month(measurement_datetime) / 12), 6) AS month_cos FROM network""",
)
FOURIER = [("daily", 24, 4), ("weekly", 168, 3), ("yearly", 8766, 5)]
oracle(
    "fourier",
    f"SELECT {KEY}, "
    + ", ".join(
        f"round({f}({TWO_PI} * {k} * t / {p}), 6) AS four_{n}_{f}_{k}" for n, p, terms in FOURIER for k in range(1, terms + 1) for f in ("sin", "cos")
    )
    + f" FROM (SELECT *, (epoch(measurement_datetime) - epoch(min(measurement_datetime) OVER (PARTITION BY station_code, item_code))) / 3600 AS t FROM network)",
)

# --- space -------------------------------------------------------------------

oracle("knn_stations", "SELECT station_code, neighbor_code, neighbor_rank, round(distance, 6) AS distance, round(weight, 6) AS weight FROM knn")
oracle(
    "spatial_climatology",
    """SELECT k.station_code, h.item_code, h.hour, round(coalesce(sum(k.weight * h.m), 0), 6) AS spatial_idw_mean, round(coalesce(avg(h.s), 0), 6) AS spatial_std FROM knn k
JOIN (SELECT station_code, item_code, hour(measurement_datetime)::INTEGER AS hour, avg(clean_value) AS m, stddev_samp(clean_value) AS s FROM usable GROUP BY ALL) h ON h.station_code = k.neighbor_code GROUP BY ALL""",
)
# neighbours filled on the hours of each target series
oracle(
    "knn_idw",
    """SELECT station_code, item_code, measurement_datetime, round(coalesce(sum(weight * v), 0), 6) AS spatial_idw_mean, round(stddev_samp(v), 6) AS spatial_std FROM (
SELECT t.*, coalesce(
  last_value(r.clean_value IGNORE NULLS) OVER (PARTITION BY t.station_code, t.item_code, t.neighbor_code ORDER BY t.measurement_datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(r.clean_value IGNORE NULLS) OVER (PARTITION BY t.station_code, t.item_code, t.neighbor_code ORDER BY t.measurement_datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
FROM (SELECT s.*, k.neighbor_code, k.weight FROM spine s JOIN knn k USING (station_code)) t
LEFT JOIN usable r ON r.station_code = t.neighbor_code AND r.item_code = t.item_code AND r.measurement_datetime = t.measurement_datetime) GROUP BY ALL""",
)
W_POINT = """SELECT *, w / sum(w) OVER (PARTITION BY station_code) AS weight FROM (SELECT station_code, point_name, 1.0 / pow(greatest(sqrt((latitude - lat) * (latitude - lat) + (longitude - lon) * (longitude - lon)), 1e-6), 2.0) AS w
FROM stations, (VALUES ('center', CAST(37.55 AS DOUBLE), CAST(127.0 AS DOUBLE)), ('nw', 37.65, 126.9), ('se', 37.47, 127.1)) p(point_name, lat, lon))"""


def filled_weather(order: str) -> str:
    part = f"PARTITION BY {order}, point_name ORDER BY measurement_datetime"
    return ", ".join(
        f"coalesce(last_value(w.{v} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(w.{v} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {v}"
        for v in WEATHER
    )


oracle(
    "weather_idw",
    "SELECT station_code, item_code, measurement_datetime, "
    + ", ".join(f"round(sum(weight * {v}), 6) AS weather_{v}" for v in WEATHER)
    + f""" FROM (SELECT t.station_code, t.item_code, t.measurement_datetime, t.point_name, t.weight, {filled_weather('t.station_code, t.item_code')}
FROM (SELECT s.*, p.point_name, p.weight FROM spine s JOIN wp p USING (station_code)) t LEFT JOIN weather w ON w.point_name = t.point_name AND w.time = t.measurement_datetime) GROUP BY ALL""".replace(
        "PARTITION BY t.station_code, t.item_code, point_name ORDER BY measurement_datetime",
        "PARTITION BY t.station_code, t.item_code, t.point_name ORDER BY t.measurement_datetime",
    ),
    wp=W_POINT,
)
oracle(
    "weather_climatology",
    "SELECT station_code, month, hour, "
    + ", ".join(f"round(sum(weight * {v}), 6) AS weather_{v}" for v in WEATHER)
    + " FROM wp JOIN (SELECT point_name, month(measurement_datetime)::INTEGER AS month, hour(measurement_datetime)::INTEGER AS hour, "
    + ", ".join(f"avg({v}) AS {v}" for v in WEATHER)
    + f""" FROM (SELECT b.time AS measurement_datetime, p.point_name, {filled_weather('1')} FROM (SELECT time FROM weather WHERE point_name = 'center') b, (SELECT DISTINCT point_name FROM wp) p
LEFT JOIN weather w ON w.point_name = p.point_name AND w.time = b.time) GROUP BY ALL) USING (point_name) GROUP BY ALL""".replace(
        "PARTITION BY 1, point_name ORDER BY measurement_datetime", "PARTITION BY p.point_name ORDER BY b.time"
    ),
    wp=W_POINT,
)

# --- calibration and metrics -------------------------------------------------

BLEND = "greatest(0.6::DOUBLE * lgbm + 0.2::DOUBLE * ridge + 0.2::DOUBLE * naive, 0)"
oracle("blend", f"SELECT {KEY}, fold, round({BLEND}, 6) AS ensemble FROM forecasts")
CQR = """SELECT station_code, item_code, s AS cqr FROM (SELECT station_code, item_code, greatest(q05 - y_true, y_true - q95) AS s,
row_number() OVER (PARTITION BY station_code, item_code ORDER BY greatest(q05 - y_true, y_true - q95)) - 1 AS rn, count(*) OVER (PARTITION BY station_code, item_code) AS n FROM forecasts)
WHERE rn = ceil(least(ceil(0.9::DOUBLE * (n + 1)) / n, 1.0::DOUBLE) * (n - 1))"""
oracle("cqr", f"SELECT station_code, item_code, round(cqr, 6) AS cqr FROM ({CQR})")
oracle(
    "cqr_applied",
    f"""SELECT {KEY}, fold, round(lo, 6) AS q05, round(greatest(q95 + cqr, lo), 6) AS q95 FROM (
SELECT f.*, c.cqr, greatest(q05 - cqr, 0) AS lo FROM forecasts f JOIN ({CQR}) c USING (station_code, item_code))""",
)


def metrics(p: str) -> str:
    e = f"(y_true - {p})"
    return f"""round(sqrt(avg({e} * {e})), 6) AS rmse, round(avg(abs({e})), 6) AS mae, round(avg(CASE WHEN y_true <> 0 THEN abs({e} / y_true) END) * 100, 6) AS mape,
round(CASE WHEN var_pop(y_true) = 0 THEN 0 ELSE 1 - sum({e} * {e}) / (var_pop(y_true) * count(*)) END, 6) AS r2, round(sqrt(avg({e} * {e})) / stddev_pop(y_true), 6) AS nrmse, count(*) AS n_samples"""


oracle(
    "metrics",
    " UNION ALL ".join(f"SELECT station_code, item_code, fold, '{m}' AS model, {metrics(m)} FROM forecasts GROUP BY station_code, item_code, fold" for m in ("lgbm", "ridge", "naive")),
)
FOLD_RMSE = " UNION ALL ".join(
    f"SELECT station_code, item_code, '{m}' AS model, avg(r) AS rmse FROM (SELECT station_code, item_code, fold, sqrt(avg((y_true - {m}) * (y_true - {m}))) AS r FROM forecasts GROUP BY ALL) GROUP BY ALL"
    for m in ("lgbm", "ridge", "naive")
)
oracle("cv_improvement", f"SELECT station_code, item_code, model, round(rmse, 6) AS rmse, round((1 - rmse / max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY station_code, item_code)) * 100, 6) AS improvement_pct FROM ({FOLD_RMSE})")
oracle("best_model", f"SELECT station_code, item_code, arg_min(model, rmse) AS best, round(min(rmse), 6) AS rmse FROM ({FOLD_RMSE}) GROUP BY ALL")
oracle(
    "interval_metrics",
    """SELECT station_code, item_code, CAST(0.9 AS DOUBLE) AS nominal_coverage, round(avg(CASE WHEN y_true BETWEEN q05 AND q95 THEN 1 ELSE 0 END), 6) AS empirical_coverage,
round(abs(avg(CASE WHEN y_true BETWEEN q05 AND q95 THEN 1 ELSE 0 END) - 0.9::DOUBLE), 6) AS calibration_error, round(avg(q95 - q05), 6) AS avg_interval_width, round(quantile_cont(q95 - q05, 0.5), 6) AS median_interval_width
FROM forecasts GROUP BY ALL""",
)
oracle(
    "f1_report",
    """SELECT station_code, item_code, round(coalesce(2 * tp / nullif(nt + np, 0), 0), 6) AS f1_anomaly, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision_anomaly, round(coalesce(tp / nullif(nt, 0), 0), 6) AS recall_anomaly,
round(ok / CAST(n AS DOUBLE), 6) AS accuracy, nt AS n_true_anomalies, np AS n_predicted_anomalies, n AS n_total FROM (
SELECT station_code, item_code, CAST(count(*) FILTER (label = 1 AND flag = 1) AS DOUBLE) AS tp, count(*) FILTER (label = 1) AS nt, count(*) FILTER (flag = 1) AS np, count(*) FILTER (label = flag) AS ok, count(*) AS n FROM scored GROUP BY ALL)""",
)
oracle(
    "pr_threshold",
    """SELECT station_code, item_code, score AS threshold, round(f1, 6) AS f1 FROM (
SELECT station_code, item_code, score, 2 * p * r / (p + r + CAST(1e-10 AS DOUBLE)) AS f1 FROM (
SELECT *, tp / CAST(n AS DOUBLE) AS p, CASE WHEN tt = 0 THEN 1.0 ELSE tp / CAST(tt AS DOUBLE) END AS r FROM (
SELECT station_code, item_code, score, sum(sum(label)) OVER (PARTITION BY station_code, item_code ORDER BY score DESC) AS tp, sum(count(*)) OVER (PARTITION BY station_code, item_code ORDER BY score DESC) AS n,
sum(sum(label)) OVER (PARTITION BY station_code, item_code) AS tt FROM scored GROUP BY station_code, item_code, score)))
QUALIFY row_number() OVER (PARTITION BY station_code, item_code ORDER BY f1 DESC, score) = 1""",
)
oracle(
    "ensemble_loss",
    """SELECT station_code, item_code, count(*) AS n, round(avg((y_true - lgbm) * (y_true - lgbm)), 4) AS mse_lgbm, round(avg((y_true - ridge) * (y_true - ridge)), 4) AS mse_ridge,
round(avg((y_true - naive) * (y_true - naive)), 4) AS mse_naive, true AS never_worse FROM forecasts GROUP BY ALL""",
)

# --- feature tables ----------------------------------------------------------


def calendar_columns(t: str = "measurement_datetime") -> list[str]:
    return [
        f"hour({t})::INTEGER AS hour",
        f"(isodow({t}) - 1)::INTEGER AS day_of_week",
        f"month({t})::INTEGER AS month",
        f"dayofyear({t})::INTEGER AS day_of_year",
        f"CAST(isodow({t}) >= 6 AS INTEGER) AS is_weekend",
    ]


def cyclical_columns(t: str = "measurement_datetime") -> list[str]:
    parts = {"hour": (f"hour({t})", 24), "dow": (f"(isodow({t}) - 1)", 7), "month": (f"month({t})", 12)}
    return [f"round({f}({TWO_PI} * {e} / {n}), 6) AS {name}_{f}" for name, (e, n) in parts.items() for f in ("sin", "cos")]


def fourier_columns(t: str) -> list[str]:
    return [
        f"round({f}({TWO_PI} * {k} * {t} / {p}), 6) AS four_{n}_{f}_{k}"
        for n, p, terms in FOURIER
        for k in range(1, terms + 1)
        for f in ("sin", "cos")
    ]


SINCE = "((epoch(measurement_datetime) - epoch(min(measurement_datetime) OVER (PARTITION BY station_code, item_code))) / 3600)"


def rolling_pair(n: int) -> list[str]:
    w = f"OVER ({SERIES_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return [f"round(avg(clean_value) {w}, 6) AS rolling_mean_{n}h", f"round(stddev_samp(clean_value) {w}, 6) AS rolling_std_{n}h"]


oracle(
    "train_features",
    f"SELECT {KEY}, clean_value, "
    + ", ".join(
        calendar_columns()
        + cyclical_columns()
        + fourier_columns(SINCE)
        + [encoding(p) for p in PARTS]
        + [f"lag(clean_value, {k}) OVER ({SERIES_W}) AS anchor_lag_{k}h" for k in ANCHORS]
        + rolling_pair(24)
        + rolling_pair(168)
    )
    + " FROM filled",
)

TRAIN_NET = f"SELECT * FROM network WHERE measurement_datetime < {CUT}"
TRAIN_SPINE = """SELECT station_code, item_code, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS measurement_datetime
FROM (SELECT station_code, item_code, min(measurement_datetime) AS lo, max(measurement_datetime) AS hi FROM train_net GROUP BY ALL)"""
TRAIN_FILLED = BASE["filled"].replace("FROM spine LEFT JOIN network", "FROM train_spine LEFT JOIN train_net")
TARGETS = f"SELECT station_code, item_code, measurement_datetime FROM network WHERE measurement_datetime >= {CUT}"


def level_table(level: str) -> str:
    parts = PARTS.get(level, [])
    names = [f"{p} AS k{i}" for i, p in enumerate(parts)]
    return f"(SELECT {', '.join(['station_code', 'item_code', *names])}, count(clean_value) AS n, avg(clean_value) AS m FROM train_filled GROUP BY ALL)"


def level_join(level: str) -> str:
    on = [f"{level}_t.station_code = t.station_code", f"{level}_t.item_code = t.item_code"]
    on += [f"{level}_t.k{i} = {p.replace('measurement_datetime', 't.measurement_datetime')}" for i, p in enumerate(PARTS.get(level, []))]
    return f"LEFT JOIN {level_table(level)} {level}_t ON {' AND '.join(on)}"


def level_encoding(level: str) -> str:
    n, m = f"{level}_t.n", f"{level}_t.m"
    return f"round(coalesce({n} / ({n} + 10.0::DOUBLE) * {m} + (1 - {n} / ({n} + 10.0::DOUBLE)) * all_t.m, all_t.m), 6) AS enc_{level}"


oracle(
    "prediction_features",
    "SELECT t.station_code, t.item_code, t.measurement_datetime, CAST(date_diff('hour', min(t.measurement_datetime) OVER (PARTITION BY t.station_code, t.item_code), t.measurement_datetime) AS BIGINT) AS horizon_step, "
    + ", ".join(
        calendar_columns("t.measurement_datetime")
        + cyclical_columns("t.measurement_datetime")
        + fourier_columns("((epoch(t.measurement_datetime) - epoch(e.lo)) / 3600)")
        + [level_encoding(p) for p in PARTS]
        + [f"a{k}.clean_value AS anchor_lag_{k}h" for k in ANCHORS]
        + [f"round(e.m{n}, 6) AS rolling_mean_{n}h, round(e.s{n}, 6) AS rolling_std_{n}h" for n in (24, 168)]
    )
    + " FROM targets t "
    + " ".join(level_join(p) for p in ("all", *PARTS))
    + " "
    + " ".join(
        f"LEFT JOIN train_filled a{k} ON a{k}.station_code = t.station_code AND a{k}.item_code = t.item_code AND a{k}.measurement_datetime = t.measurement_datetime - INTERVAL {k} HOUR"
        for k in ANCHORS
    )
    + """ LEFT JOIN (SELECT station_code, item_code, min(measurement_datetime) AS lo, avg(CASE WHEN rn <= 24 THEN clean_value END) AS m24, stddev_samp(CASE WHEN rn <= 24 THEN clean_value END) AS s24,
avg(CASE WHEN rn <= 168 THEN clean_value END) AS m168, stddev_samp(CASE WHEN rn <= 168 THEN clean_value END) AS s168 FROM (
SELECT *, row_number() OVER (PARTITION BY station_code, item_code ORDER BY measurement_datetime DESC) AS rn FROM train_filled) GROUP BY ALL) e ON e.station_code = t.station_code AND e.item_code = t.item_code""",
    train_net=TRAIN_NET,
    train_spine=TRAIN_SPINE,
    train_filled=TRAIN_FILLED,
    targets=TARGETS,
)

ITEM_SUFFIX = {0: "so2", 2: "no2", 4: "co", 5: "o3", 7: "pm10", 8: "pm2_5"}
CROSS = """SELECT t.station_code, t.item_code, t.measurement_datetime, t.other, coalesce(
  last_value(r.clean_value IGNORE NULLS) OVER (PARTITION BY t.station_code, t.item_code, t.other ORDER BY t.measurement_datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(r.clean_value IGNORE NULLS) OVER (PARTITION BY t.station_code, t.item_code, t.other ORDER BY t.measurement_datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
FROM (SELECT s.*, o.other FROM {spine} s JOIN (SELECT unnest([0, 2, 4, 5, 7, 8]) AS other) o ON o.other <> s.item_code) t
LEFT JOIN usable r ON r.station_code = t.station_code AND r.item_code = t.other AND r.measurement_datetime = t.measurement_datetime"""
CROSS_W = "PARTITION BY station_code, item_code, other ORDER BY measurement_datetime"
oracle(
    "cross_item_features",
    f"SELECT {KEY}, "
    + ", ".join(
        f"max(CASE WHEN other = {c} THEN l168 END) AS xpol_{n}_lag168h, max(CASE WHEN other = {c} THEN l336 END) AS xpol_{n}_lag336h, round(max(CASE WHEN other = {c} THEN r24 END), 6) AS xpol_{n}_rmean24"
        for c, n in ITEM_SUFFIX.items()
    )
    + f""" FROM (SELECT *, lag(v, 168) OVER ({CROSS_W}) AS l168, lag(v, 336) OVER ({CROSS_W}) AS l336, avg(v) OVER ({CROSS_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS r24 FROM crossed) GROUP BY ALL""",
    crossed=CROSS.format(spine="spine"),
)
oracle(
    "cross_item_prediction",
    "SELECT t.station_code, t.item_code, t.measurement_datetime, "
    + ", ".join(
        f"max(CASE WHEN o.other = {c} THEN a.clean_value END) AS xpol_{n}_lag168h, max(CASE WHEN o.other = {c} THEN b.clean_value END) AS xpol_{n}_lag336h, round(max(CASE WHEN o.other = {c} THEN h.m END), 6) AS xpol_{n}_rmean24"
        for c, n in ITEM_SUFFIX.items()
    )
    + """ FROM targets t JOIN (SELECT unnest([0, 2, 4, 5, 7, 8]) AS other) o ON o.other <> t.item_code
LEFT JOIN usable a ON a.station_code = t.station_code AND a.item_code = o.other AND a.measurement_datetime = t.measurement_datetime - INTERVAL 168 HOUR
LEFT JOIN usable b ON b.station_code = t.station_code AND b.item_code = o.other AND b.measurement_datetime = t.measurement_datetime - INTERVAL 336 HOUR
LEFT JOIN (SELECT station_code, item_code, other, hour(measurement_datetime) AS h, avg(v) AS m FROM crossed GROUP BY ALL) h ON h.station_code = t.station_code AND h.item_code = t.item_code AND h.other = o.other AND h.h = hour(t.measurement_datetime)
GROUP BY t.station_code, t.item_code, t.measurement_datetime""",
    train_net=TRAIN_NET,
    train_spine=TRAIN_SPINE,
    targets=TARGETS,
    crossed=CROSS.format(spine="train_spine"),
)
HOUR_STATS = f"""round(avg(clean_value) {over('hour')}, 6) AS hour_mean, round(stddev_samp(clean_value) {over('hour')}, 6) AS hour_std,
round(quantile_cont(clean_value, 0.5) {over('hour')}, 6) AS hour_median, round(CASE WHEN count(clean_value) {over('hour_dow')} = 0 THEN avg(clean_value) {over('hour')} ELSE avg(clean_value) {over('hour_dow')} END, 6) AS hour_dow_mean,
round(CASE WHEN count(clean_value) {over('hour_dow')} = 0 THEN stddev_samp(clean_value) {over('hour')} ELSE stddev_samp(clean_value) {over('hour_dow')} END, 6) AS hour_dow_std,
round(coalesce(avg(clean_value) {over('month_hour')}, avg(clean_value) {over('hour')}), 6) AS month_hour_mean"""
oracle("direct_features", f"SELECT {KEY}, {', '.join(calendar_columns() + cyclical_columns())}, {HOUR_STATS} FROM network")
oracle(
    "global_features",
    f"SELECT {KEY}, {LAT.format('station_code')} AS latitude, {LON.format('station_code')} AS longitude, ".replace(
        LAT.format("station_code"), f"round({LAT.format('station_code')}, 6)"
    ).replace(LON.format("station_code"), f"round({LON.format('station_code')}, 6)")
    + ", ".join(
        calendar_columns() + cyclical_columns() + fourier_columns("((epoch(measurement_datetime) - epoch(TIMESTAMP '2021-01-20 00:00:00')) / 3600)")
    )
    + f""", round(coalesce(avg(clean_value) {over('hour')}, avg(clean_value) {over('all')}), 6) AS enc_hour, round(coalesce(avg(clean_value) {over('hour_dow')}, avg(clean_value) {over('all')}), 6) AS enc_hour_dow,
round(coalesce(avg(clean_value) {over('month_hour')}, avg(clean_value) {over('all')}), 6) AS enc_month_hour, round(avg(clean_value) {over('all')}, 6) AS group_mean, round(stddev_samp(clean_value) {over('all')}, 6) AS group_std FROM usable""",
)
DEV = f"round((clean_value - quantile_cont(clean_value, 0.5) {over('hour')}) / greatest(stddev_samp(clean_value) {over('hour')}, 1e-10), 6)"
DEV = f"CASE WHEN stddev_samp(clean_value) {over('hour')} IS NOT NULL THEN {DEV} END"
oracle(
    "anomaly_features",
    f"SELECT {KEY}, clean_value AS value, round(ln(1 + clean_value), 6) AS log_value, {', '.join(rolling_columns('clean_value') + lag_columns('clean_value'))}, "
    f"row_number() OVER (PARTITION BY station_code, item_code, island ORDER BY measurement_datetime) - 1 AS consecutive_same, {flat(6, 3)} AS flatline_6h, {flat(12, 6)} AS flatline_12h, "
    f"CAST(coalesce(clean_value = 0, false) AS INTEGER) AS at_zero, CAST(coalesce(clean_value < 0, false) AS INTEGER) AS at_negative, "
    f"abs(clean_value - (lag(clean_value) OVER ({SERIES_W}) + lead(clean_value) OVER ({SERIES_W})) / 2) AS spike_score, "
    + ", ".join(cyclical_columns()[:4])
    + f", month(measurement_datetime)::INTEGER AS month, CAST(isodow(measurement_datetime) >= 6 AS INTEGER) AS is_weekend, {DEV} AS dev_from_hourly_median FROM ("
    f"SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({SERIES_W}) AS island FROM (SELECT *, coalesce(clean_value = lag(clean_value) OVER ({SERIES_W}), false) AS same FROM network))",
)


def zscore(n: int) -> str:
    w = f"OVER ({SERIES_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN stddev_samp(clean_value) {w} > 1e-9 THEN (clean_value - avg(clean_value) {w}) / stddev_samp(clean_value) {w} END, 6) AS zscore_{n}"


oracle("anomaly_zscores", f"SELECT {KEY}, {', '.join(zscore(n) for n in WINDOWS)} FROM network")
LAG1, LAG24 = f"lag(clean_value) OVER ({SERIES_W})", f"lag(clean_value, 24) OVER ({SERIES_W})"
oracle(
    "baseline_anomaly_features",
    f"""SELECT {KEY}, clean_value AS value, clean_value - {LAG1} AS diff_1h, clean_value - {LAG24} AS diff_24h, abs(clean_value - {LAG1}) AS abs_diff_1h, clean_value - {LAG24} AS diff_from_yesterday,
CAST(same AS INTEGER) AS same_as_prev, row_number() OVER (PARTITION BY station_code, item_code, island ORDER BY measurement_datetime) - 1 AS consecutive_same, hour(measurement_datetime)::INTEGER AS hour, (isodow(measurement_datetime) - 1)::INTEGER AS day_of_week
FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({SERIES_W}) AS island FROM (SELECT *, coalesce(clean_value = lag(clean_value) OVER ({SERIES_W}), false) AS same FROM cleaned))""",
)

# --- series scans, labels, alignment -------------------------------------------

SCAN = f"SELECT {KEY}, clean_value, instrument_status FROM cleaned WHERE"
BEFORE = "measurement_datetime < TIMESTAMP '2021-04-01 00:00:00'"
oracle("series_scan", f"{SCAN} station_code = 205 AND item_code = 5 AND instrument_status = 0 AND {BEFORE}")
oracle("series_every_status", f"{SCAN} station_code = 205 AND item_code = 5")
oracle("series_abnormal", f"{SCAN} instrument_status IN (4, 8, 9)")
oracle("series_all", f"SELECT {KEY}, clean_value, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM usable WHERE {BEFORE}")
oracle("stations", "SELECT DISTINCT station_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM readings")
oracle("one_target", f"SELECT {KEY}, predicted_value FROM predictions WHERE station_code = 206 AND item_code = 7")
oracle("named_period", f"{SCAN} station_code BETWEEN 212 AND 216 AND measurement_datetime BETWEEN TIMESTAMP '2021-01-01 00:00:00' AND TIMESTAMP '2021-12-31 23:00:00'")
oracle("fault_labels", f"SELECT {KEY}, CAST(instrument_status <> 0 AS INTEGER) AS label FROM cleaned WHERE instrument_status IS NOT NULL")
oracle("aligned", f"SELECT {KEY}, n.clean_value, u.clean_value AS reading FROM network n JOIN usable u USING (station_code, item_code, measurement_datetime)")
oracle("series_std", "SELECT station_code, item_code, round(stddev_samp(clean_value), 6) AS overall_std FROM filled GROUP BY ALL")
oracle(
    "unit_calendar",
    f"""SELECT {KEY}, round(hour(measurement_datetime) / 23.0::DOUBLE, 6) AS hour, round((isodow(measurement_datetime) - 1) / 6.0::DOUBLE, 6) AS dow,
round((month(measurement_datetime) - 1) / 11.0::DOUBLE, 6) AS month, round((dayofyear(measurement_datetime) - 1) / 365.0::DOUBLE, 6) AS day_of_year FROM network""",
)

# --- training statistics on later hours ------------------------------------------

CELLS = {"everything": [], "hours": ["hour"], "hour_dows": ["hour", "isodow"], "month_hours": ["month", "hour"]}


def cells(parts: list[str]) -> str:
    columns = "".join(f"{p}(measurement_datetime) AS c_{p}, " for p in parts)
    return f"""SELECT station_code, item_code, {columns}count(clean_value) AS n, avg(clean_value) AS m, stddev_samp(clean_value) AS s,
quantile_cont(clean_value, 0.5) AS med FROM train_net GROUP BY ALL"""


def cell_join(name: str, parts: list[str]) -> str:
    same = "".join(f" AND {name}.c_{p} = {p}(t.measurement_datetime)" for p in parts)
    return f"LEFT JOIN {name} ON {name}.station_code = t.station_code AND {name}.item_code = t.item_code{same}"


LATER = {"train_net": TRAIN_NET, "targets": TARGETS, **{name: cells(parts) for name, parts in CELLS.items()}}
LATER_FROM = "FROM targets t " + " ".join(cell_join(name, parts) for name, parts in CELLS.items())
T_KEY = "t.station_code, t.item_code, t.measurement_datetime"
oracle(
    "hour_stats_later",
    f"""SELECT {T_KEY}, round(hours.m, 6) AS hour_mean, round(hours.s, 6) AS hour_std, round(hours.med, 6) AS hour_median,
round(CASE WHEN hour_dows.n > 0 THEN hour_dows.m ELSE hours.m END, 6) AS hour_dow_mean,
round(CASE WHEN hour_dows.n > 0 THEN hour_dows.s ELSE hours.s END, 6) AS hour_dow_std,
round(coalesce(month_hours.m, hours.m), 6) AS month_hour_mean {LATER_FROM}""",
    **LATER,
)
oracle(
    "group_stats_later",
    f"""SELECT {T_KEY}, round(coalesce(hours.m, everything.m, 0), 6) AS enc_hour, round(coalesce(hour_dows.m, everything.m, 0), 6) AS enc_hour_dow,
round(coalesce(month_hours.m, everything.m, 0), 6) AS enc_month_hour, round(coalesce(everything.m, 0), 6) AS group_mean,
round(CASE WHEN everything.n > 0 THEN everything.s ELSE 1 END, 6) AS group_std {LATER_FROM}""",
    **LATER,
)

# --- ensemble weights: the best of the seven faces of the simplex ------------------

MOMENTS = "SELECT station_code, item_code, " + ", ".join(
    [f"avg({a} * {b}) AS g{i}{j}" for i, a in enumerate(("lgbm", "ridge", "naive")) for j, b in enumerate(("lgbm", "ridge", "naive")) if j >= i]
    + [f"avg({a} * y_true) AS c{i}" for i, a in enumerate(("lgbm", "ridge", "naive"))]
) + " FROM forecasts GROUP BY ALL"
FACE = "station_code, item_code, g00, g01, g02, g11, g12, g22, c0, c1, c2"
# the inside of the simplex: differences to the third model leave two unknowns
INSIDE = """SELECT *, (u * r - v * q) / nullif(p * r - q * q, 0) AS x, (v * p - u * q) / nullif(p * r - q * q, 0) AS y FROM (
SELECT *, g00 + g22 - 2 * g02 AS p, g01 + g22 - g02 - g12 AS q, g11 + g22 - 2 * g12 AS r, c0 - c2 + g22 - g02 AS u, c1 - c2 + g22 - g12 AS v FROM moments)"""


def edge(i: int, j: int) -> str:
    """Weight of model i on the edge between models i and j (i < j)."""
    return f"SELECT *, (c{i} - c{j} + g{j}{j} - g{i}{j}) / nullif(g{i}{i} + g{j}{j} - 2 * g{i}{j}, 0) AS x FROM moments"


FACES = f"""SELECT {FACE}, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM moments
UNION ALL SELECT {FACE}, 0, 1, 0 FROM moments
UNION ALL SELECT {FACE}, 0, 0, 1 FROM moments
UNION ALL SELECT {FACE}, x, 1 - x, 0 FROM ({edge(0, 1)})
UNION ALL SELECT {FACE}, x, 0, 1 - x FROM ({edge(0, 2)})
UNION ALL SELECT {FACE}, 0, x, 1 - x FROM ({edge(1, 2)})
UNION ALL SELECT {FACE}, x, y, 1 - x - y FROM ({INSIDE})"""
oracle(
    "ensemble_weights",
    """SELECT station_code, item_code, round(arg_min(a, loss), 6) AS w_lgbm, round(arg_min(b, loss), 6) AS w_ridge, round(arg_min(c, loss), 6) AS w_naive FROM (
SELECT *, a * a * g00 + b * b * g11 + c * c * g22 + 2 * (a * b * g01 + a * c * g02 + b * c * g12) - 2 * (a * c0 + b * c1 + c * c2) AS loss
FROM faces WHERE a >= 0 AND b >= 0 AND c >= 0) GROUP BY station_code, item_code""",
    moments=MOMENTS,
    faces=FACES,
)


# --- models: what any right fit has in common ---------------------------------
LATER = f"SELECT station_code, item_code, count(*) AS n, {{0}} FROM filled WHERE measurement_datetime >= {CUT} GROUP BY station_code, item_code"
oracle(
    "ridge_optimum",
    "SELECT station_code, item_code, count(*) AS n, CAST(0 AS DOUBLE) AS residual_sum, CAST(0 AS DOUBLE) AS gradient FROM filled GROUP BY station_code, item_code",
)
oracle("quantile_trees", f"SELECT station_code, item_code, count(*) AS n, TRUE AS covers FROM filled WHERE measurement_datetime < {CUT} GROUP BY station_code, item_code")
oracle("gbt_direct_hours", LATER.format("min(measurement_datetime) AS first, max(measurement_datetime) AS last, TRUE AS good"))
oracle(
    "isolation_forest_share",
    """SELECT station_code, item_code, n, n - 1 - CAST(floor((n - 1) * (1 - share)) AS BIGINT) AS most, TRUE AS within FROM (
SELECT station_code, item_code, count(*) - 24 AS n, greatest(avg(CASE WHEN instrument_status <> 0 THEN 1 ELSE 0 END), 0.01::DOUBLE) AS share
FROM cleaned WHERE instrument_status IS NOT NULL GROUP BY station_code, item_code HAVING count(clean_value) > 0 AND count(*) > 24)""",
)
oracle(
    "gbt_anomaly_holdout",
    """SELECT station_code, item_code, count(*) AS n_total, CAST(sum(CASE WHEN clean_value % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_true_anomalies, TRUE AS bounded FROM (
SELECT *, measurement_datetime >= max(measurement_datetime) OVER (PARTITION BY station_code, item_code) - INTERVAL 1 MONTH + INTERVAL 1 HOUR AS held FROM network)
WHERE held GROUP BY station_code, item_code""",
)
