"""Aggregates behind the panels: distributions, shares, correlations, KPIs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.calendar import hour_index, month_day
from hourloom.functions.scalars import percent
from hourloom.operators.ordered import cut
from hourloom.operators.ranks import quantiles, value_ranks
from hourloom.schemas import STATUS_NORMAL, TS

OVERALL_QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
STATION_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Least and largest number of stations of a block, if that leaves the least number of blocks.
STATION_BLOCK = 128
LARGEST_BLOCK = 1024
LEAST_BLOCKS = 16
HOUR_SLAB = 1024
#: Tasks of the pair sums: fewer pairs of blocks are shared among several tasks, more go together.
LEAST_TASKS, MOST_TASKS = 64, 4096
PAIRS_AT_ONCE = 1 << 17


def overall_statistics(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: count, mean, population std, extremes and exact quantiles."""
    whole = values.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    key = {"_all": F.lit(0)}
    points = quantiles(values.withColumns(key), ["_all"], value, OVERALL_QUANTILES)
    return whole.withColumns(key).join(points, "_all", "left").drop("_all")


def station_statistics(values: DataFrame, value: str = "value", exact: bool = True) -> DataFrame:
    """Per station: count, mean, sample std, extremes and quantiles.

    ``exact=False`` uses the mergeable sketch, which returns actual readings.
    """
    base = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    if not exact:
        sketch = F.percentile_approx(value, list(STATION_QUANTILES.values()), 10000).alias("_q")
        rows = values.groupBy("station_code").agg(*base, sketch)
        return rows.select(
            "station_code",
            *["n", "mean", "stddev", "min", "max"],
            *[F.col("_q")[i].alias(name) for i, name in enumerate(STATION_QUANTILES)],
        )
    points = quantiles(values, ["station_code"], value, STATION_QUANTILES)
    return values.groupBy("station_code").agg(*base).join(points, "station_code", "left")


def axis_cap(values: DataFrame, value: str = "value", least: int = 0) -> DataFrame:
    """1.2 times the 99 % order statistic of the positive values, rounded up.

    NULL without a positive value, or with ``least`` or fewer of them.
    """
    positive = values.filter(F.col(value) > 0).withColumn("_all", F.lit(0))
    ranked = value_ranks(positive, ["_all"], value)
    rank = F.floor(F.col("_n") * F.lit(0.99))
    picked = F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")) & (F.col("_n") > least), F.col(value)))
    return ranked.agg(F.ceil(picked * F.lit(1.2)).cast("long").alias("axis_cap"))


def histogram(values: DataFrame, value: str = "value", bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max, last bin closed, empty bins kept.

    Width is 1 when all values are equal; no values give no bins.
    """
    span = values.agg(F.min(value).alias("_min"), F.max(value).alias("_max")).filter(F.col("_min").isNotNull())
    width = F.coalesce(F.nullif((F.col("_max") - F.col("_min")) / F.lit(float(bins)), F.lit(0.0)), F.lit(1.0))
    frame = span.select(F.lit(0).alias("_all"), "_min", width.alias("_width"))
    # distinct values first: the one-row span then meets a pre-aggregated side
    counted = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    position = F.floor((F.col(value) - F.col("_min")) / F.col("_width"))
    filled = (
        counted.withColumn("_all", F.lit(0))
        .join(F.broadcast(frame), "_all")  # a single row
        .groupBy(F.least(F.lit(bins - 1), position).cast("int").alias("bin"))
        .agg(F.sum("_c").alias("_n"))
    )
    grid = frame.select("_min", "_width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("_min") + F.col("bin") * F.col("_width")
    return grid.join(filled, "bin", "left").select(
        "bin",
        low.alias("low"),
        (low + F.col("_width")).alias("high"),
        (low + F.col("_width") / 2).alias("center"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def correlations(
    rows: DataFrame,
    value: str = "value",
    key: str = "station_code",
    ts: str = TS,
    block: int = STATION_BLOCK,
    slab: int = HOUR_SLAB,
) -> DataFrame:
    """Pearson r of every station pair over the hours both have a value.

    Works as a blocked matrix product: stations are cut into blocks, hours into
    slabs.  A task adds up the pair sums of two blocks slab by slab, so pairs
    leave it finished; only a few blocks with many slabs share a pair of blocks
    among ``parts`` tasks.  The readings of a station and slab travel as one row
    of arrays, copied once per block, not once per pair; a task holds at most two
    blocks times one slab and the sums of one pair of blocks.  Blocks have at
    least ``block`` stations.  Returns both halves and the diagonal (always 1); r
    is NULL where a pair shares no hours or one side is constant.
    """
    hour = hour_index(F.col(ts))
    slab_of = F.floor(hour / F.lit(slab)).cast("long")
    packed = cut(
        rows.filter(F.col(value).isNotNull())
        .select(
            F.col(key).alias("_station"),
            slab_of.alias("_slab"),
            F.coalesce(hour - slab_of * slab, F.lit(0)).cast("int").alias("_at"),
            F.col(value).cast("double").alias("_v"),
        )
        .groupBy("_station", "_slab")
        .agg(F.collect_list("_at").alias("_hours"), F.collect_list("_v").alias("_values"))
    )
    stations = packed.groupBy("_station").agg(
        F.min(F.array_min("_values")).alias("_shift"),
        F.sum(F.size("_values")).alias("n"),
        F.min("_slab").alias("_first"),
        F.max("_slab").alias("_last"),
    )
    size = stations.agg(F.count(F.lit(1)).alias("stations"), F.max("_last") - F.min("_first") + 1).first()
    block = max(block, min(LARGEST_BLOCK, size["stations"] // LEAST_BLOCKS))
    n_blocks = max(1, -(-size["stations"] // block))
    n_pairs = n_blocks * (n_blocks + 1) // 2
    parts = min(size[1] or 1, -(-LEAST_TASKS // n_pairs))
    # hashing keeps block membership independent of any global numbering
    member = F.pmod(F.xxhash64("_station"), F.lit(n_blocks)).cast("int")
    shifted = F.transform("_values", lambda v: F.coalesce(v - F.col("_shift"), F.lit(float("nan"))))
    own = packed.join(stations.select("_station", "_shift"), "_station", "left").select(
        "_station", "_slab", "_hours", shifted.alias("_values"), member.alias("_block")
    )
    copies = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        F.least("_block", "_other").alias("_left"),
        F.greatest("_block", "_other").alias("_right"),
        F.coalesce(F.pmod("_slab", F.lit(parts)), F.lit(0)).cast("int").alias("_part"),
        "_slab",
        (F.col("_block") <= F.col("_other")).alias("_is_left"),
        (F.col("_block") >= F.col("_other")).alias("_is_right"),
        "_station",
        "_hours",
        "_values",
    )
    group = ["_left", "_right", "_part"]
    dealt = copies.repartition(min(MOST_TASKS, n_pairs * parts), *group).sortWithinPartitions(*group, "_slab")
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = ", ".join(["a long", "b long", *[f"{c} double" for c in names]])
    total = dealt.mapInArrow(_pair_sums(slab), schema)
    if parts > 1:
        total = total.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    varies = (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)
    pairs = total.select("a", "b", n.cast("long").alias("n"), F.when(varies, cov / F.sqrt(vx * vy)).alias("r"))
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    halves = pairs.select(F.explode(both).alias("_p"), "n", "r").select("_p.a", "_p.b", "n", "r")
    diagonal = stations.select(F.col("_station").alias("a"), F.col("_station").alias("b"), "n", F.lit(1.0).alias("r"))
    return (
        halves.unionByName(diagonal)
        .select(F.col("a").alias("station_a"), F.col("b").alias("station_b"), "n", "r")
    )


def _pair_sums(width: int):
    """Sums over the common hours of each pair of stations, from rows sorted by (block, block, part, slab)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for (left, right, part, _), rows in _runs(batches, ["_left", "_right", "_part", "_slab"]):
            if sums is None or sums.group != (left, right, part):
                if sums is not None:
                    yield from sums.batches()
                sums = _BlockSums((left, right, part))
            sums.add(rows, width)
        if sums is not None:
            yield from sums.batches()

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The key of each run of rows that share it, with the slices of batches that hold the run."""
    last, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_pandas().to_numpy() for k in keys]
        moved = np.zeros(batch.num_rows, bool)
        for c in columns:
            moved[1:] |= (c[1:] != c[:-1]) & ~(pd.isna(c[1:]) & pd.isna(c[:-1]))
        starts = [0, *np.flatnonzero(moved).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if start == end:
                continue
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield last, held


class _BlockSums:
    """Running sums of all pairs of the stations of two blocks."""

    def __init__(self, group):
        self.group, self.left, self.right = group, {}, {}
        self.sums = np.zeros((6, 0, 0))

    def _dense(self, rows: pa.Table, flag: str, seen: dict, width: int):
        """Presence and values, a line per station met so far and a column per hour of the slab."""
        rows = rows.filter(rows[flag])
        line = np.array([seen.setdefault(s, len(seen)) for s in rows["_station"].to_pylist()], dtype=np.int64)
        mask, values = np.zeros((len(seen), width)), np.zeros((len(seen), width))
        if len(line):
            hours = rows["_hours"].combine_chunks()
            line = np.repeat(line, np.diff(hours.offsets.to_numpy()))
            column = hours.flatten().to_numpy()
            mask[line, column] = 1.0
            values[line, column] = rows["_values"].combine_chunks().flatten().to_numpy()
        return mask, values

    def add(self, batches: list[pa.RecordBatch], width: int) -> None:
        rows = pa.Table.from_batches(batches)
        ml, xl = self._dense(rows, "_is_left", self.left, width)
        mr, xr = self._dense(rows, "_is_right", self.right, width)
        more = [(0, 0), (0, len(ml) - self.sums.shape[1]), (0, len(mr) - self.sums.shape[2])]
        self.sums = np.pad(self.sums, more) if any(m[1] for m in more) else self.sums
        for at, (x, y) in enumerate([(ml, mr), (xl, mr), (ml, xr), (xl * xl, mr), (ml, xr * xr), (xl, xr)]):
            self.sums[at] += x @ y.T

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Pairs with a common hour; inside one block each pair shows up twice and is kept once."""
        left = pd.array(list(self.left), dtype="Int64")
        right = pd.array(list(self.right), dtype="Int64")
        lines = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for start in range(0, len(left), lines):
            sums = self.sums[:, start : start + lines]
            keep = sums[0] > 0
            if self.group[0] == self.group[1]:
                a, b = left[start : start + lines], right
                keep &= np.array([(b > x).fillna(False).to_numpy(bool) if x is not pd.NA else np.zeros(len(b), bool) for x in a])
            i, j = np.nonzero(keep)
            columns = [left.take(i + start), right.take(j)]
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(s[keep], pa.float64()) for s in sums]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])


def exceedance(values: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Count and share of values strictly above a threshold."""
    v = F.col(value)
    return values.agg(
        F.count(v).alias("n"),
        F.count_if(v > threshold).alias("n_above"),
        F.coalesce(percent(F.count_if(v > threshold), F.count(v)), F.lit(0.0)).alias("above_pct"),
    )


def status_mix(rows: DataFrame, status: str = "instrument_status") -> DataFrame:
    """Rows and share per status; rows without a status form a group of their own."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a handful of status rows
    return counts.withColumn("share_pct", percent(F.col("n"), F.sum("n").over(whole)))


def series_kpis(rows: DataFrame, threshold: float, value: str = "value", status: str = "instrument_status"):
    """Rows, missing and normal share, mean and exceedances; shares are 0 without rows."""
    n, v = F.count("*"), F.col(value)

    def share(part: Column) -> Column:
        return F.coalesce(percent(part, n), F.lit(0.0))

    return rows.agg(
        n.alias("n_rows"),
        share(F.count_if(v.isNull())).alias("missing_pct"),
        share(F.count_if(F.col(status) == STATUS_NORMAL)).alias("normal_pct"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.count_if(v > threshold).alias("n_above"),
    )


def has_data(value: Column, count: Column) -> Column:
    return value.isNotNull() & (count > 0)


def map_points(latest: DataFrame, threshold: float) -> DataFrame:
    """Map attributes per station with coordinates: flags and the value relative to the maximum."""
    known = has_data(F.col("value"), F.col("record_count"))
    top = latest.agg(F.greatest(F.lit(1e-9), F.max(F.coalesce("value", F.lit(0.0)))).alias("_top"))
    placed = latest.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (
        placed.withColumn("_all", F.lit(0))
        .join(F.broadcast(top.withColumn("_all", F.lit(0))), "_all")  # a single row
        .select(
            *latest.columns,
            F.coalesce((known & (F.col("value") > threshold)).cast("int"), F.lit(0)).alias("above"),
            known.cast("int").alias("has_data"),
            F.when(known, F.col("value") / F.col("_top")).otherwise(0.0).alias("normalized"),
        )
    )


def geo_kpis(latest: DataFrame, threshold: float) -> DataFrame:
    known = has_data(F.col("value"), F.col("record_count"))
    above = known & (F.col("value") > threshold)
    return latest.agg(
        F.count("*").alias("n_stations"),
        F.count_if(known).alias("with_data"),
        F.count_if(above).alias("above"),
        F.count_if(known & (F.col("value") <= threshold)).alias("below"),
        F.count_if(~known).alias("missing"),
        F.coalesce(F.avg(F.when(known, F.col("value"))), F.lit(0.0)).alias("mean_of_means"),
    )


def top_and_bottom(latest: DataFrame, k: int = 5) -> DataFrame:
    """The k highest stations and the k lowest, each with its rank."""
    ranked = latest.filter(has_data(F.col("value"), F.col("record_count")))
    high = ranked.orderBy(F.desc("value"), "station_code").limit(k)
    low = ranked.orderBy(F.asc("value"), F.desc("station_code")).limit(k)
    best = Window.partitionBy().orderBy(F.desc("value"), "station_code")
    worst = Window.partitionBy().orderBy(F.asc("value"), F.desc("station_code"))
    return high.select(
        F.lit("highest").alias("side"), F.row_number().over(best).alias("rank"), "station_code", "value"
    ).unionByName(
        low.select(F.lit("cleanest").alias("side"), F.row_number().over(worst).alias("rank"), "station_code", "value")
    )


def quality_kpis(missing: DataFrame, availability: DataFrame, target: float = 95.0) -> DataFrame:
    """Worst pollutant, mean availability and the number of stations below target."""
    worst = missing.agg(
        F.max_by("pollutant", "missing_pct").alias("worst_pollutant"), F.max("missing_pct").alias("worst_missing_pct")
    )
    reach = availability.agg(
        F.coalesce(F.avg("availability_pct"), F.lit(0.0)).alias("avg_availability_pct"),
        F.count_if(F.col("availability_pct") < target).alias("below_target"),
    )
    key = {"_all": F.lit(0)}
    return worst.withColumns(key).join(reach.withColumns(key), "_all").drop("_all")


def forecast_kpis(rows: DataFrame) -> DataFrame:
    width = F.col("predicted_upper_90") - F.col("predicted_lower_90")
    zero = F.lit(0.0)
    return rows.agg(
        F.count("*").alias("horizon"),
        F.coalesce(F.avg("predicted_value"), zero).alias("mean"),
        F.coalesce(F.min("predicted_value"), zero).alias("min"),
        F.coalesce(F.max("predicted_value"), zero).alias("max"),
        F.coalesce(F.avg(width), zero).alias("mean_width"),
        F.min(TS).alias("first_hour"),
        F.max(TS).alias("last_hour"),
    )


def interval_widths(rows: DataFrame) -> DataFrame:
    return rows.withColumn("width", F.col("predicted_upper_90") - F.col("predicted_lower_90"))


def anomaly_kpis(rows: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("is_anomaly") == 1)
    return rows.agg(
        F.count("*").alias("n"),
        hits.alias("anomalies"),
        F.coalesce(percent(hits, F.count("*")), F.lit(0.0)).alias("rate_pct"),
        F.greatest(F.coalesce(F.max("anomaly_score"), F.lit(0.0)), F.lit(0.0)).alias("max_score"),
    )


def score_grid(rows: DataFrame, ts: str = TS, score: str = "anomaly_score") -> DataFrame:
    """Mean score per calendar day and hour; empty cells are 0."""
    cells = rows.groupBy(month_day(F.col(ts)).alias("day"), F.hour(ts).alias("hour")).agg(F.avg(score).alias("_m"))
    days = rows.select(month_day(F.col(ts)).alias("day")).distinct()
    grid = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(cells, ["day", "hour"], "left").select(
        "day", "hour", F.round(F.coalesce("_m", F.lit(0.0)), 4).alias("score")
    )


def landing_kpis(wide: DataFrame, columns) -> DataFrame:
    """Stations, rows, first and last day, mean of each pollutant column."""
    return wide.agg(
        F.count_distinct("station_code").alias("n_stations"),
        F.count("*").alias("n_rows"),
        F.to_date(F.min(TS)).alias("first_day"),
        F.to_date(F.max(TS)).alias("last_day"),
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
    )


def forecast_summary(rows: DataFrame) -> DataFrame:
    v = "predicted_value"
    return rows.groupBy("station_code", "item_name").agg(
        F.count(v).alias("count"),
        F.round(F.avg(v), 5).alias("mean"),
        F.round(F.min(v), 5).alias("min"),
        F.round(F.max(v), 5).alias("max"),
    )


def anomaly_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("station_code", "item_name").agg(
        F.sum("is_anomaly").alias("sum"), F.count("is_anomaly").alias("count")
    )


def list_targets(rows: DataFrame) -> DataFrame:
    """Distinct (station, item) targets of a prediction table, sorted."""
    return (
        rows.groupBy("station_code", "item_code")
        .agg(F.min("item_name").alias("item_name"))
        .withColumn("key", F.concat_ws("-", "station_code", "item_code"))
        .orderBy("station_code", "item_code")
    )


def pick_target(rows: DataFrame, station_code: int | None = None, item_code: int | None = None) -> DataFrame:
    """Rows of one target; without a complete target all rows."""
    if station_code is None or item_code is None:
        return rows
    return rows.filter((F.col("station_code") == station_code) & (F.col("item_code") == item_code))


def contamination(labelled: DataFrame, keys, low: float = 0.01) -> DataFrame:
    """Share of abnormal rows per series, at least 1 %."""
    rate = F.avg((F.col("instrument_status") != STATUS_NORMAL).cast("int"))
    return (
        labelled.filter(F.col("instrument_status").isNotNull())
        .groupBy(*keys)
        .agg(rate.alias("anomaly_rate"), F.greatest(rate, F.lit(low)).alias("contamination"))
    )


