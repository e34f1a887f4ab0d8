"""Ordered-series building blocks that never put a whole series in one task.

A series can be long, so it is cut into chunks of ``CHUNK`` consecutive
positions.  Window functions run per (series, chunk); the few rows that a frame
needs from the neighbouring chunk are copied there first (the halo), and facts
of unbounded reach (last known value, start of a run) travel as one small row
per chunk.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.calendar import hour_index, hour_to_ts
from hourloom.schemas import TS

CHUNK = 8192
SALTS = 32
#: Partitions for each of the session's shuffle partitions where many rows are sorted.
TASKS = 4


def cut(df: DataFrame) -> DataFrame:
    """Materialise on the shared checkpoint folder and drop the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="hourloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread_over(df: DataFrame) -> int:
    """Partitions for rows of which far more fit the size that AQE merges partitions up to than a task should sort.

    That size is one of compressed bytes, and rows of series and calendar columns shrink ten to a hundred times.
    Partitions that are asked for by number are not merged.
    """
    return TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def unmerged(df: DataFrame) -> Iterator[None]:
    """While a table is written, shuffles keep the session's number of partitions.

    AQE would merge them by compressed bytes: two million rows of a calendar and a few values make one task.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        yield
    finally:
        conf.set(name, before)


def complete_rows(df: DataFrame, columns) -> DataFrame:
    """Materialised rows without a NULL in the given numeric columns.

    The test becomes a stored flag.  As a filter on dozens of computed columns
    it would make the optimiser enumerate every substitution of an alias in it.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    flagged = df.withColumn("_complete", F.forall(values, lambda x: x.isNotNull()))
    return cut(flagged).filter("_complete").drop("_complete")


def chunk_of(index: Column, chunk: int = CHUNK) -> Column:
    return F.floor(index / F.lit(chunk)).cast("long")


def attach(df: DataFrame, facts: DataFrame, keys, ts: str = TS, salts: int = SALTS) -> DataFrame:
    """Left join of per-series facts that spreads a long series over many tasks.

    Rows are salted by their hour and the facts are repeated per salt, so even
    a series with a large share of all rows splits evenly.
    """
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", salt_of(ts, salts))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def attach_by_chunk(df: DataFrame, facts: DataFrame, keys, ts: str = TS, salts: int = SALTS, chunk: int = CHUNK) -> DataFrame:
    """As :func:`attach`, with the hours of a chunk in one task, so that sums per series leave few rows of a task.

    Both sides are dealt by number: the rows that AQE would put into one task take far more room than their bytes.
    """
    on, n_tasks = [*keys, "_salt"], spread_over(df)
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.coalesce(F.pmod(chunk_of(hour_index(F.col(ts)), chunk), F.lit(salts)), F.lit(0)).cast("int")
    salted = df.withColumn("_salt", salt).repartition(n_tasks, *on)
    return salted.join(copies.repartition(n_tasks, *on), on, "left").drop("_salt")


def salt_of(ts: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(ts), F.lit(salts)).cast("int")


def row_positions(df: DataFrame, keys, ts: str = TS, chunk: int = CHUNK) -> DataFrame:
    """Add ``_pos``: 0-based row number in the series.

    Rows are numbered per (series, time bucket); the bucket's first position is
    a running sum over one count per bucket.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", chunk_of(hour_index(F.col(ts)), chunk))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return (
        rows.join(starts, [*keys, "_bucket"])
        .withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def with_halo(df: DataFrame, index: str, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Copy the edge rows of every chunk to the neighbour that needs them.

    Adds ``_chunk`` (where the copy works) and ``_home`` (true for the original).
    """
    if max(before, after) > chunk:
        raise ValueError("a frame may not reach further than one chunk")
    i = F.col(index)
    home = chunk_of(i, chunk)
    offset = i - home * chunk
    first = home - (offset < after).cast("long")
    last = home + (offset >= chunk - before).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_chunk") == home)


def chunk_window(keys, index: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(index)


def over_chunks(
    df: DataFrame,
    keys,
    index: str,
    build,
    before: int,
    after: int = 0,
    chunk: int = CHUNK,
    keep_chunk: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Evaluate ``build(window)`` -> {name: Column} for every row of every series.

    ``keep_chunk`` leaves ``_chunk`` in place: rows are then still partitioned
    by (series, chunk), and a following per-chunk step needs no exchange.  With
    ``tasks`` they are dealt over so many partitions, which AQE does not merge.
    """
    framed = with_halo(df, index, before, after, chunk)
    if tasks is not None:
        framed = framed.repartition(tasks, *keys, "_chunk")
    columns = build(chunk_window(keys, index))
    out = framed.select("*", *[c.alias(n) for n, c in columns.items()]).filter("_home").drop("_home")
    return out if keep_chunk else out.drop("_chunk")


def chunk_carry(
    df: DataFrame,
    keys,
    index: str,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per (series, chunk) with facts from the chunks around it.

    ``before``: latest non-NULL value in any earlier chunk; ``after``: earliest
    non-NULL value in any later chunk.
    """
    keys, before, after = list(keys), before or {}, after or {}
    per_chunk = (
        df.withColumn("_chunk", chunk_of(F.col(index), chunk))
        .groupBy(*keys, "_chunk")
        .agg(
            *[F.max_by(c, F.when(c.isNotNull(), F.col(index))).alias(n) for n, c in before.items()],
            *[F.min_by(c, F.when(c.isNotNull(), F.col(index))).alias(n) for n, c in after.items()],
        )
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    return per_chunk.select(
        *keys,
        "_chunk",
        *[F.last(n, True).over(earlier).alias(n) for n in before],
        *[F.first(n, True).over(later).alias(n) for n in after],
    )


def fill_rows(df: DataFrame, keys, value: str, out: str | None = None, index: str = "_pos", chunk: int = CHUNK):
    """Forward fill, then backward fill, along the given row order."""
    keys, v = list(keys), F.col(value)
    carry = chunk_carry(df, keys, index, {"_carry_back": v}, {"_carry_ahead": v}, chunk)
    w = chunk_window(keys, index)
    filled = F.coalesce(
        F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.col("_carry_back"),
        F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        F.col("_carry_ahead"),
    )
    rows = df.withColumn("_chunk", chunk_of(F.col(index), chunk)).join(carry, [*keys, "_chunk"])
    return rows.withColumn(out or value, filled).drop("_chunk", "_carry_back", "_carry_ahead")


def hours_in(df: DataFrame, first: str, last: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """One row per hour index in the closed range [first, last].

    Expands chunk by chunk, so no row ever carries more than ``chunk`` hours.
    """
    spans = df.withColumn("_part", F.explode(F.sequence(chunk_of(F.col(first), chunk), chunk_of(F.col(last), chunk))))
    low = F.greatest(F.col(first), F.col("_part") * chunk)
    high = F.least(F.col(last), F.col("_part") * chunk + (chunk - 1))
    return spans.withColumn(out, F.explode(F.sequence(low, high))).drop("_part")


def held_spans(df: DataFrame, bounds: DataFrame, keys, ts: str = TS, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """The hours ``_from`` to ``_to`` that each reading holds until the next one, cut at the bounds.

    ``bounds`` has the keys plus hour indexes ``_low`` and ``_high``.  Returns them with the reading (``_at``,
    ``_v``) and the one after it (``_next``, ``_next_v``); the first reading also holds the hours before it.
    """
    keys = list(keys)
    obs = _hourly(df.filter(F.col(value).isNotNull()), keys, ts, value, "_bucket", chunk)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = (
        obs.groupBy(*keys, "_bucket")
        .agg(F.min("_at").alias("_open"), F.min_by("_v", "_at").alias("_open_v"))
        .select(
            *keys,
            "_bucket",
            F.lead("_open").over(along).alias("_then"),
            F.lead("_open_v").over(along).alias("_then_v"),
            F.lag("_bucket").over(along).isNull().alias("_leads"),
        )
        .join(bounds, keys)
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy("_at")
    return (
        obs.join(buckets, [*keys, "_bucket"])
        .select(
            *keys,
            "_low",
            "_high",
            "_at",
            "_v",
            F.coalesce(F.lead("_at").over(w), F.col("_then")).alias("_next"),
            F.coalesce(F.lead("_v").over(w), F.col("_then_v")).alias("_next_v"),
            (F.col("_leads") & (F.row_number().over(w) == 1)).alias("_first"),
        )
        .withColumn("_from", F.greatest("_low", F.when(F.col("_first"), F.col("_low")).otherwise(F.col("_at"))))
        .withColumn("_to", F.least("_high", F.coalesce(F.col("_next") - 1, F.col("_high"))))
        .filter("_from <= _to")
    )


def hold(df: DataFrame, bounds: DataFrame, keys, ts: str = TS, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """For every hour between the bounds: the last known and the next known reading.

    ``bounds`` has the keys plus hour indexes ``_low`` and ``_high`` with one
    row per series that has a value.  Returns keys, ``_hour``, the bounds,
    ``last_hour``, ``last_value`` (reading at or before the hour),
    ``next_hour``, ``next_value`` (reading after it).
    """
    keys = list(keys)
    spans = held_spans(df, bounds, keys, ts, value, chunk)
    known = F.col("_hour") >= F.col("_at")
    return hours_in(spans, "_from", "_to", "_hour", chunk).select(
        *keys,
        "_hour",
        "_low",
        "_high",
        F.when(known, F.col("_at")).alias("last_hour"),
        F.when(known, F.col("_v")).alias("last_value"),
        F.when(known, F.col("_next")).otherwise(F.col("_at")).alias("next_hour"),
        F.when(known, F.col("_next_v")).otherwise(F.col("_v")).alias("next_value"),
    )


def _hourly(df: DataFrame, keys, ts: str, value: str, bucket: str, chunk: int) -> DataFrame:
    """One row per series and hour with the mean of its readings; dealt by (series, chunk) as the windows need it."""
    rows = df.select(*keys, hour_index(F.col(ts)).alias("_at"), F.col(value).alias("_v"))
    rows = rows.withColumn(bucket, chunk_of(F.col("_at"), chunk)).repartition(spread_over(df), *keys, bucket)
    return rows.groupBy(*keys, bucket, "_at").agg(F.avg("_v").alias("_v"))


def fill_hourly(df: DataFrame, keys, ts: str = TS, value: str = "clean_value", chunk: int = CHUNK) -> DataFrame:
    """Regular hourly index per series, forward then backward filled.

    The index runs from the first to the last row of the series, rows without
    a value included; a series without any value keeps NULL in every hour.
    Several readings within one hour count as one, their mean.
    Every row simply repeats until the next one, so no index table is joined.
    """
    keys = list(keys)
    rows = _hourly(df, keys, ts, value, "_chunk", chunk)
    known = F.when(F.col("_v").isNotNull(), F.col("_at"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.min("_at").alias("_open"), F.max_by("_v", known).alias("_final"), F.min_by("_v", known).alias("_initial"))
        .select(
            *keys,
            "_chunk",
            F.lead("_open").over(along).alias("_then"),
            F.last("_final", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"),
            F.first("_initial", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"),
        )
    )
    w = chunk_window(keys, "_at")
    # dealt like the rows, which then stay where they are
    carry = carry.repartition(spread_over(df), *keys, "_chunk")
    spans = rows.join(carry, [*keys, "_chunk"]).select(
        *keys,
        "_at",
        F.coalesce(F.lead("_at").over(w) - 1, F.col("_then") - 1, F.col("_at")).alias("_to"),
        F.coalesce(
            F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.col("_back"),
            F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            F.col("_ahead"),
        ).alias(value),
    )
    return hours_in(spans, "_at", "_to", "_hour", chunk).select(*keys, hour_to_ts(F.col("_hour")).alias(ts), value)
