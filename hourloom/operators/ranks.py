"""Exact order statistics and running totals over groups of any size.

Rows are range-partitioned by (group, value) across the cluster, so one group
may span many partitions; a small table of totals per (group, partition) turns
partition-local running sums into group-wide ones.  The range-partitioned rows
are checkpointed, because both uses must see the same partition bounds even
when a lost executor forces a recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.operators.ordered import cut, spread_over, unmerged


def running_totals(df: DataFrame, keys, order, sums) -> DataFrame:
    """Inclusive running sum ``<s>_run`` and group total ``<s>_all`` of each column.

    ``order`` is a list of sort columns; within a group no two rows may tie.
    """
    keys, order, sums = list(keys), list(order), list(sums)
    n_tasks = spread_over(df)
    dealt = df.repartitionByRange(n_tasks, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    with unmerged(df):
        ranged = cut(dealt)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    offsets = parts.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.repartition(n_tasks, *keys, "_part").join(offsets.repartition(n_tasks, *keys, "_part"), [*keys, "_part"])
        .withColumns({f"{s}_run": F.col(f"_{s}_before") + F.sum(s).over(inside) for s in sums})
        .drop("_part", *[f"_{s}_before" for s in sums])
    )


def value_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values with the 0-based rank range [_lo, _hi) they cover and the group size ``_n``."""
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_copies"))
    ranked = running_totals(counted, keys, [F.col(value)], ["_copies"])
    return ranked.select(
        *keys, value, (F.col("_copies_run") - F.col("_copies")).alias("_lo"), F.col("_copies_run").alias("_hi"), F.col("_copies_all").alias("_n")
    )


def _at(rank: Column, value: str) -> Column:
    return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col(value)))


def order_statistics(df: DataFrame, keys, value: str, ranks: dict[str, Column]) -> DataFrame:
    """The value at each 0-based rank; ranks are columns of the group size ``_n``."""
    keys = list(keys)
    return value_ranks(df, keys, value).groupBy(*keys).agg(*[_at(r, value).alias(n) for n, r in ranks.items()])


def quantiles(df: DataFrame, keys, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; a global call uses no keys."""
    keys = list(keys)
    source, group = df, keys
    if not keys:
        source, group = df.withColumn("_whole", F.lit(0)), ["_whole"]
    aggregates = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        base = F.floor(at)
        aggregates += [
            _at(base, value).alias(f"_{name}_low"),
            _at(base + 1, value).alias(f"_{name}_high"),
            F.max(at - base).alias(f"_{name}_rest"),
        ]
    picked = value_ranks(source, group, value).groupBy(*group).agg(*aggregates)
    return picked.select(
        *keys,
        *[
            F.coalesce(
                F.col(f"_{n}_low") + F.col(f"_{n}_rest") * (F.col(f"_{n}_high") - F.col(f"_{n}_low")),
                F.col(f"_{n}_low"),
            ).alias(n)
            for n in wanted
        ],
    )
