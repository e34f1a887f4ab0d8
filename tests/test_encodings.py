"""Encodings travel as one array per series, with the values of the table of cells."""

import math

from pyspark.sql import functions as F

from hourloom.operators import profiles
from hourloom.plans import features
from hourloom.schemas import SERIES, TS


def _rows(spark, first: int, hours: int):
    t = F.timestamp_seconds((F.col("id") + first) * 3600).cast("timestamp_ntz")
    rows = spark.range(hours).select(t.alias(TS), "id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("station_code"))
    value = F.when((F.col("station_code") < 3) & (F.col("id") % 7 != 0), (F.col("id") * 31 % 53) / 3.0 * F.col("station_code"))
    return rows.select(
        F.col("station_code").cast("long"), F.lit(2).cast("long").alias("item_code"), TS, value.alias("clean_value")
    ).localCheckpoint()


def test_arrays_hold_the_encodings_of_the_cells(spark):
    train, later = _rows(spark, 447_000, 900), _rows(spark, 450_000, 400)
    cells = profiles.join_cells(later.drop("clean_value"), profiles.encoding_table(train, later), SERIES).drop("epoch")
    arrays = profiles.encoding_arrays(train)
    found = later.drop("clean_value").join(arrays, list(SERIES)).select(
        *SERIES, TS, *[c.alias(n) for n, c in profiles.looked_up(F.col("_enc"), F.col(TS)).items()]
    )
    expected = {(r[0], r[2]): r for r in cells.select(*found.columns).collect()}
    rows = found.collect()
    assert len(rows) == len(expected) == 1200
    for r in rows:
        for a, b in zip(r[3:], expected[r[0], r[2]][3:]):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12))
    assert {r["station_code"] for r in rows if r["enc_hour"] is None} == {3}  # no value at all


def test_feature_rows_are_dealt_by_chunk_only(spark):
    rows = _rows(spark, 447_000, 900)
    plan = features.train_features(rows)[0]._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not [line for line in exchanges if "rolling" in line or "_month" in line]
    assert plan.count("MapInArrow") == 1
