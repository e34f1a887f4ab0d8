"""The trainer for large tables fits the models that Spark ML fits."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from hourloom.operators import boosting

FEATURES = ["a", "b", "c", "k"]


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.range(3000, numPartitions=3).select(
        "id", *[F.rand(i).alias(c) for i, c in enumerate("abc")], F.floor(F.rand(9) * 5).alias("k")
    )
    table = table.withColumn("y", F.sin(F.col("a") * 6) + F.col("b") * F.col("k") + F.rand(11) * 0.3)
    table = table.withColumn("flag", (F.col("c") + F.rand(12) * 0.4 > 0.7).cast("int")).localCheckpoint()
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(table)


@pytest.mark.parametrize("kind, label", [(GBTRegressor, "y"), (GBTClassifier, "flag")])
def test_equals_spark(spark, rows, kind, label):
    gbt = kind(
        featuresCol="_features", labelCol=label, predictionCol="_p", maxIter=5, maxDepth=4, stepSize=0.1,
        subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=20, seed=42,
    )
    theirs, ours = gbt.fit(rows), boosting.fit(gbt, rows, FEATURES, least=0)
    assert [t.totalNumNodes for t in [ours, theirs]] == [theirs.totalNumNodes] * 2 or kind is GBTClassifier
    scored = [m.transform(rows).orderBy("id").toPandas() for m in (theirs, ours)]
    column = "_p" if kind is GBTRegressor else "probability"
    theirs, ours = (np.stack([np.ravel(v) for v in s[column]]).astype(float) for s in scored)
    np.testing.assert_allclose(ours, theirs, atol=1e-3 if kind is GBTClassifier else 1e-9)


def test_draws_do_not_depend_on_the_blocks():
    whole = boosting.drawn(49, 0, 9000, 0.8)
    assert 0.75 < whole.mean() < 0.85
    for first, count in ((0, 1), (1, 7), (300, 5000), (8999, 1)):
        np.testing.assert_array_equal(boosting.drawn(49, first, count, 0.8), whole[first : first + count])


def test_ranges_of_ranks_are_not_merged(spark):
    """Few compressed bytes, many rows: the ranges of running totals stay as many as asked for."""
    from hourloom.operators import ranks
    from hourloom.operators.ordered import spread_over

    rows = spark.range(20000).select((F.col("id") % 100).alias("g"), (F.col("id") % 37).alias("v"))
    found = ranks.value_ranks(rows, ["g"], "v")
    assert found.rdd.getNumPartitions() == spread_over(rows)
