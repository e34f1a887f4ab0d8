"""Versioned model store.

A version holds the pooled models once and one parameter table per kind of fact, spread over folders by a hash of the
series.  Its manifest is written last, so a version that was cut short is never seen.  Which version answers for a
series is a table (``registry``), not a walk over folders.

    <root>/<kind>/versions/<n>/<table>/part=<0..63>/...   parameter tables
    <root>/<kind>/versions/<n>/models/...                 pooled models
    <root>/<kind>/manifests/version=<n>/...               series and description, written last
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.operators.quantile_trees import QuantileTrees
from hourloom.plans.anomaly import AnomalyModel
from hourloom.plans.forecast import ForecastModel, Surroundings
from hourloom.schemas import SERIES
from hourloom.sources.readers import child_names, hadoop_exists

KINDS = ("forecast", "anomaly")
PARTS = 64
_TABLES = {
    "forecast": ("train", "ridge", "medians", "scales", "weights", "correction"),
    "anomaly": ("forest", "thresholds"),
}
_SURROUNDINGS = ("readings", "stations", "weather", "neighbours")


def _part():
    return F.pmod(F.xxhash64(*SERIES), F.lit(PARTS)).cast("int").alias("part")


def _versions(spark: SparkSession, root: str, kind: str, under: str) -> list[int]:
    names = [n.rpartition("=")[2] for n in child_names(spark, f"{root}/{kind}/{under}")]
    return sorted(int(n) for n in names if n.isdecimal())


def save_model(model: ForecastModel | AnomalyModel, root: str) -> int:
    """Write a version for all series of the model; returns its number.

    Rows of a table go to the folder of their series' part, so loading some series reads some folders.  Versions are
    never changed; one writer per kind at a time is assumed.
    """
    kind = "forecast" if isinstance(model, ForecastModel) else "anomaly"
    first = model.ridge if kind == "forecast" else model.thresholds
    spark = first.sparkSession
    version = max([0, *_versions(spark, root, kind, "versions"), *_versions(spark, root, kind, "manifests")]) + 1
    folder = f"{root}/{kind}/versions/{version}"
    for name in _TABLES[kind]:
        table = getattr(model, name)
        table.select("*", _part()).repartition("part").write.partitionBy("part").parquet(f"{folder}/{name}")
    note: dict = {"kind": kind}
    if kind == "forecast":
        model.boosted.save(f"{folder}/models/boosted")
        note |= {"features": model.features, "quantiles": {}, "surroundings": []}
        for name, trees in model.quantiles.items():
            for i, tree in enumerate(trees.trees):
                tree.save(f"{folder}/models/{name}/{i}")
            facts = {c: getattr(trees, c) for c in ("level", "features", "start", "step", "leaves")}
            note["quantiles"][name] = facts | {"trees": len(trees.trees)}
        for name in _SURROUNDINGS:
            if (table := getattr(model.surroundings, name)) is not None:
                table.write.parquet(f"{folder}/{name}")
                note["surroundings"].append(name)
    else:
        model.classifier.save(f"{folder}/models/classifier")
    series = first.select(*SERIES).distinct().withColumn("note", F.lit(json.dumps(note)))
    series.coalesce(1).write.parquet(f"{root}/{kind}/manifests/version={version}")
    return version


def registry(spark: SparkSession, root: str) -> DataFrame:
    """``(kind, station_code, item_code, version)``: the newest complete version of every series."""
    found = None
    for kind in KINDS:
        path = f"{root}/{kind}/manifests"
        complete = [v for v in _versions(spark, root, kind, "manifests") if hadoop_exists(spark, f"{path}/version={v}/_SUCCESS")]
        if not complete:
            continue
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in complete])
        rows = rows.select(F.lit(kind).alias("kind"), *SERIES, F.col("version").cast("long").alias("version"), "note")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "kind string, station_code long, item_code long, version long, note string")
    newest = Window.partitionBy("kind", *SERIES)
    return found.withColumn("_last", F.max("version").over(newest)).filter("version = _last").drop("_last")


def load_model(spark: SparkSession, root: str, kind: str, version: int, series: DataFrame | None = None) -> ForecastModel | AnomalyModel:
    """A version, for the given series only where a table of them is given (parts without any of them are not read)."""
    folder = f"{root}/{kind}/versions/{version}"
    manifest = spark.read.parquet(f"{root}/{kind}/manifests/version={version}")
    note = json.loads(manifest.select("note").first()[0])
    wanted = None if series is None else series.select(*SERIES, _part()).distinct()

    def table(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}")
        return (rows if wanted is None else rows.join(wanted, ["part", *SERIES], "left_semi")).drop("part")

    tables = {name: table(name) for name in _TABLES[kind]}
    if kind == "anomaly":
        return AnomalyModel(classifier=PipelineModel.load(f"{folder}/models/classifier"), **tables)
    quantiles = {}
    for name, facts in note["quantiles"].items():
        trees = [DecisionTreeRegressionModel.load(f"{folder}/models/{name}/{i}") for i in range(facts.pop("trees"))]
        quantiles[name] = QuantileTrees(trees=trees, **facts)
    around = Surroundings(**{n: spark.read.parquet(f"{folder}/{n}") for n in note["surroundings"]})
    boosted = PipelineModel.load(f"{folder}/models/boosted")
    return ForecastModel(boosted=boosted, features=note["features"], quantiles=quantiles, surroundings=around, **tables)


def load_models(spark: SparkSession, root: str) -> dict[tuple[str, int], ForecastModel | AnomalyModel]:
    """Every version that is the newest of some series, restricted to these series; keyed by kind and version."""
    known = registry(spark, root).cache()
    held = [(r["kind"], r["version"]) for r in known.select("kind", "version").distinct().collect()]  # one row per version
    found = {}
    for kind, version in sorted(held):
        own = known.filter((F.col("kind") == kind) & (F.col("version") == version))
        found[kind, version] = load_model(spark, root, kind, version, own)
    return found


def requested(spark: SparkSession, root: str, kind: str, requests: DataFrame) -> DataFrame:
    """Requests with the ``version`` that answers for their series; NULL where there is no model."""
    known = registry(spark, root).filter(F.col("kind") == kind).select(*SERIES, "version")
    return requests.join(known, list(SERIES), "left")
