"""Ranks, space, calibration, metrics, models and quality on small fixtures."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.operators import calibrate, evaluate, forest, models, panels, quality, quantile_trees, ranks, spatial
from hourloom.schemas import DashboardRequest, dashboard_request, item_column


@pytest.fixture(scope="module")
def values(spark):
    """Group 1 holds most rows and many ties."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.8, 1, rng.integers(2, 6, 4000)), "v": rng.integers(0, 300, 4000) / 8})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_quantiles(values):
    pdf, df = values
    wanted = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.99, "e": 1.0}
    got = ranks.quantiles(df, ["g"], "v", wanted).toPandas().set_index("g")
    for name, q in wanted.items():
        want = pdf.groupby("g")["v"].quantile(q)
        np.testing.assert_allclose(got[name].sort_index(), want, atol=1e-9)
    whole = ranks.quantiles(df, [], "v", wanted).first()
    assert abs(whole["c"] - pdf["v"].median()) < 1e-9


def test_running_totals(values):
    pdf, df = values
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = ranks.running_totals(counted, ["g"], [F.col("v")], ["n"]).toPandas().sort_values(["g", "v"])
    want = pdf.groupby(["g", "v"]).size().groupby("g").cumsum()
    assert (got["n_run"].to_numpy() == want.to_numpy()).all()


def test_conformal_rank_is_numpy_higher(spark):
    rng = np.random.default_rng(5)
    for n in (1, 5, 9, 10, 11, 200):
        y, lo, hi = rng.normal(size=n), rng.normal(size=n) - 1, rng.normal(size=n) + 1
        score = np.maximum(lo - y, y - hi)
        level = min(math.ceil(0.9 * (n + 1)) / n, 1.0)
        want = np.quantile(score, level, method="higher")
        df = spark.createDataFrame(pd.DataFrame({"k": 1, "y_true": y, "q05": lo, "q95": hi}))
        assert abs(calibrate.conformal_correction(df, ["k"]).first()["cqr"] - want) < 1e-12


def test_simplex_minimum():
    rng = np.random.default_rng(0)
    for _ in range(30):
        p = rng.normal(size=(50, 3))
        y = rng.normal(size=50)
        w = calibrate.simplex_minimum(p.T @ p / 50, p.T @ y / 50)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
        loss = np.mean((y - p @ w) ** 2)
        grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(0, 101, 4) for b in range(0, 101 - a, 4)]
        assert loss <= min(np.mean((y - p @ g) ** 2) for g in grid) + 1e-9
    same = np.ones((3, 3))
    assert abs(calibrate.simplex_minimum(same, np.ones(3)).sum() - 1) < 1e-9


def test_threshold(spark):
    rows = [(1, 1, 0.9), (1, 1, 0.8), (1, 0, 0.8), (1, 0, 0.3), (1, 1, 0.3), (1, 0, 0.1), (2, 0, 0.4), (2, 0, 0.6)]
    df = spark.createDataFrame(rows, "k long, label int, score double")
    got = {r["k"]: r["threshold"] for r in calibrate.best_f1_threshold(df, ["k"]).collect()}
    pts = {t: (sum(s >= t and y for _, y, s in rows[:6]), sum(s >= t for _, _, s in rows[:6])) for t in (0.9, 0.8, 0.3, 0.1)}
    f1 = {t: 2 * tp / (3 + n) for t, (tp, n) in pts.items()}
    assert got[1] == max(f1, key=lambda t: (round(f1[t], 9), -t))
    assert got[2] == 0.4


@pytest.mark.parametrize("layout", ["even", "cluster", "same_spot"])
def test_nearest_stations_against_brute_force(spark, layout):
    rng = np.random.default_rng(7)
    n = 60
    lat, lon = rng.uniform(37, 38, n), rng.uniform(126, 128, n)
    if layout == "cluster":
        lat[:30], lon[:30] = 37.5 + rng.normal(size=30) * 1e-4, 127 + rng.normal(size=30) * 1e-4
    if layout == "same_spot":
        lat[:30], lon[:30] = 37.5, 127.0
    pdf = pd.DataFrame({"station_code": np.arange(204, 204 + n), "latitude": lat, "longitude": lon})
    got = spatial.nearest_stations(spark.createDataFrame(pdf), 5).toPandas()
    for i in range(n):
        others = sorted((math.sqrt((lat[j] - lat[i]) ** 2 + (lon[j] - lon[i]) ** 2), 204 + j) for j in range(n) if j != i)[:5]
        mine = got[got.station_code == 204 + i].sort_values("neighbor_rank")
        assert mine["neighbor_code"].tolist() == [c for _, c in others]
        assert abs(mine["weight"].sum() - 1) < 1e-9


def test_fewer_stations_than_neighbours(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.5, 1.0), (3, 9.0, 9.0)], "station_code long, latitude double, longitude double")
    assert spatial.nearest_stations(df, 5).count() == 6


def test_correlations(spark):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(size=(300, 7)), columns=range(7))
    wide[5] = wide[4] * 2 + 1
    wide[6] = 3.0
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    long = wide.stack().reset_index()
    long.columns = ["h", "station_code", "value"]
    df = spark.createDataFrame(long).selectExpr(
        "station_code", "value", "timestamp_ntz'2021-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS measurement_datetime"
    )
    got = panels.correlations(df, block=2, slab=50).toPandas()
    assert len(got) == 49 and not got.duplicated(["station_a", "station_b"]).any()
    want = wide.corr()
    for r in got.itertuples():
        if r.station_a == r.station_b:
            assert r.r == 1.0
        elif 6 in (r.station_a, r.station_b):
            assert pd.isna(r.r)
        else:
            assert abs(r.r - want.loc[r.station_a, r.station_b]) < 1e-9


def test_correlations_leave_their_tasks_finished(spark):
    rows = spark.range(40 * 90).selectExpr(
        "id % 40 AS station_code",
        "CAST(hash(id) % 50 AS double) AS value",
        "timestamp_ntz'2021-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id DIV 40 AS int)) AS measurement_datetime",
    )
    got = panels.correlations(rows, block=3, slab=20)
    assert "hashpartitioning(a#" not in got._jdf.queryExecution().toString()  # no shuffle of pairs
    want = rows.toPandas().assign(h=lambda p: p["measurement_datetime"]).pivot(index="h", columns="station_code", values="value").corr()
    found = got.toPandas()
    assert len(found) == 1600 and (found["n"] == 90).all()
    assert all(abs(r.r - want.loc[r.station_a, r.station_b]) < 1e-9 for r in found.itertuples())


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(4.0,)] * 5 + [(None,)], "value double")
    got = panels.histogram(df, bins=4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [5, 0, 0, 0] and got[0]["high"] == 5.0
    assert panels.histogram(df.filter("value > 9"), bins=4).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0), (4.0, 3.0), (5.0, 3.0)], "y_true double, y_pred double")
    got = evaluate.forecast_metrics(df).first()
    assert abs(got["nrmse"] - 1) < 1e-12 and abs(got["r2"]) < 1e-12
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "y_true double, y_pred double")
    got = evaluate.forecast_metrics(flat).first()
    assert got["rmse"] == 1 and math.isinf(got["mape"]) and math.isinf(got["nrmse"]) and got["r2"] == 0
    band = df.selectExpr("y_true", "y_true - 0.5 AS q05", "y_true + 0.5 AS q95")
    assert evaluate.interval_metrics(band).first()["empirical_coverage"] == 1
    none = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    assert evaluate.detection_metrics(none).first()["f1_anomaly"] == 0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) + [0, 5, -2]
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, k=1, t=pd.date_range("2021-01-01", periods=400, freq="30D"))
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz"))
    fitted = models.fit_ridge(df, "y", ["k"], "t", ["a", "b", "c"], alpha=10.0).first()
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + 10 * np.eye(3), centred.T @ (y - y.mean()))
    np.testing.assert_allclose(fitted["coefficients"], want, atol=1e-9)
    assert abs(fitted["intercept"] - (y.mean() - want @ x.mean(axis=0))) < 1e-9


def forest_rows(spark, n=2000):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": 1, "t": pd.date_range("2021-01-01", periods=n, freq="h"), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[:4, ["a", "b"]] = 12.0
    return spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("whole", [4096, 100])
def test_forest_scores(spark, monkeypatch, whole):
    monkeypatch.setattr(forest, "WHOLE", whole)  # 100: the rows of each block are gathered by its draws
    df = forest_rows(spark).cache()
    rows = forest.gather(df, ["k"], "t", trees=60, size=64).groupBy("_block").agg(F.count("*").alias("n"), F.count_distinct("t").alias("d")).collect()
    assert [(r["_block"], r["n"]) for r in rows] == [(-1, 2000)] if whole == 4096 else len(rows) == 3 and all(r["n"] == r["d"] < 2000 for r in rows)
    fitted = forest.fit_forest(df, ["a", "b"], ["k"], "t", trees=60, size=64)
    assert sorted(r["trees"] for r in fitted.collect()) == ([60] if whole == 4096 else [10, 25, 25])
    assert {r["sampled"] for r in fitted.collect()} == {64}
    again = forest.fit_forest(df.repartition(7), ["a", "b"], ["k"], "t", trees=60, size=64)
    assert sorted(map(tuple, fitted.collect())) == sorted(map(tuple, again.collect()))
    scored = forest.forest_scores(df, fitted, ["a", "b"], keys=["k"], ts="t", chunk=500).toPandas().sort_values("t")
    assert len(scored) == 2000 and scored["iso_score"].between(-0.5, 0.5).all()
    assert scored["iso_score"].iloc[:5].min() > scored["iso_score"].iloc[5:].quantile(0.99)


def test_draws_do_not_depend_on_how_rows_are_gathered(spark, monkeypatch):
    df = forest_rows(spark)
    held = {}
    for whole in (4096, 100):
        monkeypatch.setattr(forest, "WHOLE", whole)
        pdf = forest.gather(df, ["k"], "t", trees=30, size=64).toPandas()
        factors, offsets = forest._lottery(30, 42)
        own = [pdf[(pdf["_block"] == -1) | (pdf["_block"] == i // forest.BLOCK)] for i in range(30)]
        held[whole] = [set(o["t"].iloc[np.argsort((o["_h"].to_numpy() * factors[i] + offsets[i]) % forest.DRAWS)[:64]]) for i, o in enumerate(own)]
    assert held[4096] == held[100] and len({frozenset(x) for x in held[100]}) == 30


def test_trees_follow_their_splits():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)), np.ones((20, 3))])  # equal rows end in one leaf
    drawn = np.array([rng.choice(len(x), 128, replace=False) for _ in range(9)])
    feature, split, depth = (v.reshape(9, -1) for v in forest.grow(x, drawn, rng, 7))

    def walk(tree, row):
        node, level = 0, 0
        while feature[tree, node] >= 0:
            node, level = 2 * node + 1 + (row[feature[tree, node]] > split[tree, node]), level + 1
        return node, level

    ends = [[walk(t, x[i])[0] for i in drawn[t]] for t in range(9)]
    for t in range(9):
        for node in set(ends[t]):
            level = int(np.log2(node + 1))
            assert depth[t, node] == pytest.approx(level + float(forest.path_length(ends[t].count(node))))
            assert level == 7 or ends[t].count(node) == 1 or len({tuple(x[i]) for i, e in zip(drawn[t], ends[t]) if e == node}) == 1
    want = [sum(depth[t, walk(t, row)[0]] for t in range(9)) for row in x]
    np.testing.assert_allclose(forest.total_depth(x, feature, split, depth), want)


def test_forest_of_one_row_and_of_constant_rows(spark):
    rows = [(1, datetime(2021, 1, 1), 1.0)] + [(2, datetime(2021, 1, 1, h), 5.0) for h in range(9)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, a double")
    got = forest.forest_scores(df, forest.fit_forest(df, ["a"], ["k"], "t", trees=3), ["a"], keys=["k"], ts="t").collect()
    assert len(got) == 10 and len({r["iso_score"] for r in got if r["k"] == 2}) == 1
    other = df.withColumn("k", F.col("k") + 5)
    assert {r["iso_score"] for r in forest.forest_scores(other, forest.fit_forest(df, ["a"], ["k"], "t", trees=3), ["a"], keys=["k"], ts="t").collect()} == {None}


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_first_trees_equal_a_shorter_fit(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (600, 2))
    y = x[:, 0] ** 2 + 0.3 * rng.normal(size=600)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y if kind == "regressor" else (y > 1).astype(float)})
    df = spark.createDataFrame(pdf)
    fit = models.fit_boosted if kind == "regressor" else models.fit_anomaly_classifier
    long, short = fit(df, "y", ["a", "b"], trees=12, depth=3), fit(df, "y", ["a", "b"], trees=5, depth=3)
    stage = models.first_trees(long.stages[-1], 5)
    assert stage.getNumTrees == 5 and stage.getFeaturesCol() == "_features" and stage.getPredictionCol() == "_prediction"
    rows = long.stages[0].transform(df)
    got, want = (m.transform(rows).orderBy("a").select("_prediction", *(["probability"] if kind == "classifier" else [])).collect() for m in (stage, short.stages[-1]))
    assert got == want
    assert models.first_trees(long.stages[-1], 12) is long.stages[-1]


def test_quality_checks_find_injected_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z")], "k long, c string")
    assert quality.not_null(df, "c").count() == 1
    assert quality.unique(df, "k").collect() == [(1, 2)]
    assert quality.accepted_values(df, "c", ["a", "b"]).count() == 1
    assert quality.accepted_values(df, "c", []).count() == 3
    parent = spark.createDataFrame([(1,)], "id long")
    assert quality.orphans(df, "k", parent, "id").count() == 1


def test_request_defaults():
    got = dashboard_request({"pollutant": "99", "stations": "210,999"})
    assert got == DashboardRequest(8, (210,), "2023-12-01T00:00:00", "2023-12-31T23:00:00")
    assert dashboard_request({"stations": "none"}).stations == ()
    assert dashboard_request({"stations": "x,1"}).stations == (212, 213, 214, 215, 216)
    assert dashboard_request({"pollutant": "0"}).item_code == 0
    with pytest.raises(ValueError):
        item_column(3)


def test_boosting_goes_on_for_small_targets(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (2000, 2))
    y = 0.01 * (np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2) + rng.normal(0, 0.0005, 2000)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})
    train, held = spark.createDataFrame(pdf[:1500]), spark.createDataFrame(pdf[1500:])
    with_part = models.fit_boosted(train, "y", ["a", "b"], held, trees=60, depth=3, step=0.1)
    assert with_part.stages[-1].getNumTrees > 50
    got = models.apply_boosted(with_part, held, "p").select(F.avg(F.pow(F.col("y") - F.col("p"), 2))).first()[0]
    assert got < 0.1 * pdf["y"][1500:].var()


def test_ridge_without_rows_is_null():
    assert models._ridge(np.zeros(20), 2, np.triu_indices(2), 1.0) == (None, None)


def test_no_weights_from_infinite_sums():
    assert calibrate.simplex_minimum(np.full((3, 3), np.inf), np.zeros(3)) is None


@pytest.mark.parametrize("level", [0.05, 0.95])
def test_quantile_trees_cover_their_share(spark, level):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (6000, 2))
    y = x[:, 0] + (0.1 + 2 * (x[:, 1] > 0.5)) * rng.normal(size=6000)  # the spread depends on b
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})
    train, held = spark.createDataFrame(pdf[:4000]), spark.createDataFrame(pdf[4000:])
    model = quantile_trees.fit_quantile_trees(train, "y", ["a", "b"], level, trees=20)
    got = quantile_trees.apply_quantile_trees(model, held, "q").toPandas()
    for wide in (False, True):
        part = got[(got["b"] > 0.5) == wide]
        assert abs((part["y"] <= part["q"]).mean() - level) < 0.035
        want = (part["a"] + (2.1 if wide else 0.1) * 1.6449 * (1 if level > 0.5 else -1)).mean()
        assert part["q"].mean() == pytest.approx(want, abs=0.35 if wide else 0.1)
    losses = quantile_trees.prefix_losses(model, held, "y")
    error = got["y"] - got["q"]
    assert losses[-1] == pytest.approx(np.maximum(level * error, (level - 1) * error).mean(), abs=1e-9)


def test_quantile_leaves_are_residual_quantiles(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 2, 500).astype(float), "y": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    model = quantile_trees.fit_quantile_trees(df, "y", ["a"], 0.95, trees=1, depth=1, step=1.0)
    far = df.withColumn("y", F.lit(model.start))  # the first tree only leads away from these
    assert len(quantile_trees.fit_quantile_trees(df, "y", ["a"], 0.95, far, trees=3, depth=1).trees) == 1
    got = quantile_trees.apply_quantile_trees(model, spark.createDataFrame(pdf), "q").toPandas()
    for a, part in got.groupby("a"):
        rank = int(np.ceil(0.95 * len(part))) - 1
        nearby = np.sort(part["y"])[rank - 1 : rank + 2]
        assert part["q"].nunique() == 1 and nearby[0] <= part["q"].iloc[0] <= nearby[-1]


def test_linked_series_fill_without_a_join_on_hours(spark):
    """Rows of one hour, rows without an hour, and no join that repeats each target hour per neighbour."""
    hours = [datetime(2021, 1, 1, h) for h in (0, 1, 1, 2, 3)] + [None]
    key = "station_code long, item_code long, measurement_datetime timestamp_ntz"
    targets = spark.createDataFrame([(1, 5, t) for t in hours], key)
    rows = [(2, 5, hours[1], 4.0), (3, 5, hours[3], 10.0), (3, 5, hours[4], 20.0)]
    readings = spark.createDataFrame(rows, f"{key}, clean_value double")
    near = spark.createDataFrame([(1, 2, 0.75), (1, 3, 0.25)], "station_code long, neighbor_code long, weight double")
    out = spatial.spatial_features(targets, readings, near)
    got = sorted((r[2].hour if r[2] else 9, r["spatial_idw_mean"], r["spatial_std"]) for r in out.collect())
    one, two = math.sqrt(18.0), math.sqrt(36.0 / 3)
    want = [(0, 5.5, one), (1, 11.0, two), (1, 11.0, two), (2, 5.5, one), (3, 8.0, math.sqrt(128.0)), (9, 0.0, None)]
    assert [(h, m) for h, m, _ in got] == [(h, m) for h, m, _ in want]
    np.testing.assert_allclose([s for *_, s in got[:-1]], [s for *_, s in want[:-1]])
    assert got[-1][2] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "_hour" in line]


@pytest.mark.parametrize("n", [1, 2, 90, 300])
def test_forest_of_a_short_series_is_kept_as_its_rows(spark, monkeypatch, n):
    df = forest_rows(spark).limit(n).cache()
    small = forest.fit_forest(df, ["a", "b"], ["k"], "t").cache()
    monkeypatch.setattr(forest, "SMALLER", 1 << 40)
    grown = forest.fit_forest(df, ["a", "b"], ["k"], "t").cache()
    row, full = small.first(), grown.first()
    assert full["feature"] is not None and full["rows"] is None
    assert (row["trees"], row["sampled"]) == (full["trees"], full["sampled"]) == (forest.FOREST_TREES, min(n, 256))
    held = sum(len(row[c] or []) for c in [*forest.TREES, *forest.ORIGIN])
    assert held <= 3 * n + 3 < len(full["split"])
    scores = [sorted(map(tuple, forest.forest_scores(df, f, ["a", "b"], keys=["k"], ts="t").select("t", "iso_score").collect())) for f in (small, grown)]
    assert len(scores[0]) == n and scores[0] == scores[1]
