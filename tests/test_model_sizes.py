"""The registered queries train models of the library's default size."""

import inspect

import pytest

from hourloom import catalog
from hourloom.plans import anomaly, forecast

CALLS = {
    "isolation_forest": (anomaly, "train_baseline"),
    "isolation_forest_share": (anomaly, "train_baseline"),
    "gbt_anomaly": (anomaly, "train_anomaly"),
    "gbt_anomaly_holdout": (anomaly, "train_anomaly"),
    "gbt_direct": (forecast, "train_direct"),
    "gbt_global": (forecast, "train_global"),
    "forecast_pipeline": (forecast, "train_forecast"),
}


class Reached(Exception):
    pass


@pytest.mark.parametrize("name", CALLS)
def test_default_size(spark, monkeypatch, name):
    plan, function = CALLS[name]
    signature, seen = inspect.signature(getattr(plan, function)), {}

    def train(*args, **kwargs):
        seen.update(signature.bind(*args, **kwargs).arguments)
        raise Reached

    monkeypatch.setattr(plan, function, train)
    with pytest.raises(Reached):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not {"trees", "depth", "forest_trees", "quantile_trees"} & set(seen)
