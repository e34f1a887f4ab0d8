"""Queries against their reference SQL on the smallest tables.

`python tests/compare.py sf0.01` runs all of them.
"""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "pivot_wide",
    "consistency_check",
    "dq_run_checks",
    "eda_q3_peak_hour",
    "stations_latest",
    "quality_kpis",
    "station_stats",
    "histogram",
    "corr_matrix",
    "rolling_prev",
    "stuck_run",
    "spine_fill",
    "adaptive_smoothing",
    "fold_rows",
    "seasonal_naive",
    "hour_stats",
    "knn_idw",
    "cqr",
    "pr_threshold",
    "metrics",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    equal, message = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert equal, message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
