"""Registered queries with every group cut into small ranges: the same results as SQL."""

import pytest
from compare import assert_same
from conftest import LARGER_DIR

import __spark_entry__ as entry_point
from quotemill.operators import asof, buckets
from quotemill.plans import experiments

NAMES = [
    "pct_rank_avg", "quantile_bucket", "market_indicators", "ranking_metrics", "calibration_error",
    "evaluate_model", "asof_join_general", "asof_join_resolved_label", "asof_join_last_news",
    "profile_yearly_coverage", "shuffle_within_date_totals", "feature_ics",
]


@pytest.fixture
def small_ranges(monkeypatch):
    """Every group in ranges of 500 values, also those that callers declare bounded."""
    in_ranges, positions, statistics = buckets.in_ranges, buckets.hashed_positions, buckets.order_statistics
    for module in (buckets, asof):
        monkeypatch.setattr(module, "BOUNDED", "never")
        monkeypatch.setattr(module, "in_ranges", lambda df, by, value, limit=None: in_ranges(df, by, value, 500))
    monkeypatch.setattr(buckets, "order_statistics", lambda *args: statistics(*args[:4], 500))
    monkeypatch.setattr(experiments, "hashed_positions", lambda *args: positions(*args[:5], 500))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_when_cut(spark, duck, small_ranges, name):
    found = entry_point.queries()[name](spark, LARGER_DIR).toPandas()
    assert_same(found, duck[LARGER_DIR].execute(entry_point.oracle_sql()[name]).df())
