"""Every registered query against its SQL counterpart; those without one must give rows."""

import pytest
from compare import assert_same
from conftest import LARGER_DIR, SF_DIR

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
# The smallest tables have few labeled rows, so these run on larger ones.
LARGER_MODULES = ("evaluation_queries",)
LARGER = {
    "build_metrics_dataset", "select_model_features", "prepare_model_features", "fuse_prices_news",
    "chronological_split", "walk_forward_splits", "leakage_check", "fit_classifier",
    "fit_boosted_classifier", "predict_proba", "save_model_with_metadata", "walk_forward_tune",
    "load_experiment_splits", "run_experiments", "summarize",
}


def folder_of(name):
    larger = name in LARGER or QUERIES[name].__module__.endswith(LARGER_MODULES)
    return LARGER_DIR if larger else SF_DIR


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    folder = folder_of(name)
    found = QUERIES[name](spark, folder).toPandas()
    assert_same(found, duck[folder].execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, folder_of(name)).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 5_000 and "adx" in df.columns
