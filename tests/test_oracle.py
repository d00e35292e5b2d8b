"""Every registered query with an oracle equals DuckDB on the sf0.001 tables; the rest run."""

import pytest

from vitrine import registry
from vitrine.oracle.harness import compare

from .conftest import SF_SMALL

registry.load_all()
# tests/test_training.py has these, with fewer trees
SLOW = {"train_topk_classifier", "feature_importance", "train_price_regressor", "k_selection", "evaluation_report", "kpis_dashboard"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_duckdb(spark, name):
    ok, msg = compare(registry.QUERIES[name](spark, SF_SMALL), registry.ORACLES[name], SF_SMALL)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_rows_only_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
