"""Every query with SQL against DuckDB; the others must run and return rows."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from compare import same

from pricehist.plans import catalog

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()
# Checked over the larger table as well by the driver; models are in test_models.py.
SLOW = {"m2_change_model", "m3_calibration", "m4_forecast", "m9_model_importance", "m10_ablation", "m11_next_vintage", "m12_name_score", "m14_fair_price", "m15_model_prices"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    same(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in QUERIES
