"""Every query that SQL can express gives the SQL's columns, types and values."""

import pytest

import __spark_entry__ as entry
from rosterlens.plans.catalog import QUERIES
from rosterlens.plans.oracle import ORACLE
from tests.compare import connect, difference
from tests.conftest import MEDIUM, SMALL

# At the smaller scale all of them; at the larger one those with boundaries that only occur there.
LARGER = ["rate_by_department", "income_quartiles", "segment_role_department_200", "stratified_split",
          "stratified_folds", "roc_auc", "roc_curve", "quartiles_of_line_prices", "roc_auc_line_prices",
          "score_labels", "tier_distribution", "income_histogram"]


@pytest.fixture(scope="module")
def small_db():
    return connect(SMALL)


@pytest.fixture(scope="module")
def medium_db():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small_db, name):
    assert difference(QUERIES[name](spark, SMALL), small_db, ORACLE[name]) is None


@pytest.mark.parametrize("name", LARGER)
def test_matches_sql_at_larger_scale(spark, medium_db, name):
    assert difference(entry.queries()[name](spark, MEDIUM), medium_db, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_the_department_report(spark):
    report = entry.entry(spark)
    assert report.columns == ["Department", "total", "attrited", "attrition_rate_pct"]
    assert report.count() == 3
