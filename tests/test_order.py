"""The order in which reports list their rows, which a comparison of sorted rows does not see."""

import pytest

from rosterlens.operators import inference, reports
from rosterlens.sources.hr_fixture import hr_raw
from tests.conftest import SMALL

RATE = reports.RATE


@pytest.fixture(scope="module")
def hr(spark):
    return hr_raw(spark, SMALL)


@pytest.mark.parametrize("report", [reports.rate_by_department, reports.rate_by_role, reports.segment_role_department])
def test_reports_list_the_highest_rate_first(hr, report):
    rows = report(hr).collect()
    rates = [r[RATE] for r in rows]
    assert len(rows) > 1 and rates == sorted(rates, reverse=True)


def test_equal_rates_are_listed_by_key(spark):
    hr = spark.createDataFrame([(d, a) for d in ("c", "a", "b", "d") for a in (("Yes", "No") if d != "d" else ("Yes", "Yes"))],
                               "Department string, Attrition string")
    assert [r["Department"] for r in reports.rate_by(hr.repartition(4), ["Department"]).collect()] == ["d", "a", "b", "c"]


def test_odds_ratios_are_listed_from_the_largest_and_plotted_from_the_smallest(spark):
    rows = [("intercept", 9.0, 0.0), ("b", 0.5, 0.01), ("c", -1.0, 0.001), ("a", 0.5, 0.02), ("aliased", None, None), ("weak", 0.1, 0.6)]
    coefficients = spark.createDataFrame([(f, c, c, c, p) for f, c, p in rows],
                                         "feature string, coef double, ci_lower double, ci_upper double, pvalue double").repartition(4)
    odds = inference.odds_ratio_table(coefficients)
    assert [r["feature"] for r in odds.collect()] == ["a", "b", "weak", "c", "aliased"]
    assert [r["feature"] for r in inference.forest_plot_data(odds).collect()] == ["c", "a", "b"]
