"""Boundaries of the row-level rules."""

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex


def values(spark, builder, inputs, kind="long"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(builder(F.col("x"))).collect()]


@pytest.mark.parametrize("builder, inputs, expected", [
    (ex.age_group, [24, 25, 34, 35, 44, 45, 54, 55, None],
     ["Under 25", "25-34", "25-34", "35-44", "35-44", "45-54", "45-54", "55+", "55+"]),
    (ex.tenure_bucket, [0, 1, 2, 3, 5, 6, 10, 11, None, -1],
     ["< 1 year", "1-2 years", "1-2 years", "3-5 years", "3-5 years", "6-10 years", "6-10 years",
      "10+ years", "10+ years", "10+ years"]),
    (ex.income_band, [2999, 3000, 7000, 7001, None],
     ["Low (< $3K)", "Mid ($3K-$7K)", "Mid ($3K-$7K)", "High (> $7K)", "High (> $7K)"]),
    (ex.satisfaction_tier, [1, 2, 3, 4, None],
     ["Low Satisfaction", "Low Satisfaction", "High Satisfaction", "High Satisfaction", "High Satisfaction"]),
    (ex.last_promotion, [0, 1, 2, 3, 5, 6, None],
     ["Recently Promoted", "1-2 years ago", "1-2 years ago", "3-5 years ago", "3-5 years ago",
      "5+ years ago", "5+ years ago"]),
    (ex.stalled_promotion_flag, [0, 2, 3, 6, None], [0, 0, 1, 1, 0]),
    (ex.ordinal_label, [1, 4, 7, None], ["1 - Low", "4 - Very High", "7", None]),
])
def test_buckets(spark, builder, inputs, expected):
    assert values(spark, builder, inputs) == expected


def test_fractional_values_fall_through_to_the_last_bucket(spark):
    assert values(spark, ex.age_group, [34.5], "double") == ["55+"]
    assert values(spark, ex.tenure_bucket, [2.5], "double") == ["10+ years"]


def test_the_two_tier_rules_differ_on_their_boundaries(spark):
    scores = [0.0, 0.2999, 0.30, 0.3001, 0.55, 0.5501, 1.0]
    assert values(spark, ex.risk_tier_cut, scores, "double") == [
        None, "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk"]
    assert values(spark, ex.risk_tier_threshold, scores, "double") == [
        "LOW RISK", "LOW RISK", "MEDIUM RISK", "MEDIUM RISK", "HIGH RISK", "HIGH RISK", "HIGH RISK"]


def test_manager_gap_may_be_negative(spark):
    df = spark.createDataFrame([(2, 5)], "YearsAtCompany long, YearsWithCurrManager long")
    assert df.select(ex.manager_tenure_gap()).first()[0] == -3


def test_rounding_goes_half_away_from_zero(spark):
    assert values(spark, lambda x: ex.pct(x, F.lit(16)), [1]) == [6.3]
    assert values(spark, lambda x: ex.round_to(x / 40, 2), [23]) == [0.57]


def test_amounts(spark):
    amounts = [1, 999, 1000, 2500, 3500, 999_499, 1_000_000, 5_985_000, 1_015_000, 1_125_000, 245_187_207]
    expected = []
    for x in amounts:
        text = f"${x / 1e6:.2f}M" if x >= 1e6 else (f"${x / 1e3:.0f}K" if x >= 1000 else str(x))
        expected.append(text)
    assert values(spark, ex.format_amount, amounts) == expected


def test_amounts_over_every_five_thousand_dollar_tie(spark):
    amounts = list(range(1_000_000, 9_000_000, 5000))
    assert values(spark, ex.format_amount, amounts) == [f"${x / 1e6:.2f}M" for x in amounts]


def test_bucket_order_puts_unknown_labels_last(spark):
    df = spark.createDataFrame([("b",), ("zz",), ("a",), (None,)], "x string")
    ordered = df.orderBy(ex.order_of("x", ("b", "a")), "x").collect()
    assert [r[0] for r in ordered] == ["b", "a", None, "zz"]
