"""Risk tiers over a scored table and the reports that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators.reports import compare_groups, histogram_by_class, rows, top_k

SCORE = "attrition_probability"
ACTUAL = "actual_attrition"
TIER = "risk_tier"
HIGH, MEDIUM, LOW = fv.RISK_TIERS


def assign_tiers(scored: DataFrame, score: str = SCORE) -> DataFrame:
    """Add the right-closed tier; a score of 0 belongs to none."""
    return scored.withColumn(TIER, ex.risk_tier_cut(score))


def attach(scored: DataFrame, raw: DataFrame, columns: Sequence[str], key: str = fv.ID) -> DataFrame:
    """Bring readable columns back by key.

    Needed only when the scored frame has lost them: scoring in this package
    carries them along, which costs no shuffle.
    """
    readable = raw.select(key, *columns)
    return scored.drop(*columns).join(readable, key, "left")


def high_risk(risk: DataFrame) -> DataFrame:
    return risk.where(F.col(TIER) == HIGH)


def tier_distribution(risk: DataFrame) -> DataFrame:
    """Rows and share per tier, empty tiers as 0; one global aggregation."""
    total = F.count(F.col(TIER))
    counts = risk.agg(*[F.count_if(F.col(TIER) == t).alias(t) for t in fv.RISK_TIERS], total.alias("_total"))
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(t).alias(TIER), F.col(f"`{t}`").alias("n"), ex.safe_ratio(F.col(f"`{t}`"), "_total").alias("share"))
        for t in fv.RISK_TIERS])))


def tier_actual_rate(risk: DataFrame) -> DataFrame:
    return risk.where(F.col(TIER).isNotNull()).groupBy(TIER).agg(
        rows().alias("n"), F.avg(ACTUAL).alias("actual_rate")).orderBy(F.desc("actual_rate"), TIER)


def high_risk_by_department(risk: DataFrame) -> DataFrame:
    return high_risk(risk).groupBy("Department").agg(rows().alias("n")).orderBy(F.desc("n"), "Department")


def high_risk_by_role_top(risk: DataFrame, k: int = 7) -> DataFrame:
    return top_k(high_risk(risk).groupBy("JobRole").agg(rows().alias("n")), "n", k, "JobRole")


def score_histogram(risk: DataFrame, bins: int = 20) -> DataFrame:
    return histogram_by_class(risk, SCORE, TIER, fv.RISK_TIERS, bins)


def overtime_share(risk: DataFrame) -> DataFrame:
    return compare_groups(risk, F.col(TIER) == HIGH, "OverTime")


def risk_summary(risk: DataFrame) -> DataFrame:
    """High-risk count and share, actual rates of both ends, and their ratio."""
    rate = lambda t: F.avg(F.when(F.col(TIER) == t, F.col(ACTUAL))) * 100.0
    base = risk.agg(
        F.count_if(F.col(TIER) == HIGH).alias("high_risk_count"),
        ex.safe_ratio(100.0 * F.count_if(F.col(TIER) == HIGH), rows()).alias("high_risk_pct"),
        rate(HIGH).alias("high_actual_pct"), rate(LOW).alias("low_actual_pct"))
    return base.withColumn(
        "risk_multiplier", F.col("high_actual_pct") / F.greatest(F.col("low_actual_pct"), F.lit(0.01)))


def highest_risk_profile(scored: DataFrame, fields: Sequence[str] = fv.PROFILE_FIELDS, score: str = SCORE) -> DataFrame:
    """(field, value) rows of the employee with the highest score, ties to the lowest id."""
    top = scored.orderBy(F.desc(score), fv.ID).limit(1)
    outcome = F.when(F.col(ACTUAL) == 1, "Left").otherwise("Stayed")
    pairs = [("employee", F.col(fv.ID)), ("probability_pct", ex.score_pct(score)), ("outcome", outcome),
             *[(f, F.col(f)) for f in fields]]
    return top.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), c.cast("string").alias("value")) for name, c in pairs])))
