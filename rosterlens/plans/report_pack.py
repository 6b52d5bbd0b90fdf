"""All segment reports from one scan.

Run one by one, the reports read the employee table a dozen times.  Here one
pass feeds every grouping: rows are expanded to the groupings inside the task
and combined there, so only a few hundred partial rows per task are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.operators import reports

GROUPINGS: dict[str, tuple[str, ...]] = {
    "workforce": (),
    "department": ("Department",),
    "age_group": ("age_group",),
    "tenure": ("tenure_bucket",),
    "satisfaction_overtime": ("satisfaction", "OverTime"),
    "role": ("JobRole",),
    "role_department": ("Department", "JobRole"),
    "marital_overtime": ("MaritalStatus", "OverTime"),
    "income_satisfaction": ("income_band", "satisfaction_tier"),
    "promotion": ("last_promotion",),
    "triple_risk_department": ("triple_risk", "Department"),
}


def _keys() -> dict[str, Column]:
    return {
        "Department": F.col("Department"), "age_group": ex.age_group(), "tenure_bucket": ex.tenure_bucket(),
        "satisfaction": F.col("JobSatisfaction").cast("string"), "OverTime": F.col("OverTime"),
        "JobRole": F.col("JobRole"), "MaritalStatus": F.col("MaritalStatus"), "income_band": ex.income_band(),
        "satisfaction_tier": ex.satisfaction_tier(), "last_promotion": ex.last_promotion(),
        "triple_risk": F.coalesce(ex.triple_risk(), F.lit(False))}


def all_segment_reports(hr: DataFrame) -> DataFrame:
    """(report, key1, key2, counts, rate, averages), one row per segment of every report."""
    keys = list(_keys())
    rows = hr.select(
        *[c.alias(name) for name, c in _keys().items()], ex.left_company().alias("_left"),
        (F.col("OverTime") == "Yes").alias("_overtime"), F.col("MonthlyIncome").alias("_income"),
        F.col("Age").alias("_age"), F.col("YearsAtCompany").alias("_tenure"), F.col("JobSatisfaction").alias("_satisfaction"))
    grouped = rows.groupingSets(list(GROUPINGS.values()), *keys).agg(
        F.grouping_id().alias("_set"),
        reports.rows().alias("total"),
        reports.hits(F.col("_left")).alias("attrited"),
        ex.pct(reports.hits(F.col("_left")), reports.rows()).alias(reports.RATE),
        reports.mean("_income", 0).alias("avg_monthly_income"),
        reports.mean("_age", 1).alias("avg_age"),
        reports.mean("_tenure", 1).alias("avg_tenure_years"),
        reports.mean("_satisfaction", 2).alias("avg_satisfaction"),
        reports.hits(F.col("_overtime")).alias("overtime_headcount"))

    report, first, second = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, group in GROUPINGS.items():
        # Bit i is set when the i-th key, from the left, is summed away.
        code = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in group)
        shown = [key for key in group if key != "triple_risk"]
        here = F.col("_set") == code
        report = F.when(here, name).otherwise(report)
        first = F.when(here, F.col(shown[0])).otherwise(first) if shown else first
        second = F.when(here, F.col(shown[1])).otherwise(second) if len(shown) > 1 else second
    kept = F.col("triple_risk").isNull() | F.col("triple_risk")
    return grouped.where(kept).select(
        report.alias("report"), first.alias("key1"), second.alias("key2"), "total", "attrited", reports.RATE,
        "avg_monthly_income", "avg_age", "avg_tenure_years", "avg_satisfaction", "overtime_headcount")
