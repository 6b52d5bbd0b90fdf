"""Employee table derived from the ``orders`` table.

The original 35-column HR file is not shipped, so one employee is derived from
every order by integer arithmetic.  ``HR_RAW_SQL`` is one text that both Spark
SQL and DuckDB accept; the helper columns ``h1`` .. ``h8`` are residues that
are close to independent of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RESIDUES = """
SELECT o_orderkey AS k, o_totalprice AS tp,
       (o_orderkey * 7919 + 13) % 10007 AS h1,
       (o_orderkey * 6101 + 29) % 10009 AS h2,
       (o_orderkey * 4793 + 31) % 9973  AS h3,
       (o_orderkey * 3571 + 37) % 9967  AS h4,
       (o_orderkey * 8647 + 41) % 9949  AS h5,
       (o_orderkey * 5279 + 43) % 9941  AS h6,
       (o_orderkey * 2969 + 47) % 9931  AS h7,
       (o_orderkey * 9421 + 53) % 9929  AS h8
FROM {orders}
"""

_BASE = """
SELECT *,
       1009 + CAST(FLOOR(tp) AS BIGINT) % 18991      AS MonthlyIncome,
       LEAST(h2 % 41, h3 % 23, h4 % 31)              AS YearsAtCompany,
       CASE WHEN h6 % 7 < 2 THEN 'Yes' ELSE 'No' END AS OverTime,
       1 + h5 % 4                                    AS JobSatisfaction,
       11 + h8 % 15                                  AS PercentSalaryHike
FROM ({residues}) AS r
"""

_EMPLOYEES = """
SELECT
  18 + h1 % 43 AS Age,
  CASE WHEN (CASE WHEN OverTime = 'Yes' THEN 4 ELSE 0 END)
          + (CASE WHEN JobSatisfaction <= 2 THEN 2 ELSE 0 END)
          + (CASE WHEN YearsAtCompany <= 2 THEN 3 ELSE 0 END)
          + (CASE WHEN MonthlyIncome < 3000 THEN 2 ELSE 0 END)
          + (h4 + h8) % 13 >= 14 THEN 'Yes' ELSE 'No' END AS Attrition,
  CASE WHEN h7 % 10 < 7 THEN 'Travel_Rarely'
       WHEN h7 % 10 < 9 THEN 'Travel_Frequently' ELSE 'Non-Travel' END AS BusinessTravel,
  102 + (h1 + h2) % 1398 AS DailyRate,
  CASE WHEN h8 % 20 < 13 THEN 'Research & Development'
       WHEN h8 % 20 < 19 THEN 'Sales' ELSE 'Human Resources' END AS Department,
  1 + h2 % 29 AS DistanceFromHome,
  1 + h3 % 5 AS Education,
  CASE h4 % 6 WHEN 0 THEN 'Life Sciences' WHEN 1 THEN 'Medical' WHEN 2 THEN 'Marketing'
              WHEN 3 THEN 'Technical Degree' WHEN 4 THEN 'Human Resources'
              ELSE 'Other' END AS EducationField,
  CAST(1 AS BIGINT) AS EmployeeCount,
  k AS EmployeeNumber,
  1 + (h1 + h7) % 4 AS EnvironmentSatisfaction,
  CASE WHEN h5 % 5 < 3 THEN 'Male' ELSE 'Female' END AS Gender,
  30 + (h2 + h3) % 71 AS HourlyRate,
  1 + (h4 + h5) % 4 AS JobInvolvement,
  LEAST(5, 1 + CAST(FLOOR(MonthlyIncome / 4000.0) AS BIGINT)) AS JobLevel,
  CASE h6 % 9 WHEN 0 THEN 'Sales Executive' WHEN 1 THEN 'Research Scientist'
              WHEN 2 THEN 'Laboratory Technician' WHEN 3 THEN 'Manufacturing Director'
              WHEN 4 THEN 'Healthcare Representative' WHEN 5 THEN 'Manager'
              WHEN 6 THEN 'Sales Representative' WHEN 7 THEN 'Research Director'
              ELSE 'Human Resources' END AS JobRole,
  JobSatisfaction,
  CASE WHEN h3 % 20 < 9 THEN 'Married' WHEN h3 % 20 < 15 THEN 'Single'
       ELSE 'Divorced' END AS MaritalStatus,
  MonthlyIncome,
  2094 + (h5 + h6) % 24906 AS MonthlyRate,
  h7 % 10 AS NumCompaniesWorked,
  'Y' AS Over18,
  OverTime,
  PercentSalaryHike,
  CAST(CASE WHEN PercentSalaryHike >= 20 THEN 4 ELSE 3 END AS BIGINT) AS PerformanceRating,
  1 + (h2 + h8) % 4 AS RelationshipSatisfaction,
  CAST(80 AS BIGINT) AS StandardHours,
  (h1 + h3) % 4 AS StockOptionLevel,
  LEAST(40, YearsAtCompany + h5 % 12) AS TotalWorkingYears,
  (h3 + h7) % 7 AS TrainingTimesLastYear,
  1 + (h3 + h6) % 4 AS WorkLifeBalance,
  YearsAtCompany,
  h1 % (LEAST(YearsAtCompany, 18) + 1) AS YearsInCurrentRole,
  h7 % (LEAST(YearsAtCompany, 15) + 1) AS YearsSinceLastPromotion,
  h8 % (LEAST(YearsAtCompany, 17) + 1) AS YearsWithCurrManager
FROM ({base}) AS b
"""


def hr_raw_sql(orders: str = "orders") -> str:
    """The derivation as SQL text over a relation named ``orders``."""
    return _EMPLOYEES.format(base=_BASE.format(residues=_RESIDUES.format(orders=orders)))


HR_RAW_SQL = hr_raw_sql()


def hr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee rows over ``{sf_dir}/orders.parquet``.

    The Parquet relation is named inside the query text, so no session-wide
    temp view is needed and only ``o_orderkey`` and ``o_totalprice`` are read.
    """
    return spark.sql(hr_raw_sql(f"parquet.`{sf_dir}/orders.parquet`"))


def fixed_score() -> Column:
    """Deterministic score in [0, 1] with ties and exact tier boundaries.

    Lets evaluation and tier operators be value-checked without a fitted model.
    """
    h2 = (F.col("EmployeeNumber") * 6101 + 29) % 10009
    h5 = (F.col("EmployeeNumber") * 8647 + 41) % 9949
    bump = F.when(F.col("Attrition") == "Yes", 300).otherwise(0)
    return (F.least(F.lit(1000), (h2 + h5) % 701 + bump) / F.lit(1000.0)).cast("double")


FIXED_SCORE_SQL = (
    "LEAST(1000, ((EmployeeNumber * 6101 + 29) % 10009 + (EmployeeNumber * 8647 + 41) % 9949) % 701"
    " + CASE WHEN Attrition = 'Yes' THEN 300 ELSE 0 END) / CAST(1000 AS DOUBLE)"
)
