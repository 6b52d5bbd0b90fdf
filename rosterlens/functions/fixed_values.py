"""Names, labels and cut-offs that results have to agree on."""

from __future__ import annotations

# --- Fixed values: column names of the employee table, in model order --------

TARGET = "Attrition"
FLAG = "attrition_flag"
ID = "EmployeeNumber"

NUMERIC_FEATURES = (
    "Age", "DailyRate", "DistanceFromHome", "Education", "EnvironmentSatisfaction",
    "HourlyRate", "JobInvolvement", "JobLevel", "JobSatisfaction", "MonthlyIncome",
    "NumCompaniesWorked", "PercentSalaryHike", "PerformanceRating",
    "RelationshipSatisfaction", "StockOptionLevel", "TotalWorkingYears",
    "TrainingTimesLastYear", "WorkLifeBalance", "YearsAtCompany", "YearsInCurrentRole",
    "YearsSinceLastPromotion", "YearsWithCurrManager",
)
DERIVED_FEATURES = ("stalled_promotion_flag", "satisfaction_composite", "manager_tenure_gap")
CATEGORICAL_FEATURES = (
    "BusinessTravel", "Department", "EducationField", "Gender", "JobRole",
    "MaritalStatus", "OverTime",
)
FEATURES = NUMERIC_FEATURES + DERIVED_FEATURES + CATEGORICAL_FEATURES

# Numeric columns of the stored feature table: the model's plus MonthlyRate.
_AFTER_INCOME = NUMERIC_FEATURES.index("MonthlyIncome") + 1
STORED_NUMERIC = NUMERIC_FEATURES[:_AFTER_INCOME] + ("MonthlyRate",) + NUMERIC_FEATURES[_AFTER_INCOME:]

# Profile fields the scoring form has no input for: they always take the default.
ALWAYS_DEFAULT = (
    "DailyRate", "HourlyRate", "PercentSalaryHike", "PerformanceRating", "TrainingTimesLastYear",
)

# The eight fields shown for the employee with the highest score.
PROFILE_FIELDS = (
    "OverTime", "JobSatisfaction", "MonthlyIncome", "YearsAtCompany", "Age",
    "MaritalStatus", "WorkLifeBalance", "satisfaction_composite",
)

# --- Fixed values: employee table schema (35 columns, file order) -------------

HR_SCHEMA_DDL = """
    Age BIGINT, Attrition STRING, BusinessTravel STRING, DailyRate BIGINT, Department STRING,
    DistanceFromHome BIGINT, Education BIGINT, EducationField STRING, EmployeeCount BIGINT,
    EmployeeNumber BIGINT, EnvironmentSatisfaction BIGINT, Gender STRING, HourlyRate BIGINT,
    JobInvolvement BIGINT, JobLevel BIGINT, JobRole STRING, JobSatisfaction BIGINT,
    MaritalStatus STRING, MonthlyIncome BIGINT, MonthlyRate BIGINT, NumCompaniesWorked BIGINT,
    Over18 STRING, OverTime STRING, PercentSalaryHike BIGINT, PerformanceRating BIGINT,
    RelationshipSatisfaction BIGINT, StandardHours BIGINT, StockOptionLevel BIGINT,
    TotalWorkingYears BIGINT, TrainingTimesLastYear BIGINT, WorkLifeBalance BIGINT,
    YearsAtCompany BIGINT, YearsInCurrentRole BIGINT, YearsSinceLastPromotion BIGINT,
    YearsWithCurrManager BIGINT
"""

# --- Fixed values: bucket labels, in display order ----------------------------

AGE_GROUPS = ("Under 25", "25-34", "35-44", "45-54", "55+")
TENURE_BUCKETS = ("< 1 year", "1-2 years", "3-5 years", "6-10 years", "10+ years")
INCOME_BANDS = ("Low (< $3K)", "Mid ($3K-$7K)", "High (> $7K)")
SATISFACTION_TIERS = ("Low Satisfaction", "High Satisfaction")
PROMOTION_BUCKETS = ("Recently Promoted", "1-2 years ago", "3-5 years ago", "5+ years ago")
SATISFACTION_LABELS = {1: "1 - Low", 2: "2 - Medium", 3: "3 - High", 4: "4 - Very High"}
RISK_TIERS = ("High Risk", "Medium Risk", "Low Risk")

# --- Fixed values: rule constants ---------------------------------------------

MEDIUM_RISK = 0.30
HIGH_RISK = 0.55
LEAVE_THRESHOLD = 0.50
REPLACEMENT_FACTOR = 0.75
MIN_SEGMENT_ROWS = 15
SIGNIFICANCE = 0.05

# --- Fixed values: forest parameters ------------------------------------------

FOREST_TREES = 300
FOREST_DEPTH = 8
FOREST_MIN_LEAF = 5
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5

# --- Fixed values: reader-facing feature names --------------------------------

DISPLAY_NAMES = {
    "Age": "Age",
    "DailyRate": "Daily Rate",
    "DistanceFromHome": "Distance from Home",
    "Education": "Education Level",
    "EnvironmentSatisfaction": "Environment Satisfaction",
    "HourlyRate": "Hourly Rate",
    "JobInvolvement": "Job Involvement",
    "JobLevel": "Job Level",
    "JobSatisfaction": "Job Satisfaction",
    "MonthlyIncome": "Monthly Income ($)",
    "NumCompaniesWorked": "# Prior Companies",
    "PercentSalaryHike": "Salary Hike %",
    "PerformanceRating": "Performance Rating",
    "RelationshipSatisfaction": "Relationship Satisfaction",
    "StockOptionLevel": "Stock Option Level",
    "TotalWorkingYears": "Total Working Years",
    "TrainingTimesLastYear": "Trainings Last Year",
    "WorkLifeBalance": "Work-Life Balance",
    "YearsAtCompany": "Years at Company",
    "YearsInCurrentRole": "Years in Current Role",
    "YearsSinceLastPromotion": "Years Since Promotion",
    "YearsWithCurrManager": "Years w/ Manager",
    "stalled_promotion_flag": "Stalled Promotion (3+ yrs)",
    "satisfaction_composite": "Satisfaction Score (avg)",
    "manager_tenure_gap": "Manager Tenure Gap",
    "BusinessTravel": "Business Travel",
    "Department": "Department",
    "EducationField": "Education Field",
    "Gender": "Gender",
    "JobRole": "Job Role",
    "MaritalStatus": "Marital Status",
    "OverTime": "Works Overtime",
}
