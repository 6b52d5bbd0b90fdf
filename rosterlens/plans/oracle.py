"""Independent SQL for the queries of the catalog, in DuckDB's dialect.

Written by hand from the definitions, not generated from the Spark code.  Sums
of integers are cast to BIGINT and ratios are taken in DOUBLE, so that types
match Spark's.
"""

from __future__ import annotations

from rosterlens.functions import fixed_values as fv
from rosterlens.sources.hr_fixture import FIXED_SCORE_SQL, HR_RAW_SQL

_HR = f"hr AS ({HR_RAW_SQL})"

_AGE = """CASE WHEN Age < 25 THEN 'Under 25' WHEN Age BETWEEN 25 AND 34 THEN '25-34'
 WHEN Age BETWEEN 35 AND 44 THEN '35-44' WHEN Age BETWEEN 45 AND 54 THEN '45-54' ELSE '55+' END"""
_TENURE = """CASE WHEN YearsAtCompany = 0 THEN '< 1 year' WHEN YearsAtCompany BETWEEN 1 AND 2 THEN '1-2 years'
 WHEN YearsAtCompany BETWEEN 3 AND 5 THEN '3-5 years' WHEN YearsAtCompany BETWEEN 6 AND 10 THEN '6-10 years'
 ELSE '10+ years' END"""
_INCOME = """CASE WHEN MonthlyIncome < 3000 THEN 'Low (< $3K)'
 WHEN MonthlyIncome BETWEEN 3000 AND 7000 THEN 'Mid ($3K-$7K)' ELSE 'High (> $7K)' END"""
_SATISFACTION = "CASE WHEN JobSatisfaction IN (1, 2) THEN 'Low Satisfaction' ELSE 'High Satisfaction' END"
_PROMOTION = """CASE WHEN YearsSinceLastPromotion = 0 THEN 'Recently Promoted'
 WHEN YearsSinceLastPromotion BETWEEN 1 AND 2 THEN '1-2 years ago'
 WHEN YearsSinceLastPromotion BETWEEN 3 AND 5 THEN '3-5 years ago' ELSE '5+ years ago' END"""
_STALLED = "CASE WHEN YearsSinceLastPromotion >= 3 THEN 1 ELSE 0 END"
_COMPOSITE = """round((JobSatisfaction + EnvironmentSatisfaction + RelationshipSatisfaction + WorkLifeBalance)
 / CAST(4 AS DOUBLE) * 100) / 100"""
_DERIVED = f"""{_STALLED} AS stalled_promotion_flag, {_COMPOSITE} AS satisfaction_composite,
 YearsAtCompany - YearsWithCurrManager AS manager_tenure_gap"""
_LEFT = "count(*) FILTER (WHERE Attrition = 'Yes')"
_RATE = f"round(CAST({_LEFT} AS DOUBLE) * 100 / count(*) * 10) / 10 AS attrition_rate_pct"
_TRIPLE = "OverTime = 'Yes' AND JobSatisfaction <= 2 AND YearsAtCompany <= 2"
_FLAG = "CAST(Attrition = 'Yes' AS INTEGER)"


def _avg(column: str, digits: int, name: str) -> str:
    scale = 10**digits
    return f"round(avg({column}) * {scale}) / CAST({scale} AS DOUBLE) AS {name}"


def _hr(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_HR, *ctes]) + "\n" + body


def _list(columns) -> str:
    return ", ".join(columns)


def _r(expression: str, digits: int) -> str:
    return f"round(({expression}) * 1e{digits}) / 1e{digits}"


_FEATURES = f"""features AS (SELECT EmployeeNumber, Attrition, {_FLAG} AS attrition_flag, {_list(fv.STORED_NUMERIC)},
 {_TENURE} AS tenure_bucket, {_INCOME} AS income_band, {_DERIVED}, {_list(fv.CATEGORICAL_FEATURES)} FROM hr)"""
_MODEL = f"""model AS (SELECT EmployeeNumber, {_FLAG} AS attrition_flag, {_list(fv.NUMERIC_FEATURES)}, {_DERIVED},
 {_list(fv.CATEGORICAL_FEATURES)} FROM hr)"""
_GAPS = """gaps AS (SELECT * REPLACE (
 CASE WHEN JobSatisfaction > 1 THEN JobSatisfaction END AS JobSatisfaction,
 CASE WHEN Department <> 'Sales' THEN Department END AS Department,
 CASE WHEN MonthlyIncome >= 5000 THEN MonthlyIncome END AS MonthlyIncome,
 CASE WHEN Age > 30 THEN Over18 END AS Over18,
 CASE WHEN Age <> 40 THEN Age END AS Age,
 CASE WHEN YearsAtCompany <> 4 THEN YearsAtCompany END AS YearsAtCompany,
 CASE WHEN YearsSinceLastPromotion <> 2 THEN YearsSinceLastPromotion END AS YearsSinceLastPromotion,
 CAST(NULL AS BIGINT) AS StandardHours) FROM hr)"""
_ALL_COLUMNS = [part.split()[0] for part in fv.HR_SCHEMA_DDL.split(",")]
_SCORED = f"""scored AS (SELECT *, CAST(s >= 0.5 AS INTEGER) AS predicted
 FROM (SELECT *, {_FLAG} AS y, {FIXED_SCORE_SQL} AS s FROM hr) AS t)"""
_TIER_CUT = """CASE WHEN s <= 0 THEN NULL WHEN s <= 0.3 THEN 'Low Risk' WHEN s <= 0.55 THEN 'Medium Risk'
 WHEN s <= 1 THEN 'High Risk' END"""
_RISK = f"risk AS (SELECT *, {_TIER_CUT} AS tier, {_DERIVED} FROM scored)"


def _folds_sql(source: str, id_column: str, label: str, k: int, seed: int) -> str:
    """Fold sizes from position counts; rows in MD5 order fill the folds one after another."""
    return f"""
 , ordered AS (SELECT {id_column} AS id, {label} AS y, count(*) OVER (PARTITION BY {label}) AS n,
     row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({id_column} AS VARCHAR) || ':{seed}'), {id_column}) AS rn
   FROM {source}),
 placed AS (SELECT *, CASE WHEN y = 0 THEN 0 ELSE (SELECT count(*) FROM {source} WHERE {label} = 0) END AS start FROM ordered),
 sizes AS (SELECT y, f, count(*) AS size FROM (
     SELECT y, (start + p) % {k} AS f FROM (SELECT y, start, unnest(range(n)) AS p
       FROM (SELECT DISTINCT y, start, n FROM placed) AS c) AS e) AS g GROUP BY y, f),
 bounds AS (SELECT y, f, sum(size) OVER (PARTITION BY y ORDER BY f) AS upto FROM sizes)
 SELECT id AS {id_column}, y AS {label}, CAST((SELECT min(f) FROM bounds AS b WHERE b.y = placed.y AND b.upto >= rn) AS INTEGER) AS fold
 FROM placed"""


_SPLIT = f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY attrition_flag) AS n,
   row_number() OVER (PARTITION BY attrition_flag ORDER BY md5(CAST(EmployeeNumber AS VARCHAR) || ':42'), EmployeeNumber) AS rn
   FROM model),
 total AS (SELECT count(*) AS everyone, CAST(ceil(count(*) * 0.2) AS BIGINT) AS wanted FROM model),
 class AS (SELECT attrition_flag AS y, n * wanted // everyone AS whole, n * wanted % everyone AS rest, wanted
   FROM (SELECT DISTINCT attrition_flag, n FROM ranked) AS c, total),
 quota AS (SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS test_rows
   FROM class),
 split AS (SELECT ranked.*, CASE WHEN rn <= test_rows THEN 'test' ELSE 'train' END AS side
   FROM ranked JOIN quota ON ranked.attrition_flag = quota.y)"""

_EXPLAINED_NAMES = fv.NUMERIC_FEATURES + fv.DERIVED_FEATURES
_SHAP = f"""shap AS (SELECT EmployeeNumber, feature, value,
   ((EmployeeNumber * (7919 + 2 * i) + i * 131) % 2001 - 1000) / CAST(10000 AS DOUBLE) AS shap
   FROM (SELECT EmployeeNumber, unnest([{", ".join(f"'{f}'" for f in _EXPLAINED_NAMES)}]) AS feature,
     unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in _EXPLAINED_NAMES)}]) AS value,
     unnest(range(1, {len(_EXPLAINED_NAMES) + 1})) AS i FROM model) AS u)"""
_STRENGTH = f"""strength AS (SELECT *, row_number() OVER (PARTITION BY EmployeeNumber ORDER BY abs(shap) DESC, feature) AS rn
   FROM shap)"""
_NAMES_CASE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.DISPLAY_NAMES.items()) + " ELSE {c} END"

_DEFAULT_ROWS = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS num_value, CAST(NULL AS VARCHAR) AS cat_value FROM model"
     for c in fv.NUMERIC_FEATURES]
    + [f"SELECT '{c}', NULL, (SELECT {c} FROM model GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
       for c in fv.CATEGORICAL_FEATURES]
    + [f"SELECT '{c}', NULL, NULL" for c in fv.DERIVED_FEATURES])
_OPEN = {"Age": 3, "MonthlyIncome": 5, "JobRole": 7, "OverTime": 11}
_PROFILES = "profiles AS (SELECT EmployeeNumber AS profile_id, " + ", ".join(
    f"CASE WHEN EmployeeNumber % {_OPEN[c]} <> 0 THEN {c} END AS {c}" if c in _OPEN else c
    for c in fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES) + " FROM hr)"


def _filled(c: str) -> str:
    default = (f"(SELECT {'cat_value' if c in fv.CATEGORICAL_FEATURES else 'num_value'} FROM defaults WHERE feature = '{c}')")
    if c in fv.ALWAYS_DEFAULT:
        return f"{default} AS {c}"
    return f"coalesce({c if c in fv.CATEGORICAL_FEATURES else f'CAST({c} AS DOUBLE)'}, {default}) AS {c}"


_FILLED = "filled AS (SELECT profile_id, " + ", ".join(
    _filled(c) for c in fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES) + " FROM profiles)"

_ROLE = """role AS (SELECT JobRole AS feature, count(*) FILTER (WHERE Attrition = 'Yes') AS a FROM hr GROUP BY JobRole),
 coefs AS (SELECT feature, (a % 41 - 20) / CAST(10 AS DOUBLE) AS coef,
   CASE WHEN a % 5 <> 0 THEN (a % 20) / CAST(200 AS DOUBLE) END AS pvalue FROM role)"""

_LABEL_CODES = {c: f"codes_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
                   f"FROM (SELECT DISTINCT {c} FROM hr) AS d)" for c in fv.CATEGORICAL_FEATURES}
_CODE_JOINS = " ".join(f"JOIN codes_{c} ON model.{c} = codes_{c}.v" for c in fv.CATEGORICAL_FEATURES)

_CURVE = """curve AS (SELECT s, sum(count(*) FILTER (WHERE y = 1)) OVER w AS tp, sum(count(*) FILTER (WHERE y = 0)) OVER w AS fp,
   count(*) FILTER (WHERE y = 1) AS p1, count(*) FILTER (WHERE y = 0) AS n1 FROM scored GROUP BY s WINDOW w AS (ORDER BY s DESC)),
 steps AS (SELECT *, lead(p1) OVER (ORDER BY s DESC) AS p2, lead(n1) OVER (ORDER BY s DESC) AS n2,
   row_number() OVER (ORDER BY s DESC) AS i, (SELECT count(*) FROM scored WHERE y = 1) AS p, (SELECT count(*) FROM scored WHERE y = 0) AS n
   FROM curve)"""
_START = "SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL "
_POINT = f"SELECT s, {_r('CAST(fp AS DOUBLE) / n', 9)}, {_r('CAST(tp AS DOUBLE) / p', 9)} FROM steps"

_CONFUSION = """cells AS (SELECT CAST(count(*) FILTER (WHERE y = 0 AND predicted = 0) AS DOUBLE) AS tn,
   CAST(count(*) FILTER (WHERE y = 0 AND predicted = 1) AS DOUBLE) AS fp,
   CAST(count(*) FILTER (WHERE y = 1 AND predicted = 0) AS DOUBLE) AS fn,
   CAST(count(*) FILTER (WHERE y = 1 AND predicted = 1) AS DOUBLE) AS tp FROM scored),
 per AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
   tn + fp AS s0, tp + fn AS s1, (tn + tp) / (tn + fp + fn + tp) AS acc FROM cells),
 f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM per)"""


def _histogram(source: str, by: str, column: str, classes: str, bins: int, name: str) -> str:
    """Bins by comparison with the edges; the last bin is closed."""
    return f"""
 , span AS (SELECT {by} AS c, CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {source}
     WHERE {by} IN ({classes}) GROUP BY {by}),
 edges AS (SELECT c, lo, hi, b, b * ((hi - lo) / {bins}) + lo AS e0,
     CASE WHEN b = {bins - 1} THEN hi ELSE (b + 1) * ((hi - lo) / {bins}) + lo END AS e1
     FROM span, (SELECT unnest(range({bins})) AS b) AS r),
 counted AS (SELECT {by} AS c, CAST({column} AS DOUBLE) AS v, count(*) AS n FROM {source} GROUP BY 1, 2)
 SELECT edges.c AS {name}, CAST(b AS INTEGER) AS bin, {_r('e0', 6 if bins == 25 else 9)} AS bin_start,
   {_r('e1', 6 if bins == 25 else 9)} AS bin_end, CAST(coalesce(sum(counted.n), 0) AS BIGINT) AS n
 FROM edges LEFT JOIN counted ON edges.c = counted.c AND v >= e0 AND (v < e1 OR (b = {bins - 1} AND v <= hi))
 GROUP BY edges.c, b, e0, e1"""


def _shares(column: str, everyone: str, subset: str) -> str:
    return f"""SELECT coalesce(a.v, b.v) AS {column}, coalesce(a.n, 0) AS n_all, coalesce(b.n, 0) AS n_subset,
 {_r('coalesce(100.0 * a.n / (SELECT count(*) FROM ' + everyone + '), 0)', '{d}')} AS pct_all,
 {_r('coalesce(100.0 * b.n / (SELECT count(*) FROM ' + subset + '), 0)', '{d}')} AS pct_subset
 FROM (SELECT {column} AS v, count(*) AS n FROM {everyone} GROUP BY 1) AS a
 FULL JOIN (SELECT {column} AS v, count(*) AS n FROM {subset} GROUP BY 1) AS b ON a.v = b.v"""


ORACLE: dict[str, str] = {
    # sources, sinks, catalog
    "read_csv_with_schema": _hr("SELECT * FROM hr"),
    "read_csv_inferred": _hr(f"SELECT Department, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY 1"),
    "read_first_available": "SELECT c_custkey, c_mktsegment FROM customer",
    "registered_view_sql": _hr("SELECT EducationField, count(*) AS total, avg(Age) AS avg_age FROM hr GROUP BY 1"),
    "stored_feature_table": _hr("SELECT * FROM features", _FEATURES),
    "saved_defaults": _hr(_DEFAULT_ROWS, _MODEL),
    "saved_feature_order": "SELECT * FROM (VALUES " + ", ".join(
        f"(CAST({i} AS INTEGER), '{f}')" for i, f in enumerate(fv.FEATURES)) + ") AS t(position, feature)",
    "written_report": _hr(f"""SELECT JobRole, count(*) AS total, {_LEFT} AS attrited, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_monthly_income')}, {_avg('JobSatisfaction', 2, 'avg_satisfaction')} FROM hr GROUP BY 1"""),

    # profiling
    "null_counts": _hr(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM gaps HAVING count(*) > count({c})"
        for c in _ALL_COLUMNS), _GAPS),
    "constant_columns": _hr(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(any_value({c}) AS VARCHAR) AS value FROM gaps HAVING count(DISTINCT {c}) = 1"
        for c in _ALL_COLUMNS), _GAPS),
    "null_counts_lineitem": """SELECT 'l_discount' AS "column", count(*) FILTER (WHERE l_discount = 0) AS nulls FROM lineitem
        UNION ALL SELECT 'l_linestatus', count(*) FILTER (WHERE l_linestatus = 'F') FROM lineitem""",
    "value_counts": _hr("""SELECT Department, count(*) AS n,
        CAST(count(*) AS DOUBLE) / (SELECT count(Department) FROM gaps) AS share
        FROM gaps WHERE Department IS NOT NULL GROUP BY 1""", _GAPS),
    "feature_validation": _hr("""SELECT count(*) AS total_rows, count(DISTINCT EmployeeNumber) AS unique_employees,
        CAST(sum(attrition_flag) AS BIGINT) AS total_attrition,
        round(CAST(sum(attrition_flag) AS DOUBLE) * 100 / count(*) * 10) / 10 AS attrition_rate_pct FROM features""", _FEATURES),
    "class_balance": _hr(f"""SELECT count(*) - {_LEFT} AS stayed, {_LEFT} AS "left",
        CAST({_LEFT} AS DOUBLE) / count(*) AS rate FROM hr"""),
    "class_balance_by_split": _hr("""SELECT side AS split, count(*) FILTER (WHERE attrition_flag = 0) AS stayed,
        count(*) FILTER (WHERE attrition_flag = 1) AS "left", avg(attrition_flag) AS rate FROM split GROUP BY 1""", _MODEL, _SPLIT),
    "class_balance_labels": """SELECT quality, count(*) FILTER (WHERE toxic = 0) AS stayed,
        count(*) FILTER (WHERE toxic = 1) AS "left", avg(toxic) AS rate FROM labels GROUP BY 1""",
    "table_shape": "SELECT count(*) AS n_rows, CAST(38 AS INTEGER) AS n_columns FROM orders",

    # expressions
    "scalar_features": _hr(f"""SELECT EmployeeNumber, {_FLAG} AS attrition_flag, {_AGE} AS age_group, {_TENURE} AS tenure_bucket,
        {_INCOME} AS income_band, {_SATISFACTION} AS satisfaction_tier, {_PROMOTION} AS last_promotion, {_DERIVED},
        ['1 - Low', '2 - Medium', '3 - High', '4 - Very High'][WorkLifeBalance] AS balance_label,
        ifnull(Department, 'nan') AS department_text FROM gaps""", _GAPS),
    "score_labels": _hr(f"""SELECT EmployeeNumber, {_TIER_CUT} AS tier_cut,
        CASE WHEN s >= 0.55 THEN 'HIGH RISK' WHEN s >= 0.3 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS tier_threshold,
        CASE WHEN s >= 0.5 THEN 'likely to leave' ELSE 'likely to stay' END AS verdict,
        round(s * 100 * 10) / 10 AS score_pct,
        CASE WHEN s - 0.5 > 0 THEN 'increases' ELSE 'reduces' END AS direction
        FROM (SELECT EmployeeNumber, CASE WHEN EmployeeNumber % 13 <> 0 THEN s END AS s FROM scored) AS t""", _SCORED),
    "scalar_arithmetic": _hr(f"""SELECT EmployeeNumber, {_r('MonthlyIncome / CAST(12 AS DOUBLE)', 2)} AS weekly,
        abs(MonthlyIncome - 10000) AS distance, {_r('exp(MonthlyIncome / CAST(20000 AS DOUBLE))', 6)} AS exp_income,
        CASE WHEN StockOptionLevel = 0 THEN -1 ELSE StockOptionLevel END AS stock_or_default FROM hr"""),
    "amount_labels": _hr("""SELECT EmployeeNumber,
        CASE WHEN y >= 1e6 THEN format('${:.2f}M', y / 1e6) ELSE format('${:.0f}K', y / 1e3) END AS yearly_text,
        format('${:.0f}K', m / 1e3) AS monthly_text, CAST(Age AS VARCHAR) AS age_text
        FROM (SELECT *, CAST(MonthlyIncome * 12 * JobLevel * JobLevel AS DOUBLE) AS y, CAST(MonthlyIncome AS DOUBLE) AS m FROM hr) AS t"""),
    "severity_by_tenure": _hr(f"""SELECT *, CASE WHEN attrition_rate_pct >= 20 THEN 'high' WHEN attrition_rate_pct >= 15 THEN 'medium'
        ELSE 'low' END AS severity FROM (SELECT {_TENURE} AS tenure_bucket, {_RATE} FROM hr GROUP BY 1) AS t"""),
    "feature_table": _hr("SELECT * FROM features", _FEATURES),
    "model_frame": _hr("SELECT * FROM model", _MODEL),
    "feature_columns": _hr(" UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, {_r(f'avg({c})', 6)} AS mean_value, "
        f"'{fv.DISPLAY_NAMES[c]}' AS label FROM model"
        for i, c in enumerate(fv.NUMERIC_FEATURES + fv.DERIVED_FEATURES)), _MODEL),

    # filters and joins
    "triple_risk_employees": _hr(f"SELECT EmployeeNumber, Department, JobRole, MonthlyIncome, Attrition FROM hr WHERE {_TRIPLE}"),
    "filter_forms": _hr("""SELECT EducationField, count(*) AS n, max(Age) AS oldest FROM hr WHERE Age >= 30 AND Age <= 40
        AND (EducationField = 'Medical' OR EducationField = 'Other') AND Gender = 'Female' AND DistanceFromHome > 10 GROUP BY 1"""),
    "attach_by_key": _hr("SELECT EmployeeNumber, s AS score, Department, JobRole, OverTime FROM scored", _SCORED),
    "department_with_baseline": _hr(f"""SELECT *, round((attrition_rate_pct - overall_rate_pct) * 10) / 10 AS gap_pct
        FROM (SELECT Department, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY 1) AS d,
        (SELECT {_RATE.replace('attrition_rate_pct', 'overall_rate_pct')} FROM hr) AS o"""),
    "marital_status_of_triple_risk": _hr(
        _shares("MaritalStatus", "hr", "triple").replace("{d}", "6"), f"triple AS (SELECT * FROM hr WHERE {_TRIPLE})"),

    # reports
    "workforce_snapshot": _hr(f"""SELECT count(*) AS total_employees, {_LEFT} AS attrited, count(*) - {_LEFT} AS retained, {_RATE},
        {_avg('Age', 1, 'avg_age')}, {_avg('MonthlyIncome', 0, 'avg_monthly_income')},
        {_avg('YearsAtCompany', 1, 'avg_tenure_years')} FROM hr"""),
    "rate_by_department": _hr(f"SELECT Department, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY ALL"),
    "rate_by_age_group": _hr(f"SELECT {_AGE} AS age_group, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY ALL"),
    "rate_by_tenure": _hr(f"""SELECT {_TENURE} AS tenure_bucket, count(*) AS total, {_LEFT} AS attrited, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_monthly_income')} FROM hr GROUP BY ALL"""),
    "rate_by_satisfaction_overtime": _hr(
        f"SELECT JobSatisfaction, OverTime, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY ALL"),
    "rate_by_satisfaction_overtime_short": _hr(
        f"SELECT JobSatisfaction, OverTime, count(*) AS total, {_RATE} FROM hr GROUP BY ALL"),
    "rate_by_role": _hr(f"""SELECT JobRole, count(*) AS total, {_LEFT} AS attrited, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_monthly_income')}, {_avg('JobSatisfaction', 2, 'avg_satisfaction')} FROM hr GROUP BY ALL"""),
    "income_quartiles": _hr("""SELECT Attrition, CAST(min(MonthlyIncome) AS DOUBLE) AS min_income,
        round(quantile_cont(MonthlyIncome, 0.25)) AS q1_income, round(quantile_cont(MonthlyIncome, 0.5)) AS median_income,
        round(quantile_cont(MonthlyIncome, 0.75)) AS q3_income, CAST(max(MonthlyIncome) AS DOUBLE) AS max_income,
        round(avg(MonthlyIncome)) AS avg_income FROM hr GROUP BY ALL"""),
    "median_by_class": _hr("SELECT Attrition, median(MonthlyIncome) AS median FROM hr GROUP BY ALL"),
    "quartiles_of_line_prices": f"""SELECT l_returnflag, {_r('quantile_cont(l_extendedprice, 0.25)', 4)} AS q1,
        {_r('median(l_extendedprice)', 4)} AS median, {_r('quantile_cont(l_extendedprice, 0.75)', 4)} AS q3 FROM lineitem GROUP BY ALL""",
    "rate_by_marital_overtime": _hr(f"""SELECT MaritalStatus, OverTime, count(*) AS total, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_income')} FROM hr GROUP BY ALL"""),
    "rate_by_income_satisfaction": _hr(
        f"SELECT {_INCOME} AS income_band, {_SATISFACTION} AS satisfaction_tier, count(*) AS total, {_RATE} FROM hr GROUP BY ALL"),
    "promotion_stagnation": _hr(f"""SELECT {_PROMOTION} AS last_promotion, count(*) AS total, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_income')} FROM hr GROUP BY ALL"""),
    "triple_risk_by_department": _hr(f"""SELECT Department, count(*) AS high_risk_employees, {_avg('MonthlyIncome', 0, 'avg_income')},
        {_avg('Age', 1, 'avg_age')} FROM hr WHERE {_TRIPLE} GROUP BY ALL"""),
    "triple_risk_outcome": _hr(f"""SELECT Department, count(*) AS employees_at_triple_risk,
        {_avg('MonthlyIncome', 0, 'avg_monthly_income')}, {_avg('Age', 1, 'avg_age')}, {_LEFT} AS actually_left
        FROM hr WHERE {_TRIPLE} GROUP BY ALL"""),
    "triple_risk_total": _hr(f"""SELECT count(*) AS total_triple, {_LEFT} AS left_triple,
        round(CAST({_LEFT} AS DOUBLE) * 100 / count(*)) AS left_pct FROM hr WHERE {_TRIPLE}"""),
    "stacked_headcount": _hr(f"""SELECT Department, {_LEFT} AS "left", count(*) - {_LEFT} AS stayed FROM hr GROUP BY ALL"""),
    "role_bubble": _hr(f"""SELECT JobRole, {_avg('MonthlyIncome', 0, 'avg_monthly_income')}, {_avg('JobSatisfaction', 2, 'avg_satisfaction')},
        {_RATE}, count(*) * 5 AS bubble_size FROM hr GROUP BY ALL"""),
    "heat_pivot": _hr(f"""SELECT ['1 - Low', '2 - Medium', '3 - High', '4 - Very High'][JobSatisfaction] AS satisfaction,
        max(attrition_rate_pct) FILTER (WHERE OverTime = 'No') AS "No", max(attrition_rate_pct) FILTER (WHERE OverTime = 'Yes') AS "Yes"
        FROM (SELECT JobSatisfaction, OverTime, {_RATE} FROM hr GROUP BY ALL) AS t GROUP BY JobSatisfaction"""),
    "replacement_cost": _hr(f"""SELECT leavers, {_r('each', 2)} AS cost_per_leaver, {_r('each * leavers', 2)} AS total_cost,
        format('${{:.0f}}K', each / 1e3) AS cost_per_leaver_text, format('${{:.2f}}M', each * leavers / 1e6) AS total_cost_text
        FROM (SELECT count(*) AS leavers, avg(MonthlyIncome) * 12 * CAST(0.75 AS DOUBLE) AS each FROM hr WHERE Attrition = 'Yes') AS t"""),
    "segment_role_department": _hr("SELECT * FROM segment WHERE headcount >= 15", f"""segment AS (SELECT Department, JobRole,
        count(*) AS headcount, {_LEFT} AS attrited, {_RATE}, {_avg('MonthlyIncome', 0, 'avg_monthly_income')},
        {_avg('JobSatisfaction', 2, 'avg_job_satisfaction')}, count(*) FILTER (WHERE OverTime = 'Yes') AS overtime_headcount,
        round(CAST(count(*) FILTER (WHERE OverTime = 'Yes') AS DOUBLE) * 100 / count(*) * 10) / 10 AS overtime_pct
        FROM hr GROUP BY ALL)"""),
    "income_histogram": "WITH " + _HR + _histogram("hr", "Attrition", "MonthlyIncome", "'No', 'Yes'", 25, "Attrition"),
    "rate_by_order_lines": """SELECT l_returnflag, l_linestatus, count(*) AS lines, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
        round(CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) * 100 / count(*) * 10) / 10 AS discounted_pct,
        round(avg(l_quantity) * 100) / 100 AS avg_quantity FROM lineitem GROUP BY ALL""",
    "aggregate_functions": _hr(f"""SELECT JobLevel, count(*) AS n, count(DISTINCT JobRole) AS roles,
        CAST(sum(MonthlyIncome) AS BIGINT) AS payroll, {_r('avg(Age)', 6)} AS avg_age, min(Age) AS min_age, max(Age) AS max_age,
        (SELECT MaritalStatus FROM hr AS h WHERE h.JobLevel = hr.JobLevel GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_marital,
        {_r('stddev_pop(MonthlyIncome)', 6)} AS std_income FROM hr GROUP BY JobLevel"""),
    "scaled_rates": _hr(f"""SELECT JobRole, attrition_rate_pct, total,
        {_r('(attrition_rate_pct - min(attrition_rate_pct) OVER ()) / (max(attrition_rate_pct) OVER () - min(attrition_rate_pct) OVER ())', 6)} AS scaled,
        {_r('CAST(total AS DOUBLE) / max(total) OVER ()', 6)} AS share_of_max
        FROM (SELECT JobRole, {_RATE}, count(*) AS total FROM hr GROUP BY JobRole) AS t"""),
    "peak_department": _hr(f"""SELECT *, attrition_rate_pct = max(attrition_rate_pct) OVER () AS is_max
        FROM (SELECT Department, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr GROUP BY ALL) AS t"""),
    "peak_tenure": _hr(f"""SELECT {_TENURE} AS tenure_bucket, count(*) AS total, {_LEFT} AS attrited, {_RATE},
        {_avg('MonthlyIncome', 0, 'avg_monthly_income')} FROM hr GROUP BY 1 ORDER BY attrition_rate_pct DESC, tenure_bucket LIMIT 1"""),
    "top_segments": _hr(f"""SELECT Department || ' / ' || JobRole AS segment, count(*) AS headcount, {_RATE}
        FROM hr GROUP BY Department, JobRole HAVING count(*) >= 15 ORDER BY headcount DESC, segment LIMIT 15"""),

    # watch lists
    "promotion_watchlist": _hr("""SELECT EmployeeNumber, Department, YearsInCurrentRole, PerformanceRating, YearsSinceLastPromotion
        FROM hr WHERE YearsInCurrentRole > 1 AND PerformanceRating > 2 AND YearsSinceLastPromotion > 0"""),
    "low_pay_low_satisfaction": _hr(f"""SELECT Department, count(*) AS total, {_LEFT} AS attrited, {_RATE} FROM hr
        WHERE MonthlyIncome <= (SELECT quantile_cont(MonthlyIncome, 0.25) FROM hr)
        AND JobSatisfaction + EnvironmentSatisfaction + RelationshipSatisfaction + WorkLifeBalance < 10 GROUP BY 1"""),
    "below_median_low_satisfaction": _hr("""SELECT EmployeeNumber, Department, MonthlyIncome, JobSatisfaction FROM hr
        WHERE MonthlyIncome < (SELECT median(MonthlyIncome) FROM hr) AND JobSatisfaction < 3"""),

    # preparation
    "label_encode": _hr("SELECT EmployeeNumber, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in fv.CATEGORICAL_FEATURES) + " FROM hr"),
    "encoder_labels": _hr(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
        f"FROM hr GROUP BY {c}" for c in fv.CATEGORICAL_FEATURES)),
    "stratified_split": _hr("SELECT EmployeeNumber, attrition_flag, side AS split FROM split", _MODEL, _SPLIT),
    "stratified_folds": "WITH " + _HR + ", " + _MODEL + _folds_sql("model", "EmployeeNumber", "attrition_flag", 5, 42),
    "stratified_folds_labels": "WITH base AS (SELECT * FROM labels)" + _folds_sql("base", "doc_id", "quality", 4, 7).replace(
        "SELECT id AS doc_id, y AS quality,", "SELECT id AS doc_id, y AS quality, (SELECT toxic FROM labels AS l WHERE l.doc_id = id) AS toxic,"),
    "standard_scale": _hr("SELECT EmployeeNumber, " + ", ".join(
        _r(f"({c} - (SELECT avg({c}) FROM split WHERE side = 'train')) / (SELECT stddev_pop({c}) FROM split WHERE side = 'train')", 6) + f" AS {c}"
        for c in ("Age", "MonthlyIncome", "YearsAtCompany", "satisfaction_composite")) + " FROM split WHERE side = 'test'", _MODEL, _SPLIT),
    "balanced_weights": _hr(f"""SELECT EmployeeNumber, attrition_flag,
        {_r('CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY attrition_flag))', 9)} AS weight FROM model""", _MODEL),
    "default_values": _hr(_DEFAULT_ROWS, _MODEL),
    "assembled_features": _hr(f"""SELECT EmployeeNumber, CAST(32 AS INTEGER) AS n_features, {_r(
        ' + '.join([*fv.NUMERIC_FEATURES, *fv.DERIVED_FEATURES, *[f'codes_{c}.code' for c in fv.CATEGORICAL_FEATURES]]), 2)} AS checksum
        FROM model {_CODE_JOINS}""", _MODEL, *_LABEL_CODES.values()),

    # odds ratios on fixed coefficients
    "odds_ratio_table": _hr(f"""SELECT feature, coef, {_r('exp(coef)', 6)} AS odds_ratio, {_r('exp(coef - 0.25)', 6)} AS ci_lower,
        {_r('exp(coef + 0.25)', 6)} AS ci_upper, pvalue FROM coefs""", _ROLE),
    "significant_odds_ratios": _hr("SELECT feature, coef, pvalue FROM coefs WHERE pvalue < 0.05", _ROLE),
    "forest_plot_data": _hr(f"""SELECT feature, {_r('exp(coef)', 6)} AS odds_ratio, pvalue,
        CASE WHEN coef > 0 THEN 'increases' ELSE 'reduces' END AS direction FROM coefs WHERE pvalue < 0.05""", _ROLE),

    # evaluation
    "roc_auc": _hr(f"""SELECT {_r('''sum(pos * (below + neg / CAST(2 AS DOUBLE))) / (sum(pos) * CAST(sum(neg) AS DOUBLE))''', 9)} AS auc
        FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM (
          SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY s) AS g) AS c""", _SCORED),
    "roc_auc_line_prices": f"""SELECT {_r('''sum(pos * (below + neg / CAST(2 AS DOUBLE))) / (sum(pos) * CAST(sum(neg) AS DOUBLE))''', 9)} AS auc
        FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM (
          SELECT l_extendedprice AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS pos,
            count(*) FILTER (WHERE l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1) AS g) AS c""",
    "roc_curve": _hr(_START + _POINT, _SCORED, _CURVE),
    "roc_curve_without_collinear": _hr(
        _START + _POINT + " WHERE i = 1 OR p2 IS NULL OR p1 <> p2 OR n1 <> n2", _SCORED, _CURVE),
    "stump_scores": _hr(f"""SELECT EmployeeNumber, {_r('p', 9)} AS score, CAST(p > 0.5 AS INTEGER) AS predicted, CAST(0.5 AS DOUBLE) AS base_value,
        {_r('p - 0.5', 9)} AS shap, CAST(1 AS DOUBLE) AS importance
        FROM hr JOIN (
          SELECT OverTime, (y1 / n1) / (y1 / n1 + y0 / n0) AS p FROM (
            SELECT OverTime, CAST({_LEFT} AS DOUBLE) AS y1, CAST(count(*) - {_LEFT} AS DOUBLE) AS y0 FROM hr GROUP BY 1) AS a,
            (SELECT {_LEFT} AS n1, count(*) - {_LEFT} AS n0 FROM hr) AS b) AS s USING (OverTime)"""),
    "logit_of_overtime": _hr(f"""SELECT feature, {_r('coef', 6)} AS coef, {_r('se', 6)} AS std_err, {_r('coef - 1.959963984540054 * se', 6)} AS ci_lower,
        {_r('coef + 1.959963984540054 * se', 6)} AS ci_upper, false AS aliased FROM (
        SELECT 'intercept' AS feature, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM cells
        UNION ALL SELECT 'overtime', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM cells) AS t""",
        """cells AS (SELECT CAST(count(*) FILTER (WHERE OverTime = 'Yes' AND Attrition = 'Yes') AS DOUBLE) AS a,
        CAST(count(*) FILTER (WHERE OverTime = 'Yes' AND Attrition <> 'Yes') AS DOUBLE) AS b,
        CAST(count(*) FILTER (WHERE OverTime <> 'Yes' AND Attrition = 'Yes') AS DOUBLE) AS c,
        CAST(count(*) FILTER (WHERE OverTime <> 'Yes' AND Attrition <> 'Yes') AS DOUBLE) AS d FROM hr)"""),
    "forest_additivity": _hr("SELECT EmployeeNumber, CAST(0 AS DOUBLE) AS error FROM hr"),
    "confusion_matrix": _hr("""SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
        (SELECT count(*) FROM scored WHERE y = a AND scored.predicted = p) AS n
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, p)""", _SCORED),
    "classification_report": _hr(f"""SELECT class, {_r('precision', 9)} AS precision, {_r('recall', 9)} AS recall, {_r('f1', 9)} AS f1,
        CAST(support AS BIGINT) AS support FROM (
        SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
        UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM f
        UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
        UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
          (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f) AS t""", _SCORED, _CONFUSION),
    "leavers_caught": _hr("""SELECT count(*) FILTER (WHERE predicted = 1) AS caught, count(*) AS "left",
        round(CAST(count(*) FILTER (WHERE predicted = 1) AS DOUBLE) * 100 / count(*)) AS caught_pct FROM scored WHERE y = 1""", _SCORED),

    # explanations
    "shap_importance": _hr(f"""SELECT feature, {_r('avg(abs(shap))', 9)} AS mean_abs_shap FROM shap GROUP BY feature
        ORDER BY avg(abs(shap)) DESC, feature LIMIT 5""", _MODEL, _SHAP),
    "shap_summary_data": _hr(f"""SELECT EmployeeNumber, feature, value, shap, {_r('coalesce((value - lo) / nullif(hi - lo, 0), 0)', 9)} AS scaled
        FROM shap JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM shap GROUP BY feature
          ORDER BY avg(abs(shap)) DESC, feature LIMIT 15) AS top USING (feature)""", _MODEL, _SHAP),
    "waterfall": _hr(f"""SELECT EmployeeNumber, CAST(step AS INTEGER) AS step, label, value, {_r('shap', 9)} AS shap,
        {_r('0.5 + upto - shap', 9)} AS start, {_r('0.5 + upto', 9)} AS "end"
        FROM (SELECT *, sum(shap) OVER (PARTITION BY EmployeeNumber ORDER BY step) AS upto FROM (
          SELECT EmployeeNumber, 13 - rn AS step, feature AS label, value, shap FROM strength WHERE rn <= 11
          UNION ALL SELECT EmployeeNumber, 1, count(*) || ' other features', NULL, sum(shap) FROM strength WHERE rn > 11
            GROUP BY EmployeeNumber) AS parts) AS t""", _MODEL, _SHAP, _STRENGTH),
    "shap_dependence": _hr("""SELECT a.EmployeeNumber, a.value, a.shap, b.value AS by_value FROM shap AS a
        JOIN shap AS b ON a.EmployeeNumber = b.EmployeeNumber AND a.feature = 'YearsAtCompany' AND b.feature = 'JobSatisfaction'""", _MODEL, _SHAP),
    "top_factors": _hr(f"""SELECT EmployeeNumber, CAST(rn AS INTEGER) AS rank, feature, {_NAMES_CASE.format(c='feature')} AS label,
        value, shap, CASE WHEN shap > 0 THEN 'increases' ELSE 'reduces' END AS direction FROM strength WHERE rn <= 6""",
                       _MODEL, _SHAP, _STRENGTH),

    # risk tiers
    "high_risk_by_department": _hr("SELECT Department, count(*) AS n FROM scored WHERE s > 0.55 GROUP BY 1", _SCORED),
    "high_risk_by_role_top": _hr("SELECT JobRole, count(*) AS n FROM scored WHERE s > 0.55 GROUP BY 1 ORDER BY n DESC, JobRole LIMIT 7", _SCORED),
    "highest_risk_profile": _hr("SELECT unnest(['employee', 'probability_pct', 'outcome', " + ", ".join(
        f"'{f}'" for f in fv.PROFILE_FIELDS) + "]) AS field, unnest([CAST(EmployeeNumber AS VARCHAR), "
        "CAST(round(s * 1000) / 10 AS VARCHAR), CASE WHEN y = 1 THEN 'Left' ELSE 'Stayed' END, " + ", ".join(
        f"CAST({f} AS VARCHAR)" for f in fv.PROFILE_FIELDS) + "]) AS value FROM (SELECT * FROM risk ORDER BY s DESC, EmployeeNumber LIMIT 1) AS t",
        _SCORED, _RISK),
    "tier_distribution": _hr(f"""SELECT t.tier AS risk_tier, count(risk.tier) AS n,
        {_r('CAST(count(risk.tier) AS DOUBLE) / (SELECT count(tier) FROM risk)', 9)} AS share
        FROM (VALUES ('High Risk'), ('Medium Risk'), ('Low Risk')) AS t(tier) LEFT JOIN risk ON risk.tier = t.tier GROUP BY t.tier""", _SCORED, _RISK),
    "tier_actual_rate": _hr(f"SELECT tier AS risk_tier, count(*) AS n, {_r('avg(y)', 9)} AS actual_rate FROM risk WHERE tier IS NOT NULL GROUP BY 1",
                            _SCORED, _RISK),
    "score_histogram": "WITH " + ", ".join([_HR, _SCORED, _RISK]) + _histogram(
        "risk", "tier", "s", "'High Risk', 'Medium Risk', 'Low Risk'", 20, "risk_tier"),
    "overtime_share": _hr(_shares("OverTime", "risk", "high").replace("{d}", "9"), _SCORED, _RISK,
                          "high AS (SELECT * FROM risk WHERE tier = 'High Risk')"),
    "risk_summary": _hr(f"""SELECT h AS high_risk_count, {_r('100.0 * h / n', 6)} AS high_risk_pct, {_r('hi', 6)} AS high_actual_pct,
        {_r('lo', 6)} AS low_actual_pct, {_r('hi / greatest(lo, 0.01)', 6)} AS risk_multiplier FROM (
        SELECT count(*) FILTER (WHERE tier = 'High Risk') AS h, count(*) AS n, avg(y) FILTER (WHERE tier = 'High Risk') * 100 AS hi,
          avg(y) FILTER (WHERE tier = 'Low Risk') * 100 AS lo FROM risk) AS t""", _SCORED, _RISK),
    "risk_frame_on_fixed_score": _hr("""SELECT EmployeeNumber, Department, JobRole, OverTime, y AS actual_attrition,
        s AS attrition_probability, tier AS risk_tier FROM risk""", _SCORED, _RISK),

    # what-if profiles
    "fill_profile": _hr(f"SELECT *, {_DERIVED} FROM filled", _MODEL, f"defaults AS ({_DEFAULT_ROWS})", _PROFILES, _FILLED),
    "profile_stats": _hr(f"""SELECT profile_id, {_COMPOSITE} AS satisfaction_avg,
        CASE WHEN OverTime = 'Yes' THEN 'Yes' ELSE 'No' END AS working_overtime,
        YearsSinceLastPromotion || CASE WHEN YearsSinceLastPromotion = 1 THEN ' yr' ELSE ' yrs' END AS since_last_promotion
        FROM profiles""", _PROFILES),
}
ORACLE["segment_role_department_200"] = ORACLE["segment_role_department"].replace("headcount >= 15", "headcount >= 200")


def _segment_reports() -> str:
    measures = f"""count(*) AS total, {_LEFT} AS attrited, {_RATE}, {_avg('MonthlyIncome', 0, 'avg_monthly_income')},
        {_avg('Age', 1, 'avg_age')}, {_avg('YearsAtCompany', 1, 'avg_tenure_years')},
        {_avg('JobSatisfaction', 2, 'avg_satisfaction')}, count(*) FILTER (WHERE OverTime = 'Yes') AS overtime_headcount"""
    null = "CAST(NULL AS VARCHAR)"
    parts = [
        ("workforce", null, null, ""), ("department", "Department", null, ""), ("age_group", _AGE, null, ""),
        ("tenure", _TENURE, null, ""), ("satisfaction_overtime", "CAST(JobSatisfaction AS VARCHAR)", "OverTime", ""),
        ("role", "JobRole", null, ""), ("role_department", "Department", "JobRole", ""),
        ("marital_overtime", "MaritalStatus", "OverTime", ""), ("income_satisfaction", _INCOME, _SATISFACTION, ""),
        ("promotion", _PROMOTION, null, ""), ("triple_risk_department", "Department", null, f"WHERE {_TRIPLE}")]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS report, {a} AS key1, {b} AS key2, {measures} FROM hr {where} "
        + ("" if name == "workforce" else "GROUP BY 2, 3") for name, a, b, where in parts)


ORACLE["all_segment_reports"] = _hr(_segment_reports())
