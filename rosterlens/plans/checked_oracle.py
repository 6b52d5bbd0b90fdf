"""Independent SQL for the evaluation of the overtime tree and for chart data, in DuckDB's dialect."""

from __future__ import annotations

from rosterlens.plans.oracle import _CONFUSION, _CURVE, _MODEL, _SHAP, _SPLIT, _START, _TIER_CUT, _folds_sql, _hr, _r

# Leaves of a tree of depth one whose classes weigh the same: share of weighted positives on each side.
_HELD = """stump AS (SELECT OverTime, (y1 / n1) / (y1 / n1 + y0 / n0) AS s FROM (
    SELECT OverTime, CAST(count(*) FILTER (WHERE attrition_flag = 1) AS DOUBLE) AS y1, CAST(count(*) FILTER (WHERE attrition_flag = 0) AS DOUBLE) AS y0
    FROM split WHERE side = 'train' GROUP BY 1) AS a,
    (SELECT count(*) FILTER (WHERE attrition_flag = 1) AS n1, count(*) FILTER (WHERE attrition_flag = 0) AS n0 FROM split WHERE side = 'train') AS b),
scored AS (SELECT EmployeeNumber, attrition_flag AS y, s, CAST(s > 0.5 AS INTEGER) AS predicted
  FROM split JOIN stump ON split.OverTime = stump.OverTime WHERE side = 'test')"""
_TABLES = (_MODEL, _SPLIT, _HELD)
_FOLD_AUCS = _hr(f"""SELECT fold, {_r('''(CASE WHEN up > down THEN a * d + (a * b + c * d) / 2 WHEN up < down THEN b * c + (a * b + c * d) / 2
  ELSE (a + c) * (b + d) / 2 END) / ((a + c) * (b + d))''', 6)} AS auc FROM (
  SELECT h.fold, h.a, h.b, h.c, h.d, (t.a - h.a) / (t.b - h.b) AS up, (t.c - h.c) / (t.d - h.d) AS down FROM sides AS h,
    (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM sides) AS t) AS f""", _MODEL,
    "folds AS (WITH unused AS (SELECT 1)" + _folds_sql("model", "EmployeeNumber", "attrition_flag", 5, 42) + ")",
    """sides AS (SELECT fold, CAST(count(*) FILTER (WHERE OverTime = 'Yes' AND y = 1) AS DOUBLE) AS a,
    CAST(count(*) FILTER (WHERE OverTime = 'Yes' AND y = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE OverTime <> 'Yes' AND y = 1) AS DOUBLE) AS c,
    CAST(count(*) FILTER (WHERE OverTime <> 'Yes' AND y = 0) AS DOUBLE) AS d
    FROM (SELECT fold, folds.attrition_flag AS y, OverTime FROM folds JOIN model ON folds.EmployeeNumber = model.EmployeeNumber) AS t GROUP BY 1)""")


def _cell(value: str, low: str, high: str, bins: int) -> str:
    return f"""CASE WHEN {high} = {low} THEN 1 WHEN {value} = {high} THEN {bins}
      ELSE CAST(floor(({value} - {low}) / ({high} - {low}) * {bins}) AS INTEGER) + 1 END"""


_CELLS = f"""ends AS (SELECT feature, min(value) AS x0, max(value) AS x1, min(shap) AS y0, max(shap) AS y1 FROM shap
  GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT 15),
cells AS (SELECT EmployeeNumber, feature, value, shap, {_cell('value', 'x0', 'x1', 20)} AS value_bin, {_cell('shap', 'y0', 'y1', 20)} AS shap_bin
  FROM shap JOIN ends USING (feature))"""

ORACLE: dict[str, str] = {
    "stump_holdout_scores": _hr(f"""SELECT EmployeeNumber, y AS actual_attrition, {_r('s', 6)} AS attrition_probability, predicted,
        {_TIER_CUT} AS risk_tier FROM scored""", *_TABLES),
    "stump_holdout_auc": _hr(f"""SELECT {_r('''(SELECT sum(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END * p.k * n.k) FROM
        (SELECT s, CAST(count(*) AS DOUBLE) AS k FROM scored WHERE y = 1 GROUP BY s) AS p,
        (SELECT s, CAST(count(*) AS DOUBLE) AS k FROM scored WHERE y = 0 GROUP BY s) AS n)
        / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) / count(*) FILTER (WHERE y = 0)''', 6)} AS auc FROM scored""", *_TABLES),
    "stump_holdout_roc_curve": _hr(
        _START + f"SELECT {_r('s', 6)}, {_r('CAST(fp AS DOUBLE) / n', 6)}, {_r('CAST(tp AS DOUBLE) / p', 6)} FROM steps", *_TABLES, _CURVE),
    "stump_holdout_confusion_matrix": _hr("""SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
        (SELECT count(*) FROM scored WHERE y = a AND scored.predicted = p) AS n
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, p)""", *_TABLES),
    "stump_holdout_report": _hr(f"""SELECT class, {_r('precision', 6)} AS precision, {_r('recall', 6)} AS recall, {_r('f1', 6)} AS f1,
        CAST(support AS BIGINT) AS support FROM (
        SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
        UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM f
        UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
        UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
          (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f) AS t""", *_TABLES, _CONFUSION),
    "stump_holdout_leavers_caught": _hr("""SELECT count(*) FILTER (WHERE predicted = 1) AS caught, count(*) AS "left",
        round(CAST(count(*) FILTER (WHERE predicted = 1) AS DOUBLE) * 100 / count(*)) AS caught_pct FROM scored WHERE y = 1""", *_TABLES),
    "stump_holdout_tier_rates": _hr(f"""SELECT tier AS risk_tier, count(*) AS n, {_r('avg(y)', 6)} AS actual_rate
        FROM (SELECT y, {_TIER_CUT} AS tier FROM scored) AS t WHERE tier IS NOT NULL GROUP BY 1""", *_TABLES),
    "stump_fold_aucs": _FOLD_AUCS,
    "stump_cross_validated_auc": f"""SELECT {_r('avg(auc)', 6)} AS auc_mean, {_r('stddev_pop(auc)', 6)} AS auc_std FROM (
        {_FOLD_AUCS.replace("1e6", "1e15")}) AS folds""",
    "shap_density": _hr("SELECT feature, value_bin, shap_bin, count(*) AS n FROM cells GROUP BY 1, 2, 3", _MODEL, _SHAP, _CELLS),
    "shap_sample": _hr("""SELECT EmployeeNumber, feature, value, shap, value_bin, shap_bin, n, CAST(n AS DOUBLE) / least(n, 3) AS weight FROM (
        SELECT *, count(*) OVER (PARTITION BY feature, value_bin, shap_bin) AS n, row_number() OVER (
          PARTITION BY feature, value_bin, shap_bin ORDER BY md5(EmployeeNumber || ':42'), EmployeeNumber) AS place FROM cells) AS t
        WHERE place <= 3""", _MODEL, _SHAP, _CELLS),
    "shap_dependence_density": _hr(f"""SELECT value_bin, shap_bin, count(*) AS n, {_r('avg(by_value)', 6)} AS avg_by_value FROM (
        SELECT {_cell('value', 'x0', 'x1', 20)} AS value_bin, {_cell('shap', 'y0', 'y1', 20)} AS shap_bin, by_value FROM (
          SELECT a.value, a.shap, b.value AS by_value, min(a.value) OVER () AS x0, max(a.value) OVER () AS x1,
            min(a.shap) OVER () AS y0, max(a.shap) OVER () AS y1
          FROM shap AS a JOIN shap AS b ON a.EmployeeNumber = b.EmployeeNumber AND a.feature = 'YearsAtCompany' AND b.feature = 'JobSatisfaction') AS p) AS c
        GROUP BY 1, 2""", _MODEL, _SHAP),
    "line_price_density": f"""SELECT l_returnflag, {_cell('q', 'x0', 'x1', 25)} AS x_bin, {_cell('v', 'y0', 'y1', 25)} AS y_bin, count(*) AS n FROM (
        SELECT *, min(q) OVER w AS x0, max(q) OVER w AS x1, min(v) OVER w AS y0, max(v) OVER w AS y1 FROM (
          SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) AS l
        WINDOW w AS (PARTITION BY l_returnflag)) AS t GROUP BY 1, 2, 3""",
}
