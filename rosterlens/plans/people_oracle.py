"""Independent SQL for the queries over time, in DuckDB's dialect."""

from __future__ import annotations

from rosterlens.plans.oracle import _DEFAULT_ROWS, _FILLED, _LEFT, _MODEL, _PROFILES, _TRIPLE, _hr, _r

_DAYS = """days AS (
  SELECT user_id AS person, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS period FROM events
  WHERE event_type <> 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
  GROUP BY 1, 2 HAVING sum(CAST(value AS DECIMAL(18, 2))) > 20),
runs AS (
  SELECT person, min(period) AS first, max(period) AS last, count(*) AS n FROM (
    SELECT person, period, period - row_number() OVER (PARTITION BY person ORDER BY period) AS island FROM days)
  GROUP BY person, island HAVING count(*) >= 4)"""
_SURVEYS = """surveys AS (
  SELECT user_id AS person, ts, max(event_id) AS survey_id, CAST(arg_max(1 + CAST(floor(value) AS BIGINT) % 4, event_id) AS INTEGER) AS score
  FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
ended AS (SELECT *, CAST(DATE '1970-01-01' + CAST(last + 1 AS INTEGER) AS TIMESTAMP) AS run_end FROM runs),
asked AS (
  SELECT e.person, strftime(DATE '1970-01-01' + CAST(e.first AS INTEGER), '%Y-%m-%d') AS first_day,
         strftime(DATE '1970-01-01' + CAST(e.last AS INTEGER), '%Y-%m-%d') AS last_day, e.n, s.survey_id, s.score,
         strftime(DATE '1970-01-01' + CAST(e.last + 15 AS INTEGER), '%Y-%m-%d') AS due_day
  FROM ended e ASOF LEFT JOIN surveys s ON e.person = s.person AND e.run_end > s.ts)"""
_FOLLOW_UPS = f"WITH {_DAYS}, {_SURVEYS} SELECT person, first_day, last_day, n, survey_id, score, due_day FROM asked WHERE score < 2"
_LISTS = f"""lists AS (
  SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, o_custkey AS person
  FROM hr JOIN orders ON EmployeeNumber = o_orderkey WHERE {_TRIPLE})"""
_STUMP = f"""shares AS (
  SELECT OverTime, (y1 / n1) / (y1 / n1 + y0 / n0) AS p FROM (
    SELECT OverTime, CAST({_LEFT} AS DOUBLE) AS y1, CAST(count(*) - {_LEFT} AS DOUBLE) AS y0 FROM hr GROUP BY 1) AS a,
    (SELECT {_LEFT} AS n1, count(*) - {_LEFT} AS n0 FROM hr) AS b),
judged AS (SELECT profile_id, p FROM filled JOIN shares ON filled.OverTime = shares.OverTime)"""
_PROFILE_TABLES = (_MODEL, f"defaults AS ({_DEFAULT_ROWS})", _PROFILES, _FILLED, _STUMP)
_SCORES = _hr(f"""SELECT profile_id, {_r('p', 6)} AS probability,
  CASE WHEN p >= 0.55 THEN 'HIGH RISK' WHEN p >= 0.3 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_tier,
  CASE WHEN p >= 0.5 THEN 'likely to leave' ELSE 'likely to stay' END AS verdict FROM judged""", *_PROFILE_TABLES)

ORACLE: dict[str, str] = {
    "overtime_runs": f"WITH {_DAYS} SELECT person, first, last, n FROM runs",
    "survey_before_run_end": f"WITH {_DAYS}, {_SURVEYS} SELECT person, first_day, last_day, n, survey_id, score FROM asked",
    "overtime_follow_ups": _FOLLOW_UPS,
    "streamed_overtime_follow_ups": _FOLLOW_UPS,
    "triple_risk_monthly_changes": _hr("""SELECT p.period, count(*) FILTER (WHERE m.here AND NOT m.before) AS entered,
        count(*) FILTER (WHERE m.here AND m.before) AS stayed, count(*) FILTER (WHERE m.before AND NOT m.here) AS "left"
        FROM (SELECT unnest(range(min(month) + 1, max(month) + 1)) AS period FROM lists) AS p LEFT JOIN (
          SELECT month, person, bool_or(here) AS here, NOT bool_and(here) AS before FROM (
            SELECT month, person, true AS here FROM lists UNION ALL SELECT month + 1, person, false FROM lists) GROUP BY 1, 2) AS m
        ON m.month = p.period GROUP BY 1""", _LISTS),
    "triple_risk_list_changes": _hr("""SELECT person, CAST(back AS INTEGER) AS months_back, CASE WHEN NOT bool_or(old) THEN 'entered'
        WHEN NOT bool_or(new) THEN 'left' ELSE 'stayed' END AS state FROM (
          SELECT person, (SELECT max(month) FROM lists) - month AS back, false AS old, true AS new FROM lists
          UNION ALL SELECT person, (SELECT max(month) FROM lists) - month - 1, true, false FROM lists) WHERE back IN (0, 1) GROUP BY 1, 2""", _LISTS),
    "quartiles_from_sketches": """SELECT o_orderstatus, probability, true AS within, n FROM (
        SELECT o_orderstatus, count(o_totalprice) AS n FROM orders GROUP BY 1),
        (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS probability)""",
    "people_from_sketches": "SELECT event_type, count(DISTINCT user_id) AS people, true AS within FROM events GROUP BY 1",
    "dictionary_codes": """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey || '/' || (o_orderkey % 97)) - 1 AS BIGINT) AS code
        FROM orders""",
    "stump_profile_scores": _SCORES,
    "streamed_profiles_once": _SCORES,
    "defaults_after_going_back": _hr(_DEFAULT_ROWS, _MODEL),
    "stump_profile_factors": _hr(f"""SELECT profile_id, 'OverTime' AS feature, {_r('p - 0.5', 6)} AS shap,
        CASE WHEN p > 0.5 THEN 'increases' ELSE 'reduces' END AS direction FROM judged""", *_PROFILE_TABLES),
}
