"""Sources, sinks, profiles, reports: edge cases and plans."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import metrics, prep, profile, reports, risk
from rosterlens.sources import tables


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


# --- sources ------------------------------------------------------------------------

def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"\xef\xbb\xbfAge,OverTime\n31,Yes\n45,No\n")
    inferred = tables.read_table(spark, str(path))
    assert inferred.columns == ["Age", "OverTime"] and dict(inferred.dtypes)["Age"] == "int"
    declared = tables.read_table(spark, str(path), "Age BIGINT, OverTime STRING")
    assert [tuple(r) for r in declared.collect()] == [(31, "Yes"), (45, "No")]


def test_first_available(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    found = tables.read_first_available(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert found.count() == 3
    with pytest.raises(FileNotFoundError, match="a.parquet, .*c.parquet"):
        tables.read_first_available(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "c.parquet")])


def test_tables_and_views(spark, hr, tmp_path):
    stored = tables.create_or_replace(prep.feature_table(hr), str(tmp_path / "t"))
    assert len(stored.columns) == 38 and stored.count() == 1500
    again = tables.create_or_replace(prep.feature_table(hr).limit(7), str(tmp_path / "t"))
    assert again.count() == 7
    tables.register(again.limit(5), "five")
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM five").first()["n"] == 5
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM {t}", t=again).first()["n"] == 7
    assert tables.preview(again).count() == 3


def test_schema_has_the_columns_of_the_file(hr):
    assert tables.hr_schema().fieldNames() == hr.columns and len(hr.columns) == 35
    assert [t for _, t in hr.dtypes] == [f.dataType.simpleString() for f in tables.hr_schema()]


# --- profiles -------------------------------------------------------------------------

def test_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, "x", None, 5.0), (None, "x", None, 6.0), (1, None, None, 7.0)],
                               "a int, b string, c string, d double")
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("a", 1), ("b", 1), ("c", 3)}
    assert {tuple(r) for r in profile.constant_columns(df).collect()} == {("a", "1"), ("b", "x")}


def test_value_counts_leave_nulls_out_of_the_share(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in profile.value_counts(df, "c", True).collect()] == [("a", 2, 2 / 3), ("b", 1, 1 / 3)]


# --- reports --------------------------------------------------------------------------

def test_group_totals_add_up(hr):
    n = hr.count()
    for report in (reports.rate_by_department(hr), reports.rate_by_age_group(hr), reports.rate_by_tenure(hr),
                   reports.rate_by_satisfaction_overtime(hr), reports.rate_by_role(hr),
                   reports.rate_by_marital_overtime(hr), reports.promotion_stagnation(hr)):
        rows = report.collect()
        assert sum(r["total"] for r in rows) == n
        assert all(0 <= r["attrition_rate_pct"] <= 100 for r in rows)


def test_custom_orders(hr):
    assert [r[0] for r in reports.rate_by_age_group(hr).collect()] == list(fv.AGE_GROUPS)
    assert [r[0] for r in reports.rate_by_tenure(hr).collect()] == list(fv.TENURE_BUCKETS)
    assert [r[0] for r in reports.promotion_stagnation(hr).collect()] == list(fv.PROMOTION_BUCKETS)
    assert [r[0] for r in reports.heat_pivot(hr).collect()] == ["4 - Very High", "3 - High", "2 - Medium", "1 - Low"]


def test_segments_of_fourteen_and_fifteen(spark, hr):
    base = hr.withColumn("JobRole", F.lit("r"))
    df = base.limit(14).withColumn("Department", F.lit("small")).unionAll(
        base.limit(15).withColumn("Department", F.lit("large")))
    assert [r["Department"] for r in reports.segment_role_department(df).collect()] == ["large"]


def test_empty_input(hr):
    nobody = hr.where("Age > 200")
    snapshot = reports.workforce_snapshot(nobody).first()
    assert snapshot["total_employees"] == 0 and snapshot["attrition_rate_pct"] is None
    assert reports.triple_risk_total(reports.triple_risk_outcome(nobody)).first()["left_pct"] is None
    assert reports.rate_by_department(nobody).count() == 0


def test_histogram_edges(spark):
    rows = [("a", float(v)) for v in (0, 1, 2, 9, 10)] + [("b", 4.0)] * 3
    df = spark.createDataFrame(rows, "c string, v double")
    bins = reports.histogram_by_class(df, "v", "c", ["a", "b"], 10).collect()
    counts = {(r["c"], r["bin"]): r["n"] for r in bins}
    assert len(counts) == 20
    assert counts["a", 9] == 2 and counts["a", 1] == 1  # the maximum belongs to the last bin
    assert counts["b", 5] == 3 and [r["bin_start"] for r in bins if r["c"] == "b"][0] == 3.5


def test_all_maxima_are_flagged(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "k string, v double")
    assert {r["k"] for r in reports.flag_maxima(df, "v").where("is_max").collect()} == {"a", "b"}
    assert reports.argmax_row(df, "v", "k").first()["k"] == "a"
    same = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "k string, v double")
    assert {r["scaled"] for r in reports.min_max_scale(same, "v").collect()} == {0.0}


def test_groups_absent_from_one_side_count_as_zero(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    rows = {r["c"]: r for r in reports.compare_groups(a, F.col("c") == "x", "c").collect()}
    assert (rows["y"]["n_subset"], rows["y"]["pct_subset"]) == (0, 0.0) and rows["x"]["pct_subset"] == 100.0


def test_tiers_partition_the_rows(spark):
    df = spark.createDataFrame([(i, i / 100, i % 2) for i in range(101)], f"id int, {risk.SCORE} double, {risk.ACTUAL} int")
    tiers = {r["risk_tier"]: r["n"] for r in risk.tier_distribution(risk.assign_tiers(df)).collect()}
    assert tiers == {"Low Risk": 30, "Medium Risk": 25, "High Risk": 45}
    none_high = risk.assign_tiers(df.where(f"{risk.SCORE} <= 0.2"))
    assert {r["risk_tier"]: r["n"] for r in risk.tier_distribution(none_high).collect()}["High Risk"] == 0


def test_metrics_with_an_empty_cell(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert {tuple(r) for r in metrics.confusion_matrix(df, "y", "p").collect()} == {(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)}
    report = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["f1"] == 0.0


# --- plans ----------------------------------------------------------------------------

def test_filters_and_columns_reach_the_scan(spark, hr, tmp_path):
    stored = tables.create_or_replace(hr, str(tmp_path / "hr"))
    plan = plan_of(reports.triple_risk_by_department(stored))
    scan = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    for predicate in ("EqualTo(OverTime,Yes)", "LessThanOrEqual(JobSatisfaction,2)", "LessThanOrEqual(YearsAtCompany,2)"):
        assert predicate in plan
    assert "DailyRate" not in scan and "JobRole" not in scan


def test_reports_need_one_shuffle_before_the_sort(spark, hr, tmp_path):
    stored = tables.create_or_replace(hr, str(tmp_path / "hr"))
    plan = plan_of(reports.rate_by_role(stored))
    assert plan.count("Arguments: hashpartitioning") == 1 and "partial_count" in plan


def test_splitting_does_not_shuffle_the_rows(spark, hr, tmp_path):
    stored = tables.create_or_replace(prep.model_frame(hr), str(tmp_path / "model"))
    plan = plan_of(prep.stratified_split(stored))
    assert "Exchange" not in plan and "Join" not in plan
