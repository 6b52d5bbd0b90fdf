"""Every operator as a named query over the given tables.

``QUERIES`` maps a name to a function of (session, data folder).  Rates, tiers
and evaluations run on the employee table derived from ``orders``; operators
that read scores or explanations run on deterministic ones, so that each can be
compared with plain SQL, and on a trained model where the model is the point.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators import explain, inference, metrics, models, prep, profile, reports, risk, scoring
from rosterlens.plans import attrition, report_pack
from rosterlens.sources import tables
from rosterlens.sources.artifacts import RiskModel, load_or_fit
from rosterlens.sources.hr_fixture import fixed_score, hr_raw
from rosterlens.streaming.scoring import profile_stream, start_scoring, write_profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _on_employees(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(hr_raw(spark, sf_dir))


# --- inputs ---------------------------------------------------------------------

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of this application and data set under the shared folder."""
    data = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    return f"{tables.shared_dir(spark)}/rosterlens/{spark.sparkContext.applicationId}/{data}/{name}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees with flag, fixed score and the class it predicts."""
    return hr_raw(spark, sf_dir).withColumns({
        fv.FLAG: ex.attrition_flag(), "score": fixed_score()}).withColumn(
        "predicted", F.when(F.col("score") >= fv.LEAVE_THRESHOLD, 1).otherwise(0))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk frame on the fixed score."""
    return risk.assign_tiers(hr_raw(spark, sf_dir).withColumns({
        risk.SCORE: fixed_score(), risk.ACTUAL: ex.attrition_flag(), **ex.derived_features()}))


EXPLAINED_FEATURES = fv.NUMERIC_FEATURES + fv.DERIVED_FEATURES


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic contributions of 25 features for every employee."""
    frame = hr_raw(spark, sf_dir).withColumns(ex.derived_features())
    names = F.array(*map(F.lit, EXPLAINED_FEATURES))
    values = F.array(*[F.col(c).cast("double") for c in EXPLAINED_FEATURES])
    shaps = F.transform(F.sequence(F.lit(1), F.lit(len(EXPLAINED_FEATURES))), lambda i: (
        (F.col(fv.ID) * (7919 + 2 * i) + i * 131) % 2001 - 1000) / F.lit(10000.0))
    zipped = F.arrays_zip(names.alias("feature"), values.alias("value"), shaps.alias("shap"))
    return frame.select(fv.ID, zipped.alias("contributions"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One what-if profile per employee; some fields are left open."""
    open_when = {"Age": 3, "MonthlyIncome": 5, "JobRole": 7, "OverTime": 11}
    hr = hr_raw(spark, sf_dir)
    fields = [
        F.when(F.col(fv.ID) % open_when[c] != 0, F.col(c)).alias(c) if c in open_when else F.col(c)
        for c in fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES]
    return hr.select(F.col(fv.ID).alias(scoring.PROFILE_ID), *fields)


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees with planted nulls, an all-null column and a constant with nulls."""
    hr = hr_raw(spark, sf_dir)
    return hr.withColumns({
        "JobSatisfaction": F.nullif("JobSatisfaction", F.lit(1)),
        "Department": F.nullif("Department", F.lit("Sales")),
        "MonthlyIncome": F.when(F.col("MonthlyIncome") >= 5000, F.col("MonthlyIncome")),
        "Over18": F.when(F.col("Age") > 30, F.col("Over18")),
        "Age": F.nullif("Age", F.lit(40)),
        "YearsAtCompany": F.nullif("YearsAtCompany", F.lit(4)),
        "YearsSinceLastPromotion": F.nullif("YearsSinceLastPromotion", F.lit(2)),
        "StandardHours": F.lit(None).cast("bigint")})


def _model(spark: SparkSession, sf_dir: str) -> RiskModel:
    """The forest of the 80 percent split, trained once per session and data set."""
    return load_or_fit(spark, _scratch(spark, sf_dir, "model"),
                       lambda path: attrition.train_risk_model(hr_raw(spark, sf_dir), path, scope="train"))


# --- sources, sinks, catalog --------------------------------------------------------

@query
def read_csv_with_schema(spark, sf_dir):
    path = _scratch(spark, sf_dir, "employees.csv")
    tables.write_report(hr_raw(spark, sf_dir), path, "csv")
    return tables.read_table(spark, path, tables.hr_schema())


@query
def read_csv_inferred(spark, sf_dir):
    path = _scratch(spark, sf_dir, "features.csv")
    tables.write_report(prep.feature_table(hr_raw(spark, sf_dir)), path, "csv")
    return reports.rate_by_department(tables.read_table(spark, path))


@query
def read_first_available(spark, sf_dir):
    found = tables.read_first_available(spark, [f"{sf_dir}/missing.parquet", f"{sf_dir}/customer.parquet"])
    return found.select("c_custkey", "c_mktsegment")


@query
def registered_view_sql(spark, sf_dir):
    tables.register(hr_raw(spark, sf_dir), "hr_raw")
    return tables.run_sql(spark, "SELECT EducationField, count(*) AS total, avg(Age) AS avg_age "
                                 "FROM hr_raw GROUP BY EducationField")


@query
def stored_feature_table(spark, sf_dir):
    return tables.create_or_replace(prep.feature_table(hr_raw(spark, sf_dir)), _scratch(spark, sf_dir, "hr_features"))


@query
def saved_defaults(spark, sf_dir):
    return _model(spark, sf_dir).defaults


@query
def saved_feature_order(spark, sf_dir):
    return spark.read.parquet(f"{_model(spark, sf_dir).path}/features")


@query
def preview(spark, sf_dir):
    return tables.preview(hr_raw(spark, sf_dir), 3)


@query
def written_report(spark, sf_dir):
    path = _scratch(spark, sf_dir, "rate_by_role.parquet")
    tables.write_report(reports.rate_by_role(hr_raw(spark, sf_dir)), path)
    return tables.read_table(spark, path)


# --- profiling ------------------------------------------------------------------------

@query
def null_counts(spark, sf_dir):
    return profile.null_counts(_with_gaps(spark, sf_dir))


@query
def constant_columns(spark, sf_dir):
    return profile.constant_columns(_with_gaps(spark, sf_dir))


@query
def null_counts_lineitem(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return profile.null_counts(lines.withColumns({
        "l_discount": F.nullif("l_discount", F.lit(0.0)), "l_linestatus": F.nullif("l_linestatus", F.lit("F"))}))


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(_with_gaps(spark, sf_dir), "Department", normalize=True)


@query
def feature_validation(spark, sf_dir):
    return profile.feature_validation(prep.feature_table(hr_raw(spark, sf_dir)))


@query
def class_balance(spark, sf_dir):
    return profile.class_balance(prep.model_frame(hr_raw(spark, sf_dir)))


@query
def class_balance_by_split(spark, sf_dir):
    frame = prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, fv.FLAG)
    return profile.class_balance(prep.stratified_split(frame), by="split")


@query
def class_balance_labels(spark, sf_dir):
    return profile.class_balance(_table(spark, sf_dir, "labels"), label="toxic", by="quality")


@query
def table_shape(spark, sf_dir):
    return profile.shape(prep.feature_table(hr_raw(spark, sf_dir)))


# --- expressions ----------------------------------------------------------------------

@query
def scalar_features(spark, sf_dir):
    return _with_gaps(spark, sf_dir).select(
        fv.ID, ex.attrition_flag().alias(fv.FLAG), ex.age_group().alias("age_group"),
        ex.tenure_bucket().alias("tenure_bucket"), ex.income_band().alias("income_band"),
        ex.satisfaction_tier().alias("satisfaction_tier"), ex.last_promotion().alias("last_promotion"),
        *[c.alias(name) for name, c in ex.derived_features().items()],
        ex.ordinal_label("WorkLifeBalance").alias("balance_label"), ex.category_text("Department").alias("department_text"))


@query
def score_labels(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("score", F.when(F.col(fv.ID) % 13 != 0, F.col("score")))  # with null scores
    return scored.select(
        fv.ID, ex.risk_tier_cut("score").alias("tier_cut"), ex.risk_tier_threshold("score").alias("tier_threshold"),
        ex.verdict("score").alias("verdict"), ex.score_pct("score").alias("score_pct"),
        ex.direction(F.col("score") - 0.5).alias("direction"))


@query
def scalar_arithmetic(spark, sf_dir):
    income = F.col("MonthlyIncome")
    return hr_raw(spark, sf_dir).select(
        fv.ID, ex.round_to(income / 12.0, 2).alias("weekly"), F.abs(income - 10000).alias("distance"),
        ex.round_to(F.exp(income / 20000.0), 6).alias("exp_income"),
        F.coalesce(F.nullif("StockOptionLevel", F.lit(0)), F.lit(-1)).cast("bigint").alias("stock_or_default"))


@query
def amount_labels(spark, sf_dir):
    yearly = F.col("MonthlyIncome") * F.lit(12) * F.col("JobLevel") * F.col("JobLevel")
    return hr_raw(spark, sf_dir).select(
        fv.ID, ex.format_amount(yearly).alias("yearly_text"), ex.format_amount("MonthlyIncome").alias("monthly_text"),
        ex.format_amount("Age").alias("age_text"))


@query
def severity_by_tenure(spark, sf_dir):
    report = reports.rate_by_tenure(hr_raw(spark, sf_dir))
    return report.select("tenure_bucket", reports.RATE, ex.severity_band(reports.RATE).alias("severity"))


@query
def feature_table(spark, sf_dir):
    return prep.feature_table(hr_raw(spark, sf_dir))


@query
def model_frame(spark, sf_dir):
    return prep.model_frame(hr_raw(spark, sf_dir))


@query
def feature_columns(spark, sf_dir):
    """Feature names by position, with their display names and mean values."""
    frame = prep.model_frame(hr_raw(spark, sf_dir))
    names = [c for c in prep.feature_columns(frame) if c not in fv.CATEGORICAL_FEATURES]
    means = frame.agg(*[F.avg(c).alias(c) for c in names])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), ex.round_to(c, 6).alias("mean_value"))
        for i, c in enumerate(names)]))).withColumn("label", ex.display_name("feature"))


# --- filters and joins ------------------------------------------------------------------

@query
def triple_risk_employees(spark, sf_dir):
    people = reports.triple_risk_employees(hr_raw(spark, sf_dir))
    return people.select(fv.ID, "Department", "JobRole", "MonthlyIncome", fv.TARGET)


@query
def filter_forms(spark, sf_dir):
    hr = hr_raw(spark, sf_dir)
    kept = hr.where(F.col("Age").between(30, 40) & F.col("EducationField").isin("Medical", "Other")
                    & (F.col("Gender") == "Female") & (F.col("DistanceFromHome") > 10))
    return kept.groupBy("EducationField").agg(reports.rows().alias("n"), F.max("Age").alias("oldest"))


@query
def attach_by_key(spark, sf_dir):
    scored = _scored(spark, sf_dir).select(fv.ID, "score")
    return risk.attach(scored, hr_raw(spark, sf_dir), ["Department", "JobRole", "OverTime"])


@query
def department_with_baseline(spark, sf_dir):
    return reports.with_baseline(reports.rate_by_department(hr_raw(spark, sf_dir)))


@query
def marital_status_of_triple_risk(spark, sf_dir):
    both = reports.compare_groups(hr_raw(spark, sf_dir), ex.triple_risk(), "MaritalStatus")
    return both.withColumns({c: ex.round_to(c, 6) for c in ("pct_all", "pct_subset")})


# --- reports ------------------------------------------------------------------------------

for _name in ("workforce_snapshot", "rate_by_department", "rate_by_age_group", "rate_by_tenure",
              "rate_by_satisfaction_overtime", "rate_by_role", "income_quartiles", "median_by_class",
              "segment_role_department", "rate_by_marital_overtime", "rate_by_income_satisfaction",
              "promotion_stagnation", "triple_risk_by_department", "triple_risk_outcome",
              "stacked_headcount", "role_bubble", "heat_pivot"):
    _on_employees(_name, getattr(reports, _name))
_on_employees("rate_by_satisfaction_overtime_short", lambda hr: reports.rate_by_satisfaction_overtime(hr, False))
_on_employees("segment_role_department_200", lambda hr: reports.segment_role_department(hr, 200))
_on_employees("triple_risk_total", lambda hr: reports.triple_risk_total(reports.triple_risk_outcome(hr)))
_on_employees("replacement_cost", lambda hr: reports.replacement_cost(hr).withColumns({
    c: ex.round_to(c, 2) for c in ("cost_per_leaver", "total_cost")}))
_on_employees("income_histogram", lambda hr: reports.histogram_by_class(
    hr, "MonthlyIncome", fv.TARGET, ["No", "Yes"], 25).withColumns({
        c: ex.round_to(c, 6) for c in ("bin_start", "bin_end")}))


_on_employees("promotion_watchlist", lambda hr: reports.promotion_watchlist(hr).select(
    fv.ID, "Department", "YearsInCurrentRole", "PerformanceRating", "YearsSinceLastPromotion"))
_on_employees("low_pay_low_satisfaction", reports.low_pay_low_satisfaction)
_on_employees("below_median_low_satisfaction", lambda hr: reports.below_median_low_satisfaction(hr).select(
    fv.ID, "Department", "MonthlyIncome", "JobSatisfaction"))
_on_employees("all_segment_reports", report_pack.all_segment_reports)


@query
def income_quartiles_approximate(spark, sf_dir):
    return reports.income_quartiles(hr_raw(spark, sf_dir), approximate=True)


@query
def rate_by_order_lines(spark, sf_dir):
    """The report builder on another table, keys and condition."""
    return reports.rate_by(
        _table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], total="lines", positives="discounted",
        rate="discounted_pct", condition=F.col("l_discount") > 0.05,
        metrics={"avg_quantity": reports.mean("l_quantity", 2)})


@query
def quartiles_of_line_prices(spark, sf_dir):
    """Exact quantiles of a continuous column with many distinct values."""
    found = reports.exact_quantiles(_table(spark, sf_dir, "lineitem"), "l_extendedprice",
                                    {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["l_returnflag"])
    return found.select("l_returnflag", *[ex.round_to(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query
def aggregate_functions(spark, sf_dir):
    return hr_raw(spark, sf_dir).groupBy("JobLevel").agg(
        reports.rows().alias("n"), F.count_distinct("JobRole").alias("roles"), F.sum("MonthlyIncome").alias("payroll"),
        ex.round_to(F.avg("Age"), 6).alias("avg_age"), F.min("Age").alias("min_age"), F.max("Age").alias("max_age"),
        F.mode("MaritalStatus", True).alias("mode_marital"),
        ex.round_to(F.stddev_pop("MonthlyIncome"), 6).alias("std_income"))


@query
def scaled_rates(spark, sf_dir):
    report = reports.rate_by_role(hr_raw(spark, sf_dir)).select("JobRole", reports.RATE, "total")
    scaled = reports.share_of_max(reports.min_max_scale(report, reports.RATE), "total")
    return scaled.withColumns({c: ex.round_to(c, 6) for c in ("scaled", "share_of_max")})


@query
def peak_department(spark, sf_dir):
    return reports.flag_maxima(reports.rate_by_department(hr_raw(spark, sf_dir)), reports.RATE)


@query
def peak_tenure(spark, sf_dir):
    return reports.argmax_row(reports.rate_by_tenure(hr_raw(spark, sf_dir)), reports.RATE, "tenure_bucket")


@query
def top_segments(spark, sf_dir):
    report = reports.segment_role_department(hr_raw(spark, sf_dir)).withColumn(
        "segment", F.concat_ws(" / ", "Department", "JobRole"))
    return reports.top_k(report, "headcount", 15, "segment").select("segment", "headcount", reports.RATE)


# --- preparation ------------------------------------------------------------------------------

@query
def label_encode(spark, sf_dir):
    frame = prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, *fv.CATEGORICAL_FEATURES)
    return prep.label_encode(frame)


@query
def encoder_labels(spark, sf_dir):
    """Every known value with its code, as the fitted encoder gives it."""
    hr = hr_raw(spark, sf_dir)
    encoder = prep.fit_encoder(hr)
    long = hr.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in fv.CATEGORICAL_FEATURES])))
    seen = long.groupBy("column", "value").agg(reports.rows().alias("n"))
    code = F.lit(None).cast("int")
    for column, labels in zip(fv.CATEGORICAL_FEATURES, encoder.labelsArray):
        for value in labels:
            match = (F.col("column") == column) & (F.col("value") == value)
            code = F.when(match, prep.encode_value(encoder, column, value)).otherwise(code)
    return seen.withColumn("code", code)


@query
def stratified_split(spark, sf_dir):
    frame = prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, fv.FLAG)
    return prep.stratified_split(frame)


@query
def stratified_folds(spark, sf_dir):
    frame = prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, fv.FLAG)
    return prep.stratified_folds(frame)


@query
def stratified_folds_labels(spark, sf_dir):
    """Folds of another table: the quality labels of documents."""
    return prep.stratified_folds(_table(spark, sf_dir, "labels"), "quality", "doc_id", k=4, seed=7)


@query
def standard_scale(spark, sf_dir):
    """Scaling learned on the train rows and applied to the test rows."""
    columns = ["Age", "MonthlyIncome", "YearsAtCompany", "satisfaction_composite"]
    split = prep.stratified_split(prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, fv.FLAG, *columns))
    scaled = prep.standard_scale(split.where("split = 'train'"), split.where("split = 'test'"), columns)
    return scaled.select(fv.ID, *[ex.round_to(c, 6).alias(c) for c in columns])


@query
def balanced_weights(spark, sf_dir):
    weighted = prep.balanced_weights(prep.model_frame(hr_raw(spark, sf_dir)).select(fv.ID, fv.FLAG))
    return weighted.select(fv.ID, fv.FLAG, ex.round_to("weight", 9).alias("weight"))


@query
def default_values(spark, sf_dir):
    return prep.default_values(prep.model_frame(hr_raw(spark, sf_dir)))


@query
def assembled_features(spark, sf_dir):
    frame = prep.model_frame(hr_raw(spark, sf_dir))
    design = prep.design_matrix(frame, prep.feature_pipeline().fit(frame))
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda acc, v: acc + v)
    return design.select(fv.ID, F.size(vector_to_array("features")).alias("n_features"),
                         ex.round_to(total, 2).alias("checksum"))


# --- models ---------------------------------------------------------------------------------

@query
def logit_coefficients(spark, sf_dir):
    return _logit(spark, sf_dir)


@query
def logit_odds_ratios(spark, sf_dir):
    return inference.odds_ratio_table(_logit(spark, sf_dir))


def _logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.create_or_replace(prep.model_frame(hr_raw(spark, sf_dir)), _scratch(spark, sf_dir, f"logit/{uuid.uuid4().hex}"))
    train = prep.label_encode(prep.stratified_split(rows).where("split = 'train'").drop("split"))
    return inference.logit_inference(prep.standard_scale(train, train, fv.FEATURES))


def _role_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient table made from the role report, to value-check its consumers."""
    roles = reports.rate_by_role(hr_raw(spark, sf_dir))
    coef = (F.col("attrited") % 41 - 20) / 10.0
    return roles.select(
        F.col("JobRole").alias("feature"), coef.alias("coef"),
        F.when(F.col("attrited") % 5 != 0, (F.col("attrited") % 20) / 200.0).alias("pvalue"),
        (coef - 0.25).alias("ci_lower"), (coef + 0.25).alias("ci_upper"))


@query
def odds_ratio_table(spark, sf_dir):
    odds = inference.odds_ratio_table(_role_coefficients(spark, sf_dir))
    return odds.withColumns({c: ex.round_to(c, 6) for c in ("odds_ratio", "ci_lower", "ci_upper")})


@query
def significant_odds_ratios(spark, sf_dir):
    odds = inference.significant(inference.odds_ratio_table(_role_coefficients(spark, sf_dir)))
    return odds.select("feature", "coef", "pvalue")


@query
def forest_plot_data(spark, sf_dir):
    plot = inference.forest_plot_data(inference.odds_ratio_table(_role_coefficients(spark, sf_dir)))
    return plot.select("feature", ex.round_to("odds_ratio", 6).alias("odds_ratio"), "pvalue", "direction")


def _stump(spark: SparkSession, sf_dir: str) -> tuple[RandomForestClassificationModel, DataFrame, str]:
    """One tree of depth one on overtime alone, without bootstrap: small enough for SQL to check every part."""
    numbers = hr_raw(spark, sf_dir).select(fv.ID, ex.attrition_flag().alias(fv.FLAG), F.when(
        F.col("OverTime") == "Yes", 1.0).otherwise(0.0).alias("overtime"))
    data = VectorAssembler(inputCols=["overtime"], outputCol="features").transform(numbers)
    forest = models.fit_forest(data, trees=1, depth=1, bootstrap=False)
    path = _scratch(spark, sf_dir, "stump")
    forest.write().overwrite().save(path)
    return forest, data, path


@query
def stump_scores(spark, sf_dir):
    """Score, class, base value, contribution and importance of the stump for every employee."""
    forest, data, path = _stump(spark, sf_dir)
    base = explain.base_value(explain.node_table(spark, path)).scalar()
    weight = models.feature_importance(forest, spark, ["overtime"]).select("importance").scalar()
    explained = explain.explain_forest(models.score(forest, data), path, features=["overtime"], carry=["score", "predicted"])
    return explained.select(
        fv.ID, ex.round_to("score", 9).alias("score"), "predicted", ex.round_to(base, 9).alias("base_value"),
        ex.round_to(F.col("contributions")[0]["shap"], 9).alias("shap"), ex.round_to(weight, 9).alias("importance"))


@query
def logit_of_overtime(spark, sf_dir):
    """Coefficients of a logit on one binary column, which its two-by-two counts give in closed form."""
    numbers = hr_raw(spark, sf_dir).select(ex.attrition_flag().alias(fv.FLAG), F.when(
        F.col("OverTime") == "Yes", 1.0).otherwise(0.0).alias("overtime"))
    fitted = inference.logit_inference(numbers, ["overtime"])
    return fitted.select("feature", *[ex.round_to(c, 6).alias(c) for c in ("coef", "std_err", "ci_lower", "ci_upper")], "aliased")


@query
def forest_additivity(spark, sf_dir):
    """Base value plus contributions minus the score of the trained forest, for every employee."""
    model = _model(spark, sf_dir)
    base = explain.base_value(explain.node_table(spark, model.forest_path)).scalar()
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["shap"])
    scores = models.score(model.forest, attrition.design_of(model), predicted=None).select(fv.ID, "score")
    both = _explanations(spark, sf_dir).join(scores, fv.ID)
    return both.select(fv.ID, F.abs(ex.round_to(base + total - F.col("score"), 9)).alias("error"))


@query
def forest_nodes(spark, sf_dir):
    """Size of every tree of the trained forest."""
    nodes = explain.node_table(spark, _model(spark, sf_dir).forest_path)
    return nodes.groupBy("tree").agg(reports.rows().alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves"))


@query
def scored_holdout(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = attrition.risk_frame(model, attrition.design_of(model), "holdout")
    return rows.select(fv.ID, risk.ACTUAL, risk.SCORE, "predicted")


@query
def holdout_auc(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = attrition.risk_frame(model, attrition.design_of(model), "holdout")
    return metrics.roc_auc(rows, risk.ACTUAL, risk.SCORE)


@query
def feature_importance_top15(spark, sf_dir):
    return models.feature_importance(_model(spark, sf_dir).forest, spark)


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out rows scored by the trained forest, with tiers."""
    model = _model(spark, sf_dir)
    return attrition.risk_frame(model, attrition.design_of(model), "holdout")


for _name, _operator in {
    "holdout_confusion_matrix": lambda rows: metrics.confusion_matrix(rows, risk.ACTUAL, "predicted"),
    "holdout_classification_report": lambda rows: metrics.classification_report(rows, risk.ACTUAL, "predicted"),
    "holdout_roc_curve": lambda rows: metrics.roc_curve(rows, risk.ACTUAL, risk.SCORE),
    "holdout_leavers_caught": lambda rows: metrics.leavers_caught(rows, risk.ACTUAL, "predicted"),
    "holdout_tier_distribution": risk.tier_distribution,
    "holdout_risk_summary": risk.risk_summary,
    "holdout_highest_risk_profile": risk.highest_risk_profile,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, _f=_operator: _f(_holdout(spark, sf_dir))


@query
def holdout_highest_risk_waterfall(spark, sf_dir):
    """Waterfall of the hold-out employee with the highest score."""
    model = _model(spark, sf_dir)
    top = reports.argmax_row(_holdout(spark, sf_dir), risk.SCORE, fv.ID).select(fv.ID)  # one row
    one = attrition.design_of(model).join(F.broadcast(top), fv.ID, "left_semi")
    explained = explain.explain_forest(one, model.forest_path, features=model.features)
    return explain.waterfall(explained, explain.base_value(explain.node_table(spark, model.forest_path)))


@query
def forest_shap_dependence(spark, sf_dir):
    """Overtime contributions by job satisfaction on the trained forest."""
    return explain.shap_dependence(_explanations(spark, sf_dir))


@query
def cross_validated_auc(spark, sf_dir):
    design = attrition.design_of(_model(spark, sf_dir))
    return models.cv_auc(design.where("split = 'train'"))


# --- evaluation -----------------------------------------------------------------------------

@query
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), fv.FLAG, "score").select(ex.round_to("auc", 9).alias("auc"))


@query
def roc_auc_line_prices(spark, sf_dir):
    """AUC of a continuous score with about as many distinct values as rows."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("returned", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return metrics.roc_auc(lines, "returned", "l_extendedprice").select(ex.round_to("auc", 9).alias("auc"))


def _rounded_curve(curve: DataFrame) -> DataFrame:
    return curve.select("threshold", ex.round_to("fpr", 9).alias("fpr"), ex.round_to("tpr", 9).alias("tpr"))


@query
def roc_curve(spark, sf_dir):
    return _rounded_curve(metrics.roc_curve(_scored(spark, sf_dir), fv.FLAG, "score"))


@query
def roc_curve_without_collinear(spark, sf_dir):
    return _rounded_curve(metrics.roc_curve(_scored(spark, sf_dir), fv.FLAG, "score", drop_collinear=True))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), fv.FLAG, "predicted")


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(_scored(spark, sf_dir), fv.FLAG, "predicted")
    return report.withColumns({c: ex.round_to(c, 9) for c in ("precision", "recall", "f1")})


@query
def leavers_caught(spark, sf_dir):
    return metrics.leavers_caught(_scored(spark, sf_dir), fv.FLAG, "predicted")


# --- explanations -----------------------------------------------------------------------------

@query
def explain_forest(spark, sf_dir):
    """Exact contributions of every feature for every employee, on the trained forest."""
    return explain.to_long(_explanations(spark, sf_dir))


def _explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored explanations of the trained forest, computed on first use."""
    path = _scratch(spark, sf_dir, "explanations")
    if tables.path_exists(spark, f"{path}/_SUCCESS"):
        return tables.read_table(spark, path)
    model = _model(spark, sf_dir)
    return attrition.store_explanations(model, attrition.design_of(model), path)


@query
def forest_shap_importance(spark, sf_dir):
    """Mean absolute contributions on the trained forest."""
    return explain.shap_importance(_explanations(spark, sf_dir))


@query
def forest_waterfall(spark, sf_dir):
    """Steps from the base value to the prediction for every employee, on the trained forest."""
    nodes = explain.node_table(spark, _model(spark, sf_dir).forest_path)
    return explain.waterfall(_explanations(spark, sf_dir), explain.base_value(nodes))


@query
def forest_base_value(spark, sf_dir):
    return explain.base_value(explain.node_table(spark, _model(spark, sf_dir).forest_path))


@query
def shap_importance(spark, sf_dir):
    top = explain.shap_importance(_explained(spark, sf_dir), 5, EXPLAINED_FEATURES)
    return top.select("feature", ex.round_to("mean_abs_shap", 9).alias("mean_abs_shap"))


@query
def shap_summary_data(spark, sf_dir):
    points = explain.shap_summary_data(_explained(spark, sf_dir), k=15, features=EXPLAINED_FEATURES)
    return points.withColumn("scaled", ex.round_to("scaled", 9))


@query
def waterfall(spark, sf_dir):
    steps = explain.waterfall(_explained(spark, sf_dir), 0.5)
    return steps.withColumns({c: ex.round_to(c, 9) for c in ("shap", "start", "end")})


@query
def shap_dependence(spark, sf_dir):
    return explain.shap_dependence(_explained(spark, sf_dir), "YearsAtCompany", "JobSatisfaction")


@query
def top_factors(spark, sf_dir):
    return explain.top_factors(_explained(spark, sf_dir))


# --- risk tiers ---------------------------------------------------------------------------------

for _name in ("high_risk_by_department", "high_risk_by_role_top", "highest_risk_profile"):
    QUERIES[_name] = lambda spark, sf_dir, _f=getattr(risk, _name): _f(_risk(spark, sf_dir))


def _rounded(name: str, columns: tuple[str, ...], digits: int = 9) -> None:
    operator = getattr(risk, name)
    QUERIES[name] = lambda spark, sf_dir: operator(_risk(spark, sf_dir)).withColumns(
        {c: ex.round_to(c, digits) for c in columns})


_rounded("tier_distribution", ("share",))
_rounded("tier_actual_rate", ("actual_rate",))
_rounded("score_histogram", ("bin_start", "bin_end"))
_rounded("overtime_share", ("pct_all", "pct_subset"))
_rounded("risk_summary", ("high_risk_pct", "high_actual_pct", "low_actual_pct", "risk_multiplier"), 6)


@query
def risk_frame(spark, sf_dir):
    model = _model(spark, sf_dir)
    frame = attrition.risk_frame(model, attrition.design_of(model))
    return frame.select(fv.ID, *attrition.READABLE, risk.ACTUAL, risk.SCORE, risk.TIER)


@query
def risk_frame_on_fixed_score(spark, sf_dir):
    return _risk(spark, sf_dir).select(fv.ID, *attrition.READABLE, risk.ACTUAL, risk.SCORE, risk.TIER)


# --- what-if profiles -----------------------------------------------------------------------------

@query
def fill_profile(spark, sf_dir):
    defaults = prep.default_values(prep.model_frame(hr_raw(spark, sf_dir)))
    return scoring.complete_profile(_profiles(spark, sf_dir), defaults)


@query
def score_profiles(spark, sf_dir):
    scored = scoring.score_profiles(_model(spark, sf_dir), _profiles(spark, sf_dir))
    return scored.select(scoring.PROFILE_ID, "probability", "probability_pct", "risk_tier", "verdict")


@query
def profile_factors(spark, sf_dir):
    """The six strongest factors of every profile, on the trained forest."""
    model = _model(spark, sf_dir)
    scored = scoring.score_profiles(model, _profiles(spark, sf_dir))
    return scoring.explain_profiles(model, scored)


@query
def streamed_profile_scores(spark, sf_dir):
    """Profiles that arrive as files, scored by the stream; what was there is worked off once."""
    incoming, target = (f"{_scratch(spark, sf_dir, 'stream')}/{uuid.uuid4().hex}/{part}" for part in ("in", "out"))
    write_profiles(_profiles(spark, sf_dir), incoming)
    start_scoring(_model(spark, sf_dir), profile_stream(spark, incoming), target, name=f"scores_{uuid.uuid4().hex}").awaitTermination()
    return spark.read.parquet(target).select(scoring.PROFILE_ID, "probability", "probability_pct", "risk_tier", "verdict")


@query
def profile_stats(spark, sf_dir):
    return scoring.profile_stats(_profiles(spark, sf_dir))
