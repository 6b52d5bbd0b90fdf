"""Queries that evaluate a trained model SQL can follow, and chart data of bounded size.

The model is a tree of depth one on overtime, trained on the 80 percent split
or on four of five folds; every figure of its hold-out has a value in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators import chartdata, metrics, models, prep, risk
from rosterlens.plans.catalog import EXPLAINED_FEATURES, _explained
from rosterlens.sources.hr_fixture import hr_raw

Query = Callable[[SparkSession, str], DataFrame]
STUMP = {"trees": 1, "depth": 1, "bootstrap": False}


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, flag, role, department and a vector of overtime alone."""
    numbers = hr_raw(spark, sf_dir).select(
        fv.ID, "Department", "JobRole", "OverTime", ex.attrition_flag().alias(fv.FLAG),
        F.when(F.col("OverTime") == "Yes", 1.0).otherwise(0.0).alias("overtime_number"))
    return VectorAssembler(inputCols=["overtime_number"], outputCol="features").transform(numbers)


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows, scored by the stump of the train rows, with tiers."""
    split = prep.stratified_split(_numbers(spark, sf_dir))
    forest = models.fit_forest(split.where("split = 'train'"), **STUMP)
    scored = models.score(forest, split.where("split = 'test'"), risk.SCORE, predicted="predicted")
    return risk.assign_tiers(scored.withColumnRenamed(fv.FLAG, risk.ACTUAL))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: ex.round_to(c, 6) for c, t in rows.dtypes if t == "double"})


def stump_holdout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_holdout(spark, sf_dir).select(fv.ID, risk.ACTUAL, risk.SCORE, "predicted", risk.TIER))


def stump_holdout_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_holdout(spark, sf_dir), risk.ACTUAL, risk.SCORE))


def stump_holdout_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.roc_curve(_holdout(spark, sf_dir), risk.ACTUAL, risk.SCORE)
    first = F.col("threshold") == float("inf")
    return curve.select(F.when(first, F.col("threshold")).otherwise(ex.round_to("threshold", 6)).alias("threshold"),
                        ex.round_to("fpr", 6).alias("fpr"), ex.round_to("tpr", 6).alias("tpr"))


def stump_holdout_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_holdout(spark, sf_dir), risk.ACTUAL, "predicted")


def stump_holdout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.classification_report(_holdout(spark, sf_dir), risk.ACTUAL, "predicted"))


def stump_holdout_leavers_caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leavers_caught(_holdout(spark, sf_dir), risk.ACTUAL, "predicted")


def stump_holdout_tier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(risk.tier_actual_rate(_holdout(spark, sf_dir)))


def stump_fold_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of every fold, from the stump of the other four."""
    return _rounded(models.fold_aucs(_numbers(spark, sf_dir), **STUMP))


def stump_cross_validated_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.cv_auc(_numbers(spark, sf_dir), **STUMP))


def shap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary chart as counts per cell."""
    return chartdata.shap_density(_explained(spark, sf_dir), 15, EXPLAINED_FEATURES)


def shap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three points of every cell of the summary chart."""
    return chartdata.shap_sample(_explained(spark, sf_dir), features=EXPLAINED_FEATURES)


def shap_dependence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependence chart as counts per cell with the mean of the colouring feature."""
    return _rounded(chartdata.dependence_density(_explained(spark, sf_dir), "YearsAtCompany", "JobSatisfaction"))


def line_price_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against quantity of all order lines, 25 by 25 cells for each return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_extendedprice")
    group = ["l_returnflag"]
    return chartdata.density(chartdata.with_cells(lines, "l_quantity", "l_extendedprice", group, 25), group)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    stump_holdout_scores, stump_holdout_auc, stump_holdout_roc_curve, stump_holdout_confusion_matrix, stump_holdout_report,
    stump_holdout_leavers_caught, stump_holdout_tier_rates, stump_fold_aucs, stump_cross_validated_auc, shap_density, shap_sample,
    shap_dependence_density, line_price_density)}
