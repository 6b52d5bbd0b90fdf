"""Logit inference: coefficients, standard errors and odds ratios."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators import leastsquares

Z_95 = 1.959963984540054  # 97.5% point of the normal distribution


def aliased_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that are linear functions of the intercept and earlier columns.

    Two passes: means and deviations, then the triangle of the scaled table.
    A nearly redundant column stays as long as a share of 1e-10 of its
    deviation is its own.
    """
    return leastsquares.redundant_columns(df, columns, leastsquares.column_scale(df, columns))


def logit_inference(train: DataFrame, columns: Sequence[str] = fv.FEATURES, label: str = fv.FLAG) -> DataFrame:
    """Maximum-likelihood logit on scaled columns.

    (feature, coef, std_err, z, pvalue, ci_lower, ci_upper, aliased); the
    intercept comes first.  Redundant columns are left out of the fit and get
    null statistics, since their coefficients are not identified.  An empty
    table and values that are null, NaN or infinite raise.
    """
    columns = list(columns)
    data = train.select(*[F.col(c).cast("double").alias(c) for c in (label, *columns)]).persist()
    try:
        scale = leastsquares.column_scale(data, [label, *columns])
        of = lambda names: leastsquares.Scale(*[
            np.array([part[1 + columns.index(c)] for c in names]) for part in (scale.mean, scale.deviation)])
        aliased = leastsquares.redundant_columns(data, columns, of(columns))
        used = [c for c in columns if c not in aliased]
        coefficients, covariance = leastsquares.logit_fit(data, label, used, of(used))
    finally:
        data.unpersist()
    errors = np.sqrt(np.diag(covariance))
    stats = {name: (float(c), float(e), float(c / e), math.erfc(abs(c / e) / math.sqrt(2)))
             for name, c, e in zip(["intercept", *used], coefficients, errors)}
    rows = [(name, *stats.get(name, (None,) * 4), name in aliased) for name in ["intercept", *columns]]
    table = train.sparkSession.createDataFrame(
        rows, "feature string, coef double, std_err double, z double, pvalue double, aliased boolean")
    return table.select("feature", "coef", "std_err", "z", "pvalue",
                        (F.col("coef") - Z_95 * F.col("std_err")).alias("ci_lower"),
                        (F.col("coef") + Z_95 * F.col("std_err")).alias("ci_upper"), "aliased")


def odds_ratio_table(coefficients: DataFrame) -> DataFrame:
    """Odds ratios and their intervals without the intercept, largest first."""
    return coefficients.where("feature <> 'intercept'").select(
        "feature", "coef", F.exp("coef").alias("odds_ratio"), F.exp("ci_lower").alias("ci_lower"),
        F.exp("ci_upper").alias("ci_upper"), "pvalue").orderBy(F.desc_nulls_last("odds_ratio"), "feature")


def significant(odds: DataFrame, level: float = fv.SIGNIFICANCE) -> DataFrame:
    return odds.where(F.col("pvalue").isNotNull() & ~F.isnan("pvalue") & (F.col("pvalue") < level))


def forest_plot_data(odds: DataFrame, level: float = fv.SIGNIFICANCE) -> DataFrame:
    """Significant features, smallest ratio first, with the direction of the effect."""
    return significant(odds, level).withColumn("direction", ex.direction("odds_ratio", 1.0)).orderBy(
        "odds_ratio", "feature")
