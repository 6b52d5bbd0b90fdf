"""Data-quality profiles: one pass over the table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.functions.expressions import pct


def _unpivot_single_row(row: DataFrame, names: list[str], value_name: str) -> DataFrame:
    """Turn a one-row frame into (column, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(value_name)) for c in names])
    return row.select(F.inline(pairs))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for the columns that have nulls."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _unpivot_single_row(counts, df.columns, "nulls").where("nulls > 0")


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, value) for columns with exactly one distinct non-null value.

    min = max decides that in one pass with a constant-size state, where a
    distinct count would keep or shuffle every value.
    """
    bounds = df.agg(*[
        F.when(F.min(f"`{c}`") == F.max(f"`{c}`"), F.min(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    return _unpivot_single_row(bounds, df.columns, "value").where("value IS NOT NULL")


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Rows per non-null value, most frequent first; ``share`` when normalised."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        counts = counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))  # one row per value
    return counts.orderBy(F.desc("n"), column)


def feature_validation(features: DataFrame) -> DataFrame:
    """Row count, distinct ids, leavers and rate of the feature table."""
    return features.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(fv.ID).alias("unique_employees"),
        F.sum(fv.FLAG).alias("total_attrition"),
        pct(F.sum(fv.FLAG), F.count(F.lit(1))).alias("attrition_rate_pct"),
    )


def class_balance(df: DataFrame, label: str = fv.FLAG, by: str | None = None) -> DataFrame:
    """Count of both classes and the positive rate, over all rows or per split."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count_if(F.col(label) == 0).alias("stayed"),
        F.count_if(F.col(label) == 1).alias("left"),
        F.avg(F.col(label)).alias("rate"),
    )


def shape(df: DataFrame) -> DataFrame:
    """One row with the number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
