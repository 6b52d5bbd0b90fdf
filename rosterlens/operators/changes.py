"""What changed between snapshots of a list: who entered, stayed and left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTERED, STAYED, LEFT = "entered", "stayed", "left"


def month_number(date: Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def _once(snapshot: DataFrame, key: Sequence[str], carry: Sequence[str]) -> DataFrame:
    known = snapshot.dropna(subset=list(key)).select(*key, F.struct(F.lit(1).alias("_"), *carry).alias("row"))
    return known.groupBy(*key).agg(F.min("row").alias("row"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key..., state, carry_before..., carry_after...) for every key of either snapshot.

    One full outer join.  A key that is repeated counts once, with the smallest
    of its carried values; rows with a null in the key are nobody and do not
    count.  Where a side has no row its carried values are null.
    """
    old = _once(before, key, carry).withColumnRenamed("row", "old")
    new = _once(after, key, carry).withColumnRenamed("row", "new")
    state = F.when(F.col("old").isNull(), ENTERED).when(F.col("new").isNull(), LEFT).otherwise(STAYED)
    values = [F.col(f"{side}.{c}").alias(f"{c}_{name}") for side, name in (("old", "before"), ("new", "after")) for c in carry]
    return old.join(new, list(key), "full_outer").select(*key, state.alias("state"), *values)


def changes_over_time(snapshots: DataFrame, period: str, key: Sequence[str]) -> DataFrame:
    """(period, entered, stayed, left) of every period but the first, each against the one before it.

    ``period`` is a whole number; a period without rows in between is an empty
    list, which everybody leaves and the next enters.  All pairs of neighbours
    are one join: the snapshots against themselves, one period later.
    """
    members = snapshots.dropna(subset=[period, *key]).select(F.col(period).cast("long").alias("period"), *key).distinct()
    span = members.agg(F.min("period").alias("first"), F.max("period").alias("final"))
    earlier = members.withColumns({"period": F.col("period") + 1, "was": F.lit(True)})
    both = members.withColumn("is", F.lit(True)).join(earlier, ["period", *key], "full_outer")
    counts = both.groupBy("period").agg(
        F.count_if(F.col("was").isNull()).alias(ENTERED), F.count_if(F.col("was") & F.col("is")).alias(STAYED),
        F.count_if(F.col("is").isNull()).alias(LEFT))
    periods = span.where("first < final").select(F.explode(F.sequence(F.col("first") + 1, "final")).alias("period"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return periods.join(counts, "period", "left").select("period", *[zero(c) for c in (ENTERED, STAYED, LEFT)])
