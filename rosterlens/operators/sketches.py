"""Stored sketches of quantiles and distinct counts, kept per period and group and merged when asked.

A sketch has a bounded size whatever the number of rows, so yesterday's rows are
never read again: new periods append their sketches, and a question over any
periods and groups merges those.  Exact forms stay the default elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 800  # size of a quantile sketch; about 10 KB
DISTINCT_LG_K = 12  # a distinct-count sketch has 2^12 registers
SAFETY = 2  # stated bounds are twice the error that 99 of 100 sketches stay under


def quantile_error(k: int = QUANTILE_K) -> float:
    """Rank error, as a share of the rows, that estimated quantiles stay under: 0.7 % at 800."""
    return SAFETY * 2.296 / k**0.9723


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Relative error that estimated distinct counts stay under: 8 % at 12, five standard errors."""
    return 5 * 1.04 / 2 ** (lg_k / 2)


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """(by..., sketch, n): one mergeable quantile sketch per period and group; nulls and NaN do not count.

    Rows are combined before the shuffle, so only sketches travel.
    """
    number = F.col(value).cast("double")
    known = F.when(~F.isnan(number), number)
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(known, k).alias("sketch"), F.count(known).alias("n"))


def merged_quantiles(sketches: DataFrame, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, one column per probability): quantiles over all sketches of a group, null for an empty one."""
    merged = sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in probabilities.items()])


def merged_ranks(sketches: DataFrame, cuts: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, one column per cut): share of a group's rows at or below each cut."""
    merged = sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*by, "n", *[F.kll_sketch_get_rank_double("sketch", F.lit(float(c))).alias(name) for name, c in cuts.items()])


def distinct_sketches(df: DataFrame, value: str, by: Sequence[str], lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """(by..., sketch): one mergeable distinct-count sketch per period and group; nulls do not count.

    Ids are combined where they are read; no id is shuffled.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = (), name: str = "n_distinct") -> DataFrame:
    """(by..., name): estimated number of distinct values over all sketches of a group."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def rank_within(df: DataFrame, value: str, estimates: DataFrame, probabilities: dict[str, float], by: Sequence[str],
                bound: float | None = None) -> DataFrame:
    """(by..., probability, within): whether each estimate's exact rank is within the bound of what was asked.

    One scan of the rows against a broadcast row of estimates per group; ``by``
    must have few values.  The proof of the sketches, not their use.
    """
    bound = quantile_error() if bound is None else bound
    number, rows = F.col(value).cast("double"), F.count(F.col(value))
    both = df.join(F.broadcast(estimates.drop("n")), list(by))

    def holds(name: str, p: float) -> Column:
        below, upto = F.count_if(number < F.col(name)), F.count_if(number <= F.col(name))
        return (below <= (p + bound) * rows) & (upto >= (p - bound) * rows)

    checked = both.groupBy(*by).agg(*[holds(name, p).alias(f"ok_{name}") for name, p in probabilities.items()])
    return checked.select(*by, F.inline(F.array(*[
        F.struct(F.lit(p).alias("probability"), F.col(f"ok_{name}").alias("within")) for name, p in probabilities.items()])))
