"""Segment reports: rates, averages, quantiles, histograms and comparisons.

Every report is one partial + final hash aggregation over the few columns it
reads.  Sort orders always end in a key so that ties are settled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators.ranking import approximate_quantiles, exact_quantiles
from rosterlens.sources.tables import settle

RATE = "attrition_rate_pct"


def rows() -> Column:
    return F.count(F.lit(1))


def hits(condition: Column) -> Column:
    """Rows where the condition holds; null on an empty table, as SUM is."""
    return F.sum(F.when(condition, 1).otherwise(0))


def leavers() -> Column:
    return hits(ex.left_company())


def mean(column: str, digits: int) -> Column:
    return ex.round_to(F.avg(column), digits)


def rate_by(df: DataFrame, keys: Mapping[str, Column] | Sequence[str] = (), *, total: str = "total",
            positives: str | None = "attrited", rate: str | None = RATE, condition: Column | None = None,
            metrics: Mapping[str, Column] | None = None, min_rows: int | None = None,
            order: Sequence[Column | str] | None = None) -> DataFrame:
    """Group, count, and take the share of rows where ``condition`` holds.

    ``keys`` are column names, or output names mapped to expressions.
    ``min_rows`` is a HAVING on the group size.  Default order: rate
    descending, then the keys.
    """
    keys = keys if isinstance(keys, Mapping) else {k: F.col(k) for k in keys}
    positive = hits(ex.left_company() if condition is None else condition)
    aggregates = {total: rows()}
    if positives:
        aggregates[positives] = positive
    if rate:
        aggregates[rate] = ex.pct(positive, rows())
    aggregates.update(metrics or {})
    report = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        *[c.alias(name) for name, c in aggregates.items()])
    if min_rows is not None:
        report = report.where(F.col(total) >= min_rows)
    if not keys:
        return report
    return report.orderBy(*(order or [F.desc(rate or total), *keys]))


# --- whole workforce --------------------------------------------------------------

def workforce_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        rows().alias("total_employees"),
        leavers().alias("attrited"),
        hits(F.col(fv.TARGET) == "No").alias("retained"),
        ex.pct(leavers(), rows()).alias(RATE),
        mean("Age", 1).alias("avg_age"),
        mean("MonthlyIncome", 0).alias("avg_monthly_income"),
        mean("YearsAtCompany", 1).alias("avg_tenure_years"))


def replacement_cost(df: DataFrame, factor: float = fv.REPLACEMENT_FACTOR) -> DataFrame:
    """Leavers, cost per leaver (a share of the annual salary) and total cost."""
    cost = df.where(ex.left_company()).agg(
        rows().alias("leavers"), (F.avg("MonthlyIncome") * 12 * F.lit(factor)).alias("cost_per_leaver"))
    cost = cost.withColumn("total_cost", F.col("cost_per_leaver") * F.col("leavers"))
    return cost.select("*", ex.format_amount("cost_per_leaver").alias("cost_per_leaver_text"),
                       ex.format_amount("total_cost").alias("total_cost_text"))


# --- one or two keys --------------------------------------------------------------

def rate_by_department(df: DataFrame) -> DataFrame:
    return rate_by(df, ["Department"])


def rate_by_age_group(df: DataFrame) -> DataFrame:
    return rate_by(df, {"age_group": ex.age_group()}, order=[ex.order_of("age_group", fv.AGE_GROUPS)])


def rate_by_tenure(df: DataFrame) -> DataFrame:
    return rate_by(df, {"tenure_bucket": ex.tenure_bucket()},
                   metrics={"avg_monthly_income": mean("MonthlyIncome", 0)},
                   order=[ex.order_of("tenure_bucket", fv.TENURE_BUCKETS)])


def rate_by_satisfaction_overtime(df: DataFrame, with_leavers: bool = True) -> DataFrame:
    return rate_by(df, ["JobSatisfaction", "OverTime"], positives="attrited" if with_leavers else None,
                   order=["JobSatisfaction", "OverTime"])


def rate_by_role(df: DataFrame) -> DataFrame:
    return rate_by(df, ["JobRole"], metrics={"avg_monthly_income": mean("MonthlyIncome", 0),
                                             "avg_satisfaction": mean("JobSatisfaction", 2)})


def segment_role_department(df: DataFrame, min_rows: int = fv.MIN_SEGMENT_ROWS) -> DataFrame:
    overtime = F.col("OverTime") == "Yes"
    return rate_by(df, ["Department", "JobRole"], total="headcount", min_rows=min_rows, metrics={
        "avg_monthly_income": mean("MonthlyIncome", 0),
        "avg_job_satisfaction": mean("JobSatisfaction", 2),
        "overtime_headcount": hits(overtime),
        "overtime_pct": ex.pct(hits(overtime), rows())})


def rate_by_marital_overtime(df: DataFrame) -> DataFrame:
    return rate_by(df, ["MaritalStatus", "OverTime"], positives=None,
                   metrics={"avg_income": mean("MonthlyIncome", 0)})


def rate_by_income_satisfaction(df: DataFrame) -> DataFrame:
    return rate_by(df, {"income_band": ex.income_band(), "satisfaction_tier": ex.satisfaction_tier()},
                   positives=None)


def promotion_stagnation(df: DataFrame) -> DataFrame:
    return rate_by(df, {"last_promotion": ex.last_promotion()}, positives=None,
                   metrics={"avg_income": mean("MonthlyIncome", 0)},
                   order=[ex.order_of("last_promotion", fv.PROMOTION_BUCKETS)])


# --- triple risk ------------------------------------------------------------------

def triple_risk_employees(df: DataFrame) -> DataFrame:
    """The people themselves; the predicate reaches the file scan."""
    return df.where(ex.triple_risk())


def triple_risk_by_department(df: DataFrame) -> DataFrame:
    return rate_by(triple_risk_employees(df), ["Department"], total="high_risk_employees", positives=None,
                   rate=None, metrics={"avg_income": mean("MonthlyIncome", 0), "avg_age": mean("Age", 1)})


def triple_risk_outcome(df: DataFrame) -> DataFrame:
    return rate_by(triple_risk_employees(df), ["Department"], total="employees_at_triple_risk",
                   positives=None, rate=None, metrics={
                       "avg_monthly_income": mean("MonthlyIncome", 0), "avg_age": mean("Age", 1),
                       "actually_left": leavers()})


def triple_risk_total(outcome: DataFrame) -> DataFrame:
    """Sums of ``triple_risk_outcome`` and the share that left; null when nobody is at risk."""
    total, left = F.sum("employees_at_triple_risk"), F.sum("actually_left")
    return outcome.agg(total.alias("total_triple"), left.alias("left_triple"),
                       ex.pct(left, total, 0).alias("left_pct"))


# --- watch lists ------------------------------------------------------------------

def promotion_watchlist(df: DataFrame) -> DataFrame:
    """Two years or more in the role, rated 3 or better, no promotion in the last cycle."""
    return df.where((F.col("YearsInCurrentRole") >= 2) & (F.col("PerformanceRating") >= 3)
                    & (F.col("YearsSinceLastPromotion") >= 1))


def income_threshold(df: DataFrame, p: float) -> Column:
    """Exact income quantile as a scalar."""
    return exact_quantiles(df, "MonthlyIncome", {"q": p}).select("q").scalar()


def low_pay_low_satisfaction(df: DataFrame) -> DataFrame:
    """Bottom income quartile with a composite below 2.5, by department."""
    low = (F.col("MonthlyIncome") <= income_threshold(df, 0.25)) & (ex.satisfaction_composite() < 2.5)
    return rate_by(df.where(low), ["Department"])


def below_median_low_satisfaction(df: DataFrame) -> DataFrame:
    """People paid below the median whose job satisfaction is 1 or 2."""
    return df.where((F.col("MonthlyIncome") < income_threshold(df, 0.5)) & F.col("JobSatisfaction").isin(1, 2))


# --- quantiles --------------------------------------------------------------------

def income_quartiles(df: DataFrame, by: str = fv.TARGET, column: str = "MonthlyIncome",
                     approximate: bool = False) -> DataFrame:
    """Minimum, quartiles, maximum and mean per class, rounded to whole units."""
    quartiles = {"q1_income": 0.25, "median_income": 0.5, "q3_income": 0.75}
    found = (approximate_quantiles if approximate else exact_quantiles)(df, column, quartiles, [by], moments=True)
    found = found.withColumnsRenamed({"min": "min_income", "max": "max_income", "avg": "avg_income"})
    names = ["min_income", *quartiles, "max_income", "avg_income"]
    return found.select(by, *[ex.round_to(c, 0).alias(c) for c in names])


def median_by_class(df: DataFrame, by: str = fv.TARGET, column: str = "MonthlyIncome") -> DataFrame:
    return exact_quantiles(df, column, {"median": 0.5}, [by])


# --- comparisons with the whole ---------------------------------------------------

def _whole() -> WindowSpec:
    """All rows of a report: one row per group, however large the table behind it."""
    return Window.partitionBy()


def with_baseline(report: DataFrame, rate: str = RATE, total: str = "total", positives: str = "attrited") -> DataFrame:
    """Add the overall rate and each group's gap to it.

    The overall rate is the sum of the groups' own counts, so the table behind
    the report is read once.
    """
    overall = ex.pct(F.sum(positives).over(_whole()), F.sum(total).over(_whole()))
    return report.withColumn("overall_rate_pct", overall).withColumn(
        "gap_pct", ex.round_to(F.col(rate) - F.col("overall_rate_pct"), 1)).orderBy(F.desc(rate), report.columns[0])


def compare_groups(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """Distribution of ``column`` over all rows and over those with the condition, in percent, absent values as 0.

    One aggregation counts both sides.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        rows().alias("n_all"), F.count_if(condition).alias("n_subset"))
    share = lambda n: F.coalesce(
        F.try_divide(100.0 * F.col(n), F.sum(n).over(_whole()).cast("double")), F.lit(0.0))
    return counts.select(column, "n_all", "n_subset", share("n_all").alias("pct_all"),
                         share("n_subset").alias("pct_subset")).orderBy(column)


def min_max_scale(report: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """Position of each value between the smallest and largest; 0 when all are equal."""
    lo, hi = F.min(column).over(_whole()), F.max(column).over(_whole())
    scaled = ex.safe_ratio(F.col(column) - lo, hi - lo)
    return report.withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce(scaled, F.lit(0.0))))


def share_of_max(report: DataFrame, column: str, name: str = "share_of_max") -> DataFrame:
    return report.withColumn(name, ex.safe_ratio(column, F.max(column).over(_whole())))


def flag_maxima(report: DataFrame, column: str, name: str = "is_max") -> DataFrame:
    """Mark every row that reaches the maximum, ties included."""
    return report.withColumn(name, F.col(column) == F.max(column).over(_whole()))


# --- order and top-k --------------------------------------------------------------

def top_k(df: DataFrame, column: str, k: int, tie_break: str) -> DataFrame:
    """Largest ``k`` rows; a per-partition heap, not a global sort."""
    return df.orderBy(F.desc(column), tie_break).limit(k)


def argmax_row(df: DataFrame, column: str, tie_break: str) -> DataFrame:
    return top_k(df, column, 1, tie_break)


# --- chart data -------------------------------------------------------------------

def stacked_headcount(df: DataFrame) -> DataFrame:
    by_department = rate_by(df, ["Department"], rate=None, order=["Department"])
    return by_department.select("Department", F.col("attrited").alias("left"),
                                (F.col("total") - F.col("attrited")).alias("stayed"))


def role_bubble(df: DataFrame, size_per_head: int = 5) -> DataFrame:
    return rate_by_role(df).select("JobRole", "avg_monthly_income", "avg_satisfaction", RATE,
                                   (F.col("total") * size_per_head).alias("bubble_size"))


def heat_pivot(df: DataFrame, columns: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Satisfaction x overtime rates as a matrix; listed columns save a job.

    Other and null overtime values have no column and are left out.
    """
    cells = df.groupBy("JobSatisfaction").pivot("OverTime", list(columns)).agg(ex.pct(leavers(), rows()))
    return cells.orderBy(F.desc("JobSatisfaction")).select(
        ex.ordinal_label().alias("satisfaction"), *[F.col(f"`{c}`") for c in columns])


def histogram_by_class(df: DataFrame, column: str, by: str, classes: Sequence[str], bins: int = 25) -> DataFrame:
    """Equal-width histogram of each class over its own range, empty bins included.

    Bins are left-closed and the last one is closed; a class with a single
    value spreads half a unit to both sides.  ``classes`` bounds what is
    broadcast.
    """
    kept = df.where(F.col(by).isin(*classes) & F.col(column).isNotNull())
    lo, hi = F.min(column).cast("double"), F.max(column).cast("double")
    single = lo == hi
    spans = kept.groupBy(F.col(by).alias("_class")).agg(
        F.when(single, lo - 0.5).otherwise(lo).alias("lo"), F.when(single, hi + 0.5).otherwise(hi).alias("hi"))
    # One row per class, kept for both the counts and the frame of empty bins.
    spans = F.broadcast(settle(spans.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))))

    def edge(i: Column) -> Column:
        return i * F.col("step") + F.col("lo")

    x = F.col(column).cast("double")
    guess = F.least(F.greatest(F.floor((x - F.col("lo")) / F.col("step")), F.lit(0)), F.lit(bins - 1)).cast("int")
    guess_col = F.col("_guess")
    settled = (F.when(x < edge(guess_col), guess_col - 1)
               .when((guess_col < bins - 1) & (x >= edge(guess_col + 1)), guess_col + 1).otherwise(guess_col))
    counted = (kept.join(spans, F.col(by) == F.col("_class")).withColumn("_guess", guess)
               .groupBy(F.col(by).alias("_counted"), settled.alias("_bin")).agg(rows().alias("_n")))

    frame = spans.select("_class", "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(counted), (F.col("_class") == F.col("_counted")) & (F.col("bin") == F.col("_bin")),
                      "left").select(
        F.col("_class").alias(by), "bin", edge(F.col("bin")).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")).orderBy(by, "bin")


