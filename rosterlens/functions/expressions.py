"""Column builders: every row-level rule as a JVM-side expression.

The same builders serve reports, training and scoring, so a rule has exactly
one definition.  Nothing here is a Python UDF; all of it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: ColumnOrName, digits: int) -> Column:
    """Round half away from zero at ``digits`` decimals by scaling.

    ``round(double, d)`` works on the decimal text of the number and differs
    from scaling engines for values such as 23/40; scaling first agrees.
    """
    if digits == 0:
        return F.round(_col(c).cast("double"), 0)
    scale = float(10**digits)
    return F.round(_col(c) * F.lit(scale), 0) / F.lit(scale)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` as double, null when the denominator is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def pct(num: ColumnOrName, den: ColumnOrName, digits: int = 1) -> Column:
    """``100 * num / den`` rounded; double arithmetic, never decimal."""
    return round_to(F.try_divide(F.lit(100.0) * _col(num), _col(den).cast("double")), digits)


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds; null and unmatched take ``default``."""
    head, *tail = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), tail, F.when(head[0], F.lit(head[1])))
    return chain.otherwise(F.lit(default))


def order_of(c: ColumnOrName, labels: tuple[str, ...]) -> Column:
    """Position of a bucket label in its display order; unknown labels come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), _col(c)), F.lit(0)),
                      F.lit(len(labels) + 1))


# --- features ------------------------------------------------------------------

def left_company(c: ColumnOrName = fv.TARGET) -> Column:
    return _col(c) == "Yes"


def attrition_flag(c: ColumnOrName = fv.TARGET) -> Column:
    return F.when(left_company(c), 1).otherwise(0)


def age_group(c: ColumnOrName = "Age") -> Column:
    age, names = _col(c), fv.AGE_GROUPS
    return first_match(
        [(age < 25, names[0]), (age.between(25, 34), names[1]),
         (age.between(35, 44), names[2]), (age.between(45, 54), names[3])], names[4])


def tenure_bucket(c: ColumnOrName = "YearsAtCompany") -> Column:
    years, names = _col(c), fv.TENURE_BUCKETS
    return first_match(
        [(years == 0, names[0]), (years.between(1, 2), names[1]),
         (years.between(3, 5), names[2]), (years.between(6, 10), names[3])], names[4])


def income_band(c: ColumnOrName = "MonthlyIncome") -> Column:
    income, names = _col(c), fv.INCOME_BANDS
    return first_match([(income < 3000, names[0]), (income.between(3000, 7000), names[1])], names[2])


def satisfaction_tier(c: ColumnOrName = "JobSatisfaction") -> Column:
    return first_match([(_col(c).isin(1, 2), fv.SATISFACTION_TIERS[0])], fv.SATISFACTION_TIERS[1])


def last_promotion(c: ColumnOrName = "YearsSinceLastPromotion") -> Column:
    years, names = _col(c), fv.PROMOTION_BUCKETS
    return first_match(
        [(years == 0, names[0]), (years.between(1, 2), names[1]), (years.between(3, 5), names[2])], names[3])


def stalled_promotion_flag(c: ColumnOrName = "YearsSinceLastPromotion") -> Column:
    return F.when(_col(c) >= 3, 1).otherwise(0)


def satisfaction_composite(
    job: ColumnOrName = "JobSatisfaction",
    environment: ColumnOrName = "EnvironmentSatisfaction",
    relationship: ColumnOrName = "RelationshipSatisfaction",
    balance: ColumnOrName = "WorkLifeBalance",
) -> Column:
    return round_to((_col(job) + _col(environment) + _col(relationship) + _col(balance)) / F.lit(4.0), 2)


def manager_tenure_gap(
    company: ColumnOrName = "YearsAtCompany", manager: ColumnOrName = "YearsWithCurrManager"
) -> Column:
    return _col(company) - _col(manager)


def derived_features() -> dict[str, Column]:
    """The three engineered model inputs, by output name."""
    return {
        "stalled_promotion_flag": stalled_promotion_flag(),
        "satisfaction_composite": satisfaction_composite(),
        "manager_tenure_gap": manager_tenure_gap(),
    }


def triple_risk() -> Column:
    """Overtime, satisfaction of at most 2, tenure of at most 2 years."""
    return (F.col("OverTime") == "Yes") & (F.col("JobSatisfaction") <= 2) & (F.col("YearsAtCompany") <= 2)


# --- labels --------------------------------------------------------------------

def lookup(c: ColumnOrName, table: dict) -> Column:
    """Value from a fixed table; keys that are absent stay as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, _col(c)), _col(c).cast("string"))


def ordinal_label(c: ColumnOrName = "JobSatisfaction") -> Column:
    return lookup(_col(c).cast("int"), fv.SATISFACTION_LABELS)


def display_name(c: ColumnOrName = "feature") -> Column:
    return lookup(c, fv.DISPLAY_NAMES)


def severity_band(rate: ColumnOrName) -> Column:
    return first_match([(_col(rate) >= 20, "high"), (_col(rate) >= 15, "medium")], "low")


def direction(value: ColumnOrName, threshold: float = 0.0) -> Column:
    return first_match([(_col(value) > threshold, "increases")], "reduces")


def _hundredths(s: Column) -> Column:
    """``s * 100`` rounded to an integer as C-style formatting rounds ``s`` to two decimals.

    That works on the exact binary value and settles true ties to even.  When
    the product lands on a tie, the error of the multiplication tells on which
    side the exact value is; it is exact because 100 and the halves of ``s``
    have few bits.
    """
    t = s * 100.0
    split = s * 134217729.0
    high = split - (split - s)
    error = (high * 100.0 - t) + (s - high) * 100.0
    tie = t - F.floor(t) == 0.5
    return (F.when(tie & (error > 0), F.ceil(t)).when(tie & (error < 0), F.floor(t))
            .otherwise(F.rint(t).cast("bigint")))


def format_amount(c: ColumnOrName) -> Column:
    """Short money text: ``$1.25M``, ``$48K`` or the bare integer below 1000."""
    x = _col(c).cast("double")
    cents = _hundredths(x / 1e6)
    return (
        F.when(x >= 1e6, F.format_string("$%d.%02dM", F.floor(cents / 100), cents % 100))
        .when(x >= 1e3, F.format_string("$%.0fK", F.rint(x / 1e3)))
        .otherwise(x.cast("bigint").cast("string"))
    )


def category_text(c: ColumnOrName) -> Column:
    """Categorical value as text; a missing value becomes the category ``nan``."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


# --- scores --------------------------------------------------------------------

def risk_tier_cut(p: ColumnOrName) -> Column:
    """Right-closed tiers over (0, .30], (.30, .55], (.55, 1]; outside is null."""
    score, (high, medium, low) = _col(p), fv.RISK_TIERS
    return (
        F.when((score > 0) & (score <= fv.MEDIUM_RISK), low)
        .when((score > fv.MEDIUM_RISK) & (score <= fv.HIGH_RISK), medium)
        .when((score > fv.HIGH_RISK) & (score <= 1), high)
    )


def risk_tier_threshold(p: ColumnOrName) -> Column:
    """Left-closed tiers of the scoring form: .55 is high, .30 is medium, 0 is low."""
    high, medium, low = (name.upper() for name in fv.RISK_TIERS)
    return first_match([(_col(p) >= fv.HIGH_RISK, high), (_col(p) >= fv.MEDIUM_RISK, medium)], low)


def verdict(p: ColumnOrName) -> Column:
    return first_match([(_col(p) >= fv.LEAVE_THRESHOLD, "likely to leave")], "likely to stay")


def score_pct(p: ColumnOrName) -> Column:
    return round_to(_col(p) * 100.0, 1)
