"""Follow-up rule on overtime: runs of consecutive periods, and the last survey before a run's end.

A log has one row per booking (person, time, amount).  A period is a week or a
day; it counts as overtime when the person's bookings in it sum to more than a
limit.  A run is a longest sequence of consecutive overtime periods.

Time is cut into slices, so that one person with a very long history is many
groups: runs and last known values are first found inside a slice, and only the
one or two rows per slice that touch its ends are put together per person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_RUN, LOW_SCORE, DUE_DAYS = 4, 2, 14  # four periods or more, a score below two, a check-in within two weeks
DAYS = {"day": 1, "week": 7}
SLICE_PERIODS = 1024  # periods of a slice in which runs are found
SLICE_SECONDS = 30 * 86_400  # length of a slice in which the last known value is found
MONDAY = 3  # days from the Monday before day 0, which was a Thursday


def period_of(time: Column, period: str = "week") -> Column:
    """Number of the period a time is in, counted from 1970; weeks begin on Monday."""
    day = F.unix_date(F.to_date(time))
    return (day if period == "day" else F.floor((day + MONDAY) / DAYS[period])).cast("long")


def period_end(number: Column, period: str = "week") -> Column:
    """The moment a period ends, which the next one begins with."""
    day = (number + 1) * DAYS[period] - (0 if period == "day" else MONDAY)
    return F.date_from_unix_date(day.cast("int")).cast("timestamp")


def overtime_periods(log: DataFrame, limit: float, person: str = "person", time: str = "ts", amount: str = "hours",
                     period: str = "week") -> DataFrame:
    """(person, period, booked): periods in which a person booked more than ``limit``.

    Amounts are added as decimals with two digits, so the sum does not depend on
    the order of the rows.  Rows without a person, time or amount do not count.
    Rows are combined before the shuffle.
    """
    booked = F.sum(F.col(amount).cast("decimal(18,2)"))
    known = log.where(F.col(person).isNotNull() & F.col(time).isNotNull() & F.col(amount).isNotNull())
    return known.groupBy(F.col(person).alias("person"), period_of(F.col(time), period).alias("period")).agg(
        booked.cast("double").alias("booked"), (booked > F.lit(limit).cast("decimal(18,2)")).alias("over")).where("over").drop("over")


def runs(periods: DataFrame, least: int = LEAST_RUN, slice_periods: int = SLICE_PERIODS) -> DataFrame:
    """(person, first, last, n): longest runs of consecutive periods, of ``least`` or more.

    ``periods`` holds (person, period); repeated rows count once, rows with a
    null do not count.  Inside a slice a run is what period number minus row
    number groups.  A run that ends neither at the beginning nor at the end of
    its slice is complete; the others are joined at the seams.
    """
    known = periods.select("person", F.col("period").cast("long").alias("period")).where(
        F.col("person").isNotNull() & F.col("period").isNotNull())
    sliced = known.withColumn("slice", F.floor(F.col("period") / slice_periods)).dropDuplicates(["person", "slice", "period"])
    inside = Window.partitionBy("person", "slice").orderBy("period")
    parts = sliced.withColumn("island", F.col("period") - F.row_number().over(inside)).groupBy("person", "slice", "island").agg(
        F.min("period").alias("first"), F.max("period").alias("last")).withColumn(
        "at_seam", (F.pmod("first", F.lit(slice_periods)) == 0) | (F.pmod("last", F.lit(slice_periods)) == slice_periods - 1))
    in_order = Window.partitionBy("person").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag("last").over(in_order) + 1, F.lit(True)).cast("int")
    seams = parts.where("at_seam").withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    joined = seams.groupBy("person", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = parts.where("not at_seam").select("person", "first", "last").unionByName(joined.select("person", "first", "last"))
    return found.withColumn("n", F.col("last") - F.col("first") + 1).where(F.col("n") >= least)


def last_before(rows: DataFrame, known: DataFrame, key: str, time: str, known_key: str, known_time: str, order: str,
                strict: bool = True, slice_seconds: int = SLICE_SECONDS, into: str = "last_known") -> DataFrame:
    """``rows`` with a struct ``into``: the row of ``known`` with the same key and the latest time before ``time``.

    ``strict`` leaves out equal times.  Of several with one time the largest
    ``order`` counts, of equal rows any.  Every row stays, with a null struct
    where nothing is known before it, or where its key or time is null; rows of
    ``known`` without key or time do not count.  Column names of both may clash.

    Both tables are united, sorted once per key and slice of time, and the last
    value is carried forward; a slice that has none yet takes it from the one
    row per slice that the slices before it leave.  No inequality join.
    """
    mine = rows.select(F.struct(*rows.columns).alias("mine"), F.col(key).alias("key"), F.col(time).alias("time"))
    latest = F.struct(F.col(known_time).alias("time"), F.col(order).alias("order"), F.struct(*known.columns).alias("row"))
    theirs = known.where(F.col(known_key).isNotNull() & F.col(known_time).isNotNull()).select(
        F.col(known_key).alias("key"), F.col(known_time).alias("time"), F.col(order).alias("order"), latest.alias("theirs"))
    askable = mine.where(F.col("key").isNotNull() & F.col("time").isNotNull())
    # With equal times a strict question stands before the known rows, else behind them.
    both = theirs.withColumn("asks", F.lit(False)).unionByName(askable.withColumn("asks", F.lit(True)), allowMissingColumns=True).withColumns({
        "slice": F.floor(F.unix_timestamp("time") / slice_seconds), "place": F.col("asks") != F.lit(strict)})
    so_far = Window.partitionBy("key", "slice").orderBy("time", "place", "order").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("found", F.last("theirs", ignorenulls=True).over(so_far)).where("asks").select("mine", "key", "slice", "found")
    # One row per key and slice: the last value of the slices before it.
    left = both.groupBy("key", "slice").agg(F.max_by("theirs", F.struct("theirs.time", "theirs.order")).alias("theirs"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("key", "slice", F.last("theirs", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    answered = inside.join(carried, ["key", "slice"], "left").select("mine.*", F.coalesce("found", "carried").getField("row").alias(into))
    silent = mine.where(F.col("key").isNull() | F.col("time").isNull()).select("mine.*", F.lit(None).cast(answered.schema[into].dataType).alias(into))
    return answered.unionByName(silent)


def runs_with_survey(log: DataFrame, surveys: DataFrame, limit: float, period: str = "week", least: int = LEAST_RUN,
                     **slices: int) -> DataFrame:
    """(person, first, last, n, run_end, survey_id, surveyed, score): every run with the last survey before its end.

    ``log`` holds (person, ts, hours), ``surveys`` (person, ts, survey_id,
    score).  A survey without a score is one; it leaves the score null.
    """
    found = runs(overtime_periods(log, limit, period=period), least, slices.get("slice_periods", SLICE_PERIODS)).withColumn(
        "run_end", period_end(F.col("last"), period))
    known = surveys.select("person", "ts", "survey_id", "score")
    asked = last_before(found, known, "person", "run_end", "person", "ts", "survey_id",
                        slice_seconds=slices.get("slice_seconds", SLICE_SECONDS))
    return asked.select("person", "first", "last", "n", "run_end", F.col("last_known.survey_id").alias("survey_id"),
                        F.col("last_known.ts").alias("surveyed"), F.col("last_known.score").alias("score"))


def follow_ups(runs_and_scores: DataFrame, low: int = LOW_SCORE, due_days: int = DUE_DAYS) -> DataFrame:
    """Runs whose last survey is below ``low``, with the time until which someone has to check in."""
    return runs_and_scores.where(F.col("score") < low).withColumn("due", F.col("run_end") + F.make_dt_interval(F.lit(due_days)))
