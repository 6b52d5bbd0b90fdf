"""Queries over time: overtime runs and follow-ups, change reports, stored sketches, large dictionaries, streams.

``events`` stands for the log: a signup is a survey with a score of 1 to 4, every
other event books its value.  The table covers one month, so days stand for weeks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import changes, dictionary, overtime, prep, reports, scoring, sketches
from rosterlens.sources import tables
from rosterlens.sources.artifacts import RiskModel, load_artifacts, new_version, publish, save_artifacts
from rosterlens.sources.hr_fixture import hr_raw
from rosterlens.streaming import overtime as overtime_stream
from rosterlens.streaming import repeats
from rosterlens.streaming.scoring import start_scoring, write_profiles

Query = Callable[[SparkSession, str], DataFrame]
LIMIT = 20.0  # booked above this, a day counts as overtime
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/rosterlens/{spark.sparkContext.applicationId}/{name}/{uuid.uuid4().hex}"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings and surveys as one log."""
    events, survey = _table(spark, sf_dir, "events"), F.col("event_type") == "signup"
    return events.select(
        F.col("user_id").alias("person"), F.col("ts").cast("timestamp").alias("ts"), F.when(~survey, F.col("value")).alias("hours"),
        F.when(survey, F.col("event_id")).alias("survey_id"), F.when(survey, (1 + F.floor("value") % 4).cast("int")).alias("score"))


def _runs_with_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir)
    return overtime.runs_with_survey(signals.where("hours is not null"), signals.where("survey_id is not null"), LIMIT, period="day")


def _readable(rows: DataFrame, due: str | None = None) -> DataFrame:
    day = lambda c: F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd").alias(f"{c}_day")
    return rows.select("person", day("first"), day("last"), "n", "survey_id", "score",
                       *([F.date_format(due, "yyyy-MM-dd").alias("due_day")] if due else []))


def overtime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of four or more overtime days; slices of eight days, so that runs cross seams."""
    days = overtime.overtime_periods(_signals(spark, sf_dir), LIMIT, period="day")
    return overtime.runs(days, slice_periods=8)


def survey_before_run_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with the last survey before its end."""
    return _readable(_runs_with_survey(spark, sf_dir))


def overtime_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose last survey was low, with the day until which someone has to check in."""
    return _readable(overtime.follow_ups(_runs_with_survey(spark, sf_dir)), "due")


def streamed_overtime_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: the log in files of mixed days, then a restart that only moves the watermark on."""
    incoming, target, marks = (f"{_folder(spark, 'follow-ups')}/{part}" for part in ("in", "out", "checkpoint"))
    signals, delay = _signals(spark, sf_dir), 40
    signals.repartition(6, F.xxhash64("ts")).write.parquet(incoming)
    groups = overtime_stream.groups_for(signals)

    def work_off(files: int) -> None:
        stream = overtime_stream.signal_stream(spark, incoming, files_per_trigger=files)
        found = overtime_stream.streamed_follow_ups(stream, LIMIT, f"{delay} days", period="day", groups=groups)
        overtime_stream.start_follow_ups(found, target, f"follow_ups_{uuid.uuid4().hex}", marks).awaitTermination()

    work_off(2)
    heartbeat = signals.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("person"), (F.col("ts") + F.make_dt_interval(F.lit(delay + 5))).alias("ts"),
        F.lit(None).cast("double").alias("hours"), F.lit(None).cast("long").alias("survey_id"), F.lit(None).cast("int").alias("score"))
    heartbeat.write.mode("append").parquet(incoming)
    work_off(100)
    found = spark.read.schema(overtime_stream.FOLLOW_UP_SCHEMA).parquet(target)
    return _readable(found, "due")


# --- change reports ---------------------------------------------------------------------------

def _monthly_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, person): customers with a triple-risk row among their orders of a month."""
    people = reports.triple_risk_employees(hr_raw(spark, sf_dir)).select(F.col(fv.ID).alias("o_orderkey"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", changes.month_number(F.col("o_orderdate")).alias("month"))
    return people.join(orders, "o_orderkey").select("month", F.col("o_custkey").alias("person"))


def triple_risk_monthly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entered, stayed on and left the triple-risk list, month by month."""
    return changes.changes_over_time(_monthly_list(spark, sf_dir), "month", ["person"])


def triple_risk_list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who entered, stayed on and left the list from each of the last three months to the next, from stored snapshots."""
    found = _monthly_list(spark, sf_dir)
    final = found.agg(F.max("month").alias("final")).scalar()
    stored = tables.create_or_replace(found.where(F.col("month") > final - 3).distinct().withColumn("back", final - F.col("month")),
                                      _folder(spark, "lists"), partition_by=["back"])
    month = lambda back: stored.where(F.col("back") == back)
    pairs = [changes.snapshot_changes(month(back + 1), month(back), ["person"]).withColumn("months_back", F.lit(back)) for back in (1, 0)]
    return pairs[0].unionByName(pairs[1])


# --- stored sketches --------------------------------------------------------------------------

def quartiles_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quartiles of order totals, merged from stored monthly sketches, keep the stated rank error."""
    orders = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", changes.month_number(F.col("o_orderdate")).alias("month"))
    kept = tables.create_or_replace(sketches.quantile_sketches(orders, "o_totalprice", ["o_orderstatus", "month"]), _folder(spark, "quantiles"))
    merged = sketches.merged_quantiles(kept, QUARTILES, ["o_orderstatus"])
    return sketches.rank_within(orders, "o_totalprice", merged, QUARTILES, ["o_orderstatus"]).join(
        F.broadcast(merged.select("o_orderstatus", "n")), "o_orderstatus")


def people_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per event type: exact, and whether the merged daily sketches keep the stated error."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = tables.create_or_replace(sketches.distinct_sketches(events, "user_id", ["event_type", "day"]), _folder(spark, "distinct"))
    exact = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("people"))
    error = F.abs(F.col("n_distinct") - F.col("people"))
    return exact.join(sketches.merged_distinct(kept, ["event_type"]), "event_type").select(
        "event_type", "people", (error <= sketches.distinct_error() * F.col("people")).alias("within"))


# --- large dictionaries -----------------------------------------------------------------------

def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the code of a text that nearly every order has for itself."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 97).cast("string")).alias("code"))
    return dictionary.encode_column(orders, "code", dictionary.dictionary(orders, "code", ranges=7))


# --- scoring on a model that SQL can follow -----------------------------------------------------

def stump_model(spark: SparkSession, sf_dir: str) -> RiskModel:
    """One tree of depth one on overtime, with the encoder and defaults of the whole table, saved like any model."""
    from rosterlens.operators import models

    frame = prep.model_frame(hr_raw(spark, sf_dir))
    encoder = prep.feature_pipeline(["OverTime"]).fit(frame)
    forest = models.fit_forest(prep.design_matrix(frame, encoder), trees=1, depth=1, bootstrap=False)
    return save_artifacts(_folder(spark, "stump-model"), encoder, forest, ("OverTime",), prep.default_values(frame))


def defaults_after_going_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default values of a model whose next version, of one department only, was published and taken back."""
    first, path = stump_model(spark, sf_dir), _folder(spark, "versions")
    frame = prep.model_frame(hr_raw(spark, sf_dir))
    folders = []
    for rows in (frame, frame.where("Department = 'Sales'")):
        folders.append(new_version(path))
        save_artifacts(folders[-1], first.encoder, first.forest, first.features, prep.default_values(rows))
        publish(spark, path, folders[-1])
    publish(spark, path, folders[0])
    return load_artifacts(spark, path).defaults


def _open_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all employees, overtime left open for every eleventh."""
    open_when = {"Age": 3, "MonthlyIncome": 5, "JobRole": 7, "OverTime": 11}
    fields = [F.when(F.col(fv.ID) % open_when[c] != 0, F.col(c)).alias(c) if c in open_when else F.col(c)
              for c in fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES]
    return hr_raw(spark, sf_dir).select(F.col(fv.ID).alias(scoring.PROFILE_ID), *fields)


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select(scoring.PROFILE_ID, F.round(F.col("probability"), 6).alias("probability"), "risk_tier", "verdict")


def stump_profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every what-if profile scored by the stump."""
    return _shown(scoring.score_profiles(stump_model(spark, sf_dir), _open_profiles(spark, sf_dir)))


def stump_profile_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved every profile's score on the stump."""
    model = stump_model(spark, sf_dir)
    found = scoring.explain_profiles(model, scoring.score_profiles(model, _open_profiles(spark, sf_dir)))
    return found.select(scoring.PROFILE_ID, "feature", F.round("shap", 6).alias("shap"), "direction")


def streamed_profiles_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that arrive twice, in files and across a restart, scored once each by the stump."""
    incoming, target, marks = (f"{_folder(spark, 'once')}/{part}" for part in ("in", "out", "checkpoint"))
    model = stump_model(spark, sf_dir)
    profiles = _open_profiles(spark, sf_dir).withColumn(
        repeats.ARRIVED, F.timestamp_seconds(F.lit(1_700_000_000) + F.col(scoring.PROFILE_ID) % 86_400))

    def arrive(rows: DataFrame) -> None:
        files = write_profiles(rows, incoming)
        stream = repeats.first_arrivals(repeats.timed_profile_stream(spark, incoming, files_per_trigger=files))
        start_scoring(model, stream, target, f"once_{uuid.uuid4().hex}", marks).awaitTermination()

    half = F.col(scoring.PROFILE_ID) % 2 == 0
    arrive(profiles.where(half).unionByName(profiles.where(half)))
    arrive(profiles)  # the first half once more, after a restart
    return _shown(spark.read.parquet(target))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    overtime_runs, survey_before_run_end, overtime_follow_ups, streamed_overtime_follow_ups, triple_risk_monthly_changes,
    triple_risk_list_changes, quartiles_from_sketches, people_from_sketches, dictionary_codes, stump_profile_scores,
    stump_profile_factors, streamed_profiles_once, defaults_after_going_back)}
