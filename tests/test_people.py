"""Overtime runs, as-of values, streams, change reports, sketches and large dictionaries."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import changes, dictionary, overtime, sketches
from rosterlens.plans import people, people_oracle
from rosterlens.streaming import overtime as overtime_stream
from rosterlens.streaming import repeats
from tests.compare import connect, difference
from tests.conftest import SMALL

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(people.QUERIES))
def test_matches_sql(spark, name):
    assert difference(people.QUERIES[name](spark, SMALL), connect(SMALL), people_oracle.ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(people.QUERIES) == set(people_oracle.ORACLE)


# --- runs ------------------------------------------------------------------------------

def plain_runs(rows, least):
    found = []
    for person in {p for p, t in rows if p is not None and t is not None}:
        periods = sorted({t for p, t in rows if p == person and t is not None})
        first = last = periods[0]
        for t in [*periods[1:], None]:
            if t is None or t != last + 1:
                if last - first + 1 >= least:
                    found.append((person, first, last, last - first + 1))
                first = t
            last = t
    return sorted(found)


@pytest.mark.parametrize("size", [1, 2, 7, 1024])
def test_runs_do_not_depend_on_the_slices(spark, size):
    rng = random.Random(size)
    rows = [(p, t) for p in range(12) for t in range(-40, 90) if rng.random() < 0.3 + p / 18]
    rows += [(50, t) for t in range(-500, 700)] + [(51, t) for t in range(0, 64)] + [(52, 7), (52, 8)]  # seams in the middle and at the ends
    rows += rows[:30] + [(None, 3), (4, None), (None, None)]
    periods = spark.createDataFrame(rows, "person long, period long").repartition(5)
    for least in (1, 4):
        got = sorted(tuple(r) for r in overtime.runs(periods, least, size).select("person", "first", "last", "n").collect())
        assert got == plain_runs(rows, least)
    assert overtime.runs(periods.limit(0)).collect() == []


def test_periods(spark):
    times = [START + timedelta(hours=7 * i) for i in range(-200, 200)] + [datetime(1969, 12, 28, 23), datetime(1969, 12, 29), datetime(1970, 1, 4, 23)]
    frame = spark.createDataFrame([(t,) for t in times], "t timestamp").select(
        "t", overtime.period_of(F.col("t")).alias("week"), overtime.period_of(F.col("t"), "day").alias("day"))
    ends = frame.select("*", overtime.period_end(F.col("week")).alias("we"), overtime.period_end(F.col("day"), "day").alias("de"))
    for r in ends.collect():
        monday = datetime(r["t"].year, r["t"].month, r["t"].day) - timedelta(days=r["t"].weekday())
        assert r["week"] == (monday - datetime(1969, 12, 29)).days // 7 and r["we"] == monday + timedelta(days=7)
        assert r["de"] == datetime(r["t"].year, r["t"].month, r["t"].day) + timedelta(days=1)


def test_amounts_add_up_exactly_and_gaps_do_not_count(spark):
    rows = [(1, START, 0.1)] * 3 + [(2, START, 0.3), (2, START, 0.01), (3, START, None), (None, START, 9.0), (4, None, 9.0)]
    log = spark.createDataFrame(rows, "person long, ts timestamp, hours double")
    found = {r["person"]: r["booked"] for r in overtime.overtime_periods(log, 0.3).collect()}
    assert found == {2: 0.31}  # three times 0.1 is 0.3, not more


# --- as-of values ------------------------------------------------------------------------

@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seconds", [5, 40, 10**9])
def test_last_before_equals_brute_force(spark, strict, seconds):
    rng = random.Random(3)
    moment = lambda: START + timedelta(seconds=rng.randrange(200))
    asked = [(i, rng.choice([1, 2, 3, 4]), moment(), "mine") for i in range(120)] + [(200, None, START, "x"), (201, 1, None, "x"), (202, 99, START, "x")]
    known = [(rng.choice([1, 1, 1, 2, 3]), moment(), i, f"v{i}") for i in range(150)] + [(None, START, 900, "no"), (1, None, 901, "no")]
    rows = spark.createDataFrame(asked, "id long, key long, time timestamp, row string").repartition(4)
    values = spark.createDataFrame(known, "key long, time timestamp, place long, row string").repartition(3)
    found = overtime.last_before(rows, values, "key", "time", "key", "time", "place", strict, seconds)
    got = {r["id"]: (r["row"], r["last_known"] and r["last_known"]["place"]) for r in found.collect()}
    expected = {}
    for i, key, time, mine in asked:
        earlier = [(t, n) for k, t, n, _ in known if None not in (k, t, key, time) and k == key and (t < time or t == time and not strict)]
        expected[i] = (mine, max(earlier)[1] if earlier else None)
    assert got == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- the stream ----------------------------------------------------------------------------

def signal_rows(rng, people_, days):
    rows, survey = [], 0
    for p in people_:
        for d in range(days):
            for _ in range(rng.randrange(0, 4)):
                rows.append((p, START + timedelta(days=d, seconds=rng.randrange(86_400)), round(rng.uniform(0, 20), 2), None, None))
            if rng.random() < 0.4:
                survey += 1
                rows.append((p, START + timedelta(days=d, seconds=rng.randrange(86_400)), None, survey, rng.choice([1, 1, 2, 3, None])))
    return rows


def batch_answer(spark, rows, limit):
    signals = spark.createDataFrame(rows, overtime_stream.SIGNAL_SCHEMA)
    with_survey = overtime.runs_with_survey(signals.where("hours is not null"), signals.where("survey_id is not null"), limit, "day")
    return sorted(tuple(r[c] for c in ("person", "first", "last", "survey_id", "due")) for r in overtime.follow_ups(with_survey).collect())


def replay(spark, tmp_path, batches, limit, delay):
    incoming, out, marks = (str(tmp_path / name) for name in ("in", "out", "marks"))
    for rows in batches:  # every batch is a run of its own, which goes on from the checkpoint
        spark.createDataFrame(rows, overtime_stream.SIGNAL_SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        stream = overtime_stream.signal_stream(spark, incoming)
        overtime_stream.start_follow_ups(overtime_stream.streamed_follow_ups(stream, limit, delay, "day"), out,
                                         re.sub(r"\W", "_", str(tmp_path)), marks).awaitTermination()
    found = spark.read.schema(overtime_stream.FOLLOW_UP_SCHEMA).parquet(out).collect()
    return sorted(tuple(r[c] for c in ("person", "first", "last", "survey_id", "due")) for r in found)


def test_stream_of_shuffled_batches_gives_the_batch_answer(spark, tmp_path):
    rng = random.Random(8)
    rows = signal_rows(rng, range(30), 30)
    expected = batch_answer(spark, rows, 12)
    assert len(expected) > 4
    late = sorted(rows, key=lambda r: r[1] + timedelta(days=rng.uniform(0, 4)))  # up to four days out of order
    cut = len(late) // 4
    batches = [late[:cut], late[cut:2 * cut], late[2 * cut:3 * cut], late[3 * cut:], [(-1, START + timedelta(days=60), None, None, None)]]
    assert replay(spark, tmp_path, batches, 12, "5 days") == expected


def test_signals_behind_the_watermark_are_ignored(spark, tmp_path):
    run = [(1, START + timedelta(days=d, hours=1), 20.0, None, None) for d in range(4)] + [(1, START + timedelta(hours=2), None, 1, 1)]
    mark = [(-1, START + timedelta(days=20), None, None, None)]
    too_late = [(1, START + timedelta(days=4, hours=1), 20.0, None, None), (1, START + timedelta(days=3, hours=3), None, 2, 4)]
    final = [(-1, START + timedelta(days=40), None, None, None)]
    got = replay(spark, tmp_path, [run, mark, too_late, final], 12, "2 days")
    assert got == batch_answer(spark, run, 12) and len(got) == 1


@pytest.mark.parametrize("groups", [1, 3])
def test_persons_share_the_calls_and_the_state_of_a_group(spark, tmp_path, groups):
    rng = random.Random(5)
    rows = signal_rows(rng, range(-3, 60), 20)
    incoming, out, marks = (str(tmp_path / name) for name in ("in", "out", "marks"))
    keys = []
    for part in (rows[::2], rows[1::2], [(-9, START + timedelta(days=60), None, None, None)]):
        spark.createDataFrame(part, overtime_stream.SIGNAL_SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        found = overtime_stream.streamed_follow_ups(overtime_stream.signal_stream(spark, incoming), 12, "25 days", "day", groups=groups)
        query = overtime_stream.start_follow_ups(found, out, f"shared_{groups}", marks)
        query.awaitTermination()
        keys += [operator["numRowsTotal"] for progress in query.recentProgress for operator in progress["stateOperators"]]
    got = sorted(tuple(r[c] for c in ("person", "first", "last", "survey_id", "due")) for r in spark.read.parquet(out).collect())
    assert got == batch_answer(spark, rows, 12) and len({r[0] for r in got}) > 3
    assert max(keys) == groups  # not one for each of the 64 persons


def test_groups_follow_the_number_of_persons(spark):
    signals = spark.range(1000).select((F.col("id") % 250).alias("person"))
    assert 2 <= overtime_stream.groups_for(signals) <= 4 and overtime_stream.groups_for(signals.limit(0)) == 1


def test_state_does_not_grow_with_the_history():
    state, size = overtime_stream.PersonState(), []
    for day in range(2000):
        state.add(day, 100_000 if day % 9 else 0, [day, day, 1])
        list(state.close(day - 5, 1000))
        state = overtime_stream.PersonState(state.text())
        size.append(len(state.text()))
    assert max(size[1000:]) <= max(size[:1000]) + 40 and len(state.open) == 5


def test_repeated_profiles_are_left_out_across_a_restart(spark, tmp_path):
    incoming, out, marks = (str(tmp_path / name) for name in ("in", "out", "marks"))

    def arrive(rows):
        frame = spark.createDataFrame(rows, "profile_id long, arrived timestamp, Age double")
        frame.coalesce(1).write.mode("append").json(incoming)
        stream = repeats.first_arrivals(repeats.timed_profile_stream(spark, incoming, files_per_trigger=1), "2 days").select("profile_id", "Age")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    day = lambda d: START + timedelta(days=d)
    arrive([(1, day(0), 1.0), (2, day(0), 1.0), (1, day(1), 1.0), (3, None, 1.0)])
    arrive([(1, day(1), 2.0), (2, day(1), 2.0), (4, day(1), 2.0)])
    arrive([(5, day(30), 3.0)])
    arrive([(6, day(2), 4.0), (7, day(30), 4.0)])  # the first is behind the watermark
    got = sorted((r["profile_id"], r["Age"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1.0), (2, 1.0), (4, 2.0), (5, 3.0), (7, 4.0)]


# --- change reports, sketches, dictionaries ----------------------------------------------------

def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "person long, team string")
    new = spark.createDataFrame([(2, "x"), (3, None), (None, "d")], "person long, team string")
    got = {r["person"]: (r["state"], r["team_before"], r["team_after"]) for r in changes.snapshot_changes(old, new, ["person"], ["team"]).collect()}
    assert got == {1: ("left", "a", None), 2: ("stayed", "b", "x"), 3: ("entered", None, None)}
    assert changes.snapshot_changes(old.limit(0), new.limit(0), ["person"]).collect() == []


def test_changes_over_time_count_empty_periods(spark):
    rows = [(1, 10), (2, 10), (2, 11), (3, 11), (2, 14), (2, 14), (None, 12), (5, None)]
    got = [tuple(r) for r in changes.changes_over_time(spark.createDataFrame(rows, "person long, p long"), "p", ["person"]).orderBy("period").collect()]
    assert got == [(11, 1, 1, 1), (12, 0, 0, 2), (13, 0, 0, 0), (14, 1, 0, 0)]
    assert changes.changes_over_time(spark.createDataFrame(rows[:2], "person long, p long"), "p", ["person"]).collect() == []


def test_sketches_merge(spark):
    rows = spark.range(200_000).select((F.col("id") % 40).alias("day"), (F.col("id") % 3).alias("team"), F.when(
        F.col("id") % 10 > 0, (F.col("id") * 7919) % 100_003).alias("x"))
    kept = sketches.quantile_sketches(rows, "x", ["team", "day"]).cache()
    probabilities = {"low": 0.01, "mid": 0.5, "high": 0.99}
    merged = sketches.merged_quantiles(kept, probabilities, ["team"])
    checks = sketches.rank_within(rows, "x", merged, probabilities, ["team"]).collect()
    assert len(checks) == 9 and all(r["within"] for r in checks)
    assert {r["n"] for r in merged.collect()} == {60_000} and merged.count() == 3
    wrong = merged.withColumn("mid", F.col("high"))
    assert not all(r["within"] for r in sketches.rank_within(rows, "x", wrong, probabilities, ["team"]).collect())
    assert abs(sketches.merged_ranks(kept, {"half": 50_001}).first()["half"] - 0.5) < 0.02
    people_ = sketches.merged_distinct(sketches.distinct_sketches(rows, "x", ["day"]))
    assert abs(people_.first()["n_distinct"] / rows.select("x").where("x is not null").distinct().count() - 1) < sketches.distinct_error()


def test_a_million_values_are_encoded_like_dense_rank(spark, tmp_path):
    rows = spark.range(1_100_000).select(F.col("id"), F.md5((F.col("id") % 1_000_000).cast("string")).alias("value"))
    encoded = dictionary.encode_column(rows, "value", dictionary.dictionary(rows, "value"))
    rows.write.parquet(str(tmp_path / "rows"))
    encoded.write.parquet(str(tmp_path / "codes"))
    wrong = duckdb.connect().execute(f"""SELECT count(*) FROM read_parquet('{tmp_path}/codes/*.parquet') c FULL JOIN (
        SELECT id, dense_rank() OVER (ORDER BY value) - 1 AS code FROM read_parquet('{tmp_path}/rows/*.parquet')) r ON r.id = c.id
        WHERE c.value IS DISTINCT FROM r.code""").fetchone()[0]
    assert wrong == 0


def test_dictionary_of_awkward_values(spark):
    rows = spark.createDataFrame([(1, "b", "u"), (2, None, "u"), (3, "é", "u"), (4, "B", "u"), (5, "b", "u"), (6, "", "u")], "code long, word string, value string")
    codes = dictionary.dictionary(rows, "word", ranges=3)
    encoded = dictionary.encode_column(rows, "word", codes)
    order = sorted({"b", "é", "B", "", dictionary.MISSING})
    assert {r["code"]: r["word"] for r in encoded.collect()} == {k: order.index(w) for k, w in
                                                                  {1: "b", 2: dictionary.MISSING, 3: "é", 4: "B", 5: "b", 6: ""}.items()}
    assert encoded.columns == rows.columns and {r["value"] for r in encoded.collect()} == {"u"}
    assert {r["word"] for r in dictionary.decode_column(encoded, "word", codes).collect()} == set(order)
    new = spark.createDataFrame([(9, "new", "u")], rows.schema)
    assert dictionary.encode_column(new, "word", codes, unseen="null").first()["word"] is None
    with pytest.raises(Exception, match="unseen value for word"):
        dictionary.encode_column(new, "word", codes).collect()
    assert dictionary.dictionary(rows.limit(0), "word").collect() == []
