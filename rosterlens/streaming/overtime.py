"""The follow-up rule on a stream of bookings and surveys, with bounded state per person.

A person's state holds, for every period that may still change, the sum booked
and the last survey, and of the past only the run that may still go on and the
last survey.  When the watermark has passed a period's end the period is closed,
in order of time; a closed period without overtime ends the run, which is then
reported if it was long enough and the last survey before its end was low.

A call of the Python function costs milliseconds, whatever it is given, so
persons share calls: a group of about a hundred persons is one key, whose state
holds the states of its persons.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterlens.operators.overtime import DAYS, DUE_DAYS, LEAST_RUN, LOW_SCORE, MONDAY
from rosterlens.sources.tables import shared_dir

SIGNAL_SCHEMA = "person BIGINT, ts TIMESTAMP, hours DOUBLE, survey_id BIGINT, score INT"
FOLLOW_UP_SCHEMA = ("person BIGINT, first BIGINT, last BIGINT, n BIGINT, run_end TIMESTAMP, survey_id BIGINT, surveyed TIMESTAMP, "
                    "score INT, due TIMESTAMP")
STATE_SCHEMA = "state STRING"
DAY_SECONDS = 86_400
GROUPS, GROUP_PERSONS = 1024, 100  # groups of persons that share a key, where nothing is known; persons to aim at in one


def signal_stream(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Signals from new files in a folder: a booking has hours, a survey an id and a score."""
    return (spark.readStream.format(fmt).schema(SIGNAL_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).load(folder))


def groups_for(signals: DataFrame, persons: int = GROUP_PERSONS) -> int:
    """Groups of about ``persons`` persons each, for a table like the one that will be streamed; one aggregate."""
    return max(1, -(-signals.agg(F.approx_count_distinct("person")).first()[0] // persons))


class PersonState:
    """What is kept of one person between batches; all of it fits one short text.

    ``open`` maps a period to [cents booked, last survey or None], a survey being
    [microseconds, id, score].  ``run`` is [first, last, last survey before its
    end] or None, ``survey`` the last one of the closed periods, ``closed`` the
    last closed period.
    """

    def __init__(self, text: str | None = None):
        self._take(json.loads(text) if text else {"open": {}, "run": None, "survey": None, "closed": None})

    def _take(self, kept: dict) -> None:
        self.open = {int(p): v for p, v in kept["open"].items()}
        self.run, self.survey, self.closed = kept["run"], kept["survey"], kept["closed"]

    def _kept(self) -> dict:
        return {"open": self.open, "run": self.run, "survey": self.survey, "closed": self.closed}

    def text(self) -> str:
        return json.dumps(self._kept())

    @staticmethod
    def of_group(text: str) -> dict[int, PersonState]:
        """The persons of a group by number."""
        people = {}
        for person, kept in json.loads(text).items():
            people[int(person)] = state = PersonState()
            state._take(kept)
        return people

    @staticmethod
    def group_text(people: dict[int, PersonState]) -> str:
        return json.dumps({person: state._kept() for person, state in people.items()})

    def add(self, period: int, cents: int, survey: list | None) -> None:
        """Count what arrived for a period; a closed period changes no more."""
        if self.closed is not None and period <= self.closed:
            return
        entry = self.open.setdefault(period, [0, None])
        entry[0] += cents
        if survey and (entry[1] is None or survey[:2] > entry[1][:2]):
            entry[1] = survey

    def close(self, upto: int, limit_cents: int) -> Iterator[list]:
        """Close all periods up to this one; the runs [first, last, survey] that this ends."""
        for period in sorted(p for p in self.open if p <= upto):
            cents, survey = self.open.pop(period)
            if self.run and period > self.run[1] + 1:
                yield self.run
                self.run = None
            self.survey = survey or self.survey
            if cents > limit_cents:
                self.run = [self.run[0] if self.run else period, period, self.survey]
        if self.run and upto > self.run[1]:
            yield self.run
            self.run = None
        self.closed = upto if self.closed is None else max(self.closed, upto)

    def next_period(self) -> int | None:
        """The period whose end changes something; None when nothing is open."""
        waiting = [*self.open, *([self.run[1] + 1] if self.run else [])]
        return min(waiting, default=None)


def _moment(seconds: float) -> datetime:
    return datetime(1970, 1, 1) + timedelta(seconds=seconds)


def streamed_follow_ups(signals: DataFrame, limit: float, delay: str, period: str = "week", least: int = LEAST_RUN,
                        low: int = LOW_SCORE, due_days: int = DUE_DAYS, groups: int = GROUPS) -> DataFrame:
    """Follow-ups as their runs come to an end; ``signals`` is a stream of ``SIGNAL_SCHEMA``.

    A signal may arrive up to ``delay`` late, in any order and batch, and the
    result is that of the batch rule in a session whose time zone is UTC; later
    ones are ignored.  A run is reported once, when the watermark has passed the
    end of the period behind it.  Signals without a person or time do not count.
    State per person is bounded by the periods within the delay: it does not
    grow with the history.  ``groups`` does not change the result, only how many
    persons share a key (``groups_for``); it stays the same as long as the checkpoint does.
    """
    days, limit_cents, monday = DAYS[period], round(limit * 100), 0 if period == "day" else MONDAY

    def end_seconds(number: int) -> int:
        return ((number + 1) * days - monday) * DAY_SECONDS

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        people, found = PersonState.of_group(state.get[0] if state.exists else "{}"), []
        for batch in batches:
            for who, number, cents, micros, survey_id, score in zip(
                    *(batch[c].tolist() for c in ("person", "period", "cents", "micros", "survey_id", "score"))):
                person = people.get(who) or people.setdefault(who, PersonState())
                survey = None if pd.isna(survey_id) else [int(micros), int(survey_id), None if pd.isna(score) else int(score)]
                person.add(int(number), 0 if pd.isna(cents) else int(cents), survey)
        watermark = state.getCurrentWatermarkMs() // 1000
        if watermark > 0:
            reached = (watermark // DAY_SECONDS + monday) // days - 1  # the last period whose end the watermark has passed
            for who, person in people.items():
                for first, last, survey in person.close(reached, limit_cents):
                    if last - first + 1 >= least and survey and survey[2] is not None and survey[2] < low:
                        end = _moment(end_seconds(last))
                        found.append((who, first, last, last - first + 1, end, survey[1], _moment(0) + timedelta(microseconds=survey[0]),
                                      survey[2], end + timedelta(days=due_days)))
        state.update((PersonState.group_text(people),))
        waiting = min((p for p in (person.next_period() for person in people.values()) if p is not None), default=None)
        if waiting is not None:
            state.setTimeoutTimestamp(max(end_seconds(waiting), watermark + 1) * 1000)
        if found:
            yield pd.DataFrame(found, columns=["person", "first", "last", "n", "run_end", "survey_id", "surveyed", "score", "due"])

    number = F.floor((F.floor(F.unix_micros("ts") / (DAY_SECONDS * 1_000_000)) + monday) / days)
    prepared = signals.where(F.col("person").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("person"), F.lit(groups)).alias("group"), "person", "ts", number.alias("period"),
        (F.col("hours").cast("decimal(18,2)") * 100).cast("long").alias("cents"), F.unix_micros("ts").alias("micros"), "survey_id", "score")
    return prepared.groupBy("group").applyInPandasWithState(
        step, FOLLOW_UP_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def start_follow_ups(follow_ups: DataFrame, target: str, name: str = "follow_ups", checkpoint: str | None = None,
                     **trigger) -> StreamingQuery:
    """Append follow-ups to a Parquet folder, each once; a restart goes on where the checkpoint ends."""
    checkpoint = checkpoint or f"{shared_dir(follow_ups.sparkSession)}/streams/{name}"
    return (follow_ups.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start())
