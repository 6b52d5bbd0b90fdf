"""Profiles that arrive more than once, or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlens.operators.scoring import PROFILE_ID, profile_schema

ARRIVED = "arrived"


def timed_profile_stream(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Profiles with the time they were sent, from new files in a folder."""
    return (spark.readStream.format(fmt).schema(f"{profile_schema()}, {ARRIVED} TIMESTAMP")
            .option("maxFilesPerTrigger", files_per_trigger).load(folder))


def first_arrivals(profiles: DataFrame, delay: str = "7 days", id_column: str = PROFILE_ID, arrived: str = ARRIVED) -> DataFrame:
    """Each profile once, as it arrived first; a repeat within ``delay`` of it is left out, also after a restart.

    The state holds an id until the watermark has passed its time by the delay,
    so it is bounded by the ids of that span.  Profiles later than the watermark
    and profiles without a time are left out; null ids count as one id.
    """
    return profiles.where(f"{arrived} IS NOT NULL").withWatermark(arrived, delay).dropDuplicatesWithinWatermark([id_column])
