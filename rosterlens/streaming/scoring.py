"""Continuous scoring of profiles that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rosterlens.operators.scoring import profile_schema, score_profiles
from rosterlens.sources.artifacts import RiskModel
from rosterlens.sources.tables import shared_dir


def write_profiles(profiles: DataFrame, folder: str, fewest: int = 4, file_rows: int = 100_000) -> int:
    """Append a batch of profiles to a folder that a stream reads, and return the number of files.

    Files hold about ``file_rows`` rows each, so that neither the one who writes
    nor the one who reads has more in a task; they are compressed.
    """
    files = max(fewest, -(-profiles.count() // file_rows))
    profiles.repartition(files).write.mode("append").option("compression", "gzip").json(folder)
    return files


def profile_stream(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Profiles from new files in a folder; the schema is declared, never inferred."""
    return (spark.readStream.format(fmt).schema(profile_schema())
            .option("maxFilesPerTrigger", files_per_trigger).load(folder))


def start_scoring(model: RiskModel, profiles: DataFrame, target: str, name: str = "profile_scores",
                  checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Append scored profiles to a Parquet folder, each exactly once.

    Scoring keeps no state: the plan is the batch plan, so there is nothing to
    expire and no watermark to choose.
    """
    checkpoint = checkpoint or f"{shared_dir(profiles.sparkSession)}/streams/{name}"
    return (score_profiles(model, profiles).drop("features").writeStream.format("parquet").outputMode("append")
            .option("path", target).option("checkpointLocation", checkpoint).queryName(name)
            .trigger(**(trigger or {"availableNow": True})).start())
