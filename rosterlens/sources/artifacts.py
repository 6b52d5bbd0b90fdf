"""Saved model artifacts: feature pipeline, forest, feature order, defaults, in versions that are written once.

A model folder holds ``versions/<name>``, each complete or not there for any
reader, and ``current/<number>-<name>``, empty files of which the last names
the version to read.  Creating that file is the one step that publishes a
version, so nobody meets a half-written model, a crash on the way changes
nothing, and a version that is being read stays as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from rosterlens.sources.tables import path_exists


@dataclass(frozen=True)
class RiskModel:
    """A trained model and the folder of its version."""

    path: str
    encoder: PipelineModel
    forest: RandomForestClassificationModel
    features: tuple[str, ...]
    defaults: DataFrame

    @property
    def forest_path(self) -> str:
        return f"{self.path}/forest"


def save_artifacts(path: str, encoder: PipelineModel, forest: RandomForestClassificationModel,
                   features: tuple[str, ...], defaults: DataFrame) -> RiskModel:
    """Write the four artifacts into one folder; the defaults come last and mark completion."""
    spark = defaults.sparkSession
    encoder.write().overwrite().save(f"{path}/encoder")
    forest.write().overwrite().save(f"{path}/forest")
    order = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    order.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    defaults.coalesce(1).write.mode("overwrite").parquet(f"{path}/defaults")  # one row per feature
    return RiskModel(path, encoder, forest, tuple(features), spark.read.parquet(f"{path}/defaults"))


# --- versions ---------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where the folder is missing."""
    files, target = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def _pointers(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/current") if n[:1].isdigit()]


def new_version(path: str) -> str:
    """A folder for the next version of a model, that nobody else writes to; it holds nothing yet."""
    return f"{path}/versions/{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"


def _is_version(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/defaults/_SUCCESS")


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a complete version the one that readers of ``path`` get; also used to go back to an older one.

    Writers at the same time may take the same number; the names then decide,
    alike for every reader, and no version is lost.
    """
    if not _is_version(spark, version):
        raise ValueError(f"not a complete model: {version}")
    taken = _pointers(spark, path)
    number = int(taken[-1].split("-", 1)[0]) + 1 if taken else 0
    files, target = _files(spark, f"{path}/current/{number:010d}-{version.rstrip('/').rsplit('/', 1)[1]}")
    files.create(target, False).close()


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version; ``path`` itself when it is a version; None without one."""
    if _is_version(spark, path):
        return path
    pointers = _pointers(spark, path)
    folder = f"{path}/versions/{pointers[-1].split('-', 1)[1]}" if pointers else None
    return folder if folder and _is_version(spark, folder) else None


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, complete, current): every version of a model folder, also those that were never finished."""
    now = current_version(spark, path)
    rows = [(n, _is_version(spark, f"{path}/versions/{n}"), now == f"{path}/versions/{n}") for n in _names(spark, f"{path}/versions")]
    return spark.createDataFrame(rows, "version string, complete boolean, current boolean")


def remove_versions(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all but the ``keep`` last published versions and return the names that went.

    For a caller who knows that nobody reads or writes the others.  The
    published version always stays; unfinished ones go.
    """
    published = list(dict.fromkeys(n.split("-", 1)[1] for n in reversed(_pointers(spark, path))))
    kept = set(published[:max(keep, 1)])
    gone = [n for n in _names(spark, f"{path}/versions") if n not in kept]
    for pointer in _pointers(spark, path):  # a pointer goes before what it names
        if pointer.split("-", 1)[1] in gone:
            files, target = _files(spark, f"{path}/current/{pointer}")
            files.delete(target, False)
    for name in gone:
        files, target = _files(spark, f"{path}/versions/{name}")
        files.delete(target, True)
    return gone


# --- reading ----------------------------------------------------------------------------

def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a model can be loaded from the folder."""
    return current_version(spark, path) is not None


def discard_artifacts(spark: SparkSession, path: str) -> None:
    """Remove the mark of completion of a version: what stands in the folder is no longer a model."""
    files, target = _files(spark, f"{path}/defaults")
    files.delete(target, True)


def load_artifacts(spark: SparkSession, path: str, version: str | None = None) -> RiskModel:
    """The published model of a folder, or the version of that name."""
    folder = f"{path}/versions/{version}" if version else current_version(spark, path)
    if folder is None or not _is_version(spark, folder):
        raise FileNotFoundError(f"no model in {folder or path}")
    order = spark.read.parquet(f"{folder}/features").orderBy("position").collect()  # one row per feature
    return RiskModel(
        path=folder,
        encoder=PipelineModel.load(f"{folder}/encoder"),
        forest=RandomForestClassificationModel.load(f"{folder}/forest"),
        features=tuple(row["feature"] for row in order),
        defaults=spark.read.parquet(f"{folder}/defaults"))


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[str], RiskModel]) -> RiskModel:
    """The saved model, or ``fit(path)`` when there is none."""
    return load_artifacts(spark, path) if is_complete(spark, path) else fit(path)
