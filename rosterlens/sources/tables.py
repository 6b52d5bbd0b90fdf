"""Readers, sinks and catalog helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rosterlens.functions.fixed_values import HR_SCHEMA_DDL

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json"}


def _format_of(path: str) -> str:
    return next((fmt for suffix, fmt in _FORMATS.items() if path.rstrip("/").endswith(suffix)), "parquet")


def hr_schema() -> T.StructType:
    """Declared schema of the employee file; avoids an inference pass."""
    return T.StructType.fromDDL(HR_SCHEMA_DDL)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a file or folder; the format comes from the suffix unless given.

    CSV files have a header and may start with a byte-order mark.  Without a
    schema CSV types are inferred, which costs one extra pass over the file.
    """
    fmt = fmt or _format_of(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8")
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the file system the path belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_first_available(spark: SparkSession, paths: Iterable[str],
                         schema: T.StructType | str | None = None) -> DataFrame:
    """First path that exists; the error names every place that was tried."""
    tried = list(paths)
    for path in tried:
        if path_exists(spark, path):
            return read_table(spark, path, schema)
    raise FileNotFoundError(f"no input found, tried: {', '.join(tried)}")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make the frame visible to SQL under ``name`` and return it."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Lazy SQL; frames passed by name are substituted for ``{name}`` in the text."""
    return spark.sql(text, **tables)


def create_or_replace(df: DataFrame, target: str, *, table: bool = False,
                      partition_by: Iterable[str] = ()) -> DataFrame:
    """Materialise a frame as a Parquet folder or catalog table and read it back.

    The target must not be one of the frame's own inputs.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite").format("parquet").partitionBy(*partition_by)
    if table:
        writer.saveAsTable(target)
        return spark.table(target)
    writer.save(target)
    return spark.read.schema(df.schema).parquet(target)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the data behind a chart."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.format(fmt).save)(path)


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows; reads only as many partitions as it needs."""
    return df.limit(n)


@lru_cache(maxsize=None)
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="rosterlens-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints, intermediate tables and model artifacts.

    ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``,
    else an error.  Only where the master is ``local``, so that driver and
    executors are one process, does a session without either get a temporary
    folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", context.master):
        return _local_dir(context.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute the frame once and cut its lineage with a reliable checkpoint.

    For combined, small intermediate results that several later steps read.
    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when
    the frame is no longer referenced.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
