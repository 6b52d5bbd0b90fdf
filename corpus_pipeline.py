"""A corpus from raw documents to packed sequences, in five stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import langid, mixing, neardup, packing, secrets
from rosterlens.llm.shared import doc_table
from rosterlens.sources.tables import shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those too far from every centroid go, null and letterless texts too.

    Learns from the stage's own input.  Repeated rows stay; columns of any name and type pass through unread.
    """
    model = langid.fit_languages(docs.where(~langid.held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return langid.identify(rows, model).where("not rejected").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share four fifths of their five-word shingles or more.

    The smallest id stays, a null id comes last; documents without a word are no copies and all stay.  Columns of any name pass through.
    """
    return neardup.one_per_group(docs, percent=80, width=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret in its text replaced by its kind in brackets; null texts and other columns stay."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands once for each time it is taken.

    A null source is one of its own; documents without a word are never taken; ties go by id and text.  Columns of any name pass through.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences; null texts are their closing id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # no stage but the mixing can be written in SQL; tests compare each with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table in the shared folder."""
    docs, folder = doc_table(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
