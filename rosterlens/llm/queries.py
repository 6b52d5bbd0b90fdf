"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import (ann, bpe, chat, html, langid, mixing, neardup, negatives, packing, quality, secrets, shallot,
                            sharding)
from rosterlens.llm.shared import doc_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secrets.scan_secrets(doc_table(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("spans")
    counts = [secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.base_of(spans).cast("binary"), 256).alias("base_sha256"), "spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts of every document, and whether the rules keep it."""
    return quality.apply_rules(doc_table(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = doc_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = doc_table(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(doc_table(spark, sf_dir).select("doc_id", "text"))


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.extendible_shards(doc_table(spark, sf_dir).select("doc_id", "text"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every row whose id is divisible by 50."""
    return ann.nearest_neighbours(doc_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that holds control strings."""
    turns = doc_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    hostile = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest_parts(chat.format_turns(turns.unionByName(hostile)))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sources(doc_table(spark, sf_dir).select("doc_id", "text", "source"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.pack_documents(doc_table(spark, sf_dir).select("doc_id", "text"))


def op11_shallot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds, with distances and inertia in integers."""
    return shallot.clustering_report(*shallot.cluster_vectors(doc_table(spark, sf_dir, "embeddings")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    coded = bpe.encode_and_decode(doc_table(spark, sf_dir).select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every row whose id is divisible by 100."""
    return negatives.hard_negatives(doc_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=negatives.shifted_labels())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_quality_rules, op3_html_extraction, op4_language_id, op5_minhash_dedup, op6_extendible_sharding,
        op7_permutation_index, op8_chat_format, op9_source_mixing, op10_best_fit_packing, op11_shallot_clustering, op12_byte_bpe,
        op13_hard_negatives)
}
