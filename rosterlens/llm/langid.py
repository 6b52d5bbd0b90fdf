"""Language identification: nearest of several centroids per language, with rejection by distance.

A text becomes a vector of hashed letter n-grams, weighted by TF-IDF and
brought to length one.  Each language is described by a few centroids of a
spherical k-means, so dialects or registers need not share one mean.  The
prediction is the language of the centroid with the largest cosine.  A text is
rejected as too far from all when that cosine is below ``SLACK`` times what all
but a hundredth of the language's own sample rows of about its length reach:
longer texts come nearer to their centroid, and other languages do not.  Below
the lengths that the sample covers the limit is ``MIN_COSINE``.

The fit reads a bounded sample: at most ``SAMPLE_ROWS`` labelled rows per
language, chosen by the hash of the id.  Grouped by language, those are at
most ``SAMPLE_ROWS`` rows in a task.  The driver holds the centroids, whose
size is languages x ``CENTROIDS`` x ``DIMENSIONS`` floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 13
DIMENSIONS = 1 << BITS
CENTROIDS, ROUNDS = 4, 12
SAMPLE_ROWS = 400
SAMPLE_TASKS = 16
MIN_COSINE, SLACK, LOW_SHARE = 0.1, 0.5, 0.01
CLASSES, CLASS_ROWS = 32, 20  # lengths by the power of two of their n-grams; sample rows that a limit rests on
BATCH = 64
UNKNOWN = "und"
# Odd multipliers for the places of an n-gram, by n.
_MULTIPLIERS = {1: (0x9E3779B1,), 2: (0x85EBCA6B, 0xC2B2AE35), 3: (0x27D4EB2F, 0x165667B1, 0xD3A2646D)}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter 1- to 3-grams with word edges over the whole text; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 0).astype(np.uint32)
    edge = np.zeros(1, np.uint32)
    codes = np.concatenate([edge, codes, edge])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one edge between words
    counts = np.zeros(DIMENSIONS, np.int32)
    for n, multipliers in _MULTIPLIERS.items():
        if len(codes) < n:
            continue
        hashed = np.zeros(len(codes) - n + 1, np.uint32)
        for i, multiplier in enumerate(multipliers):
            hashed = hashed + codes[i:len(codes) - n + 1 + i] * np.uint32(multiplier)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(hashed >> np.uint32(32 - BITS), minlength=DIMENSIONS).astype(np.int32)
    return counts


def sized_vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a letter, their TF-IDF vectors of length one, their length classes), made one text at a time."""
    places, rows, classes = [], [], []
    for place, counts in enumerate(map(ngram_counts, texts)):
        if counts is not None:
            weighted = np.log1p(counts, dtype=np.float32) * idf
            rows.append(weighted / np.linalg.norm(weighted))
            places.append(place)
            classes.append(min(CLASSES, int(counts.sum()).bit_length()) - 1)
    return np.array(places, int), np.stack(rows) if rows else np.zeros((0, DIMENSIONS), np.float32), np.array(classes, int)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a letter, their vectors)."""
    return sized_vectors(texts, idf)[:2]


def length_limits(cosines: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Smallest cosine that is not rejected, per length class, from a language's own sample rows.

    A class rests on its own rows and those of both neighbours.  Classes with
    too few rows take the smaller limit of the nearest ones on both sides;
    below the first the limit is ``MIN_COSINE``, beyond the last that one's.
    """
    known = {}
    for c in range(CLASSES):
        near = cosines[np.abs(classes - c) <= 1]
        if len(near) >= CLASS_ROWS:
            known[c] = max(MIN_COSINE, SLACK * float(np.quantile(near, LOW_SHARE)))
    limits = np.full(CLASSES, MIN_COSINE)
    for c in range(CLASSES):
        below, above = [k for k in known if k <= c], [k for k in known if k >= c]
        if below:
            limits[c] = min(known[below[-1]], known[above[0]] if above else np.inf)
    return limits


def spherical_means(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``k`` centroids of length one; starts from the rows farthest from those chosen before."""
    seeds = [int(np.argmax(rows @ rows.mean(axis=0)))]
    nearest = rows @ rows[seeds[0]]
    while len(seeds) < min(k, len(rows)) and nearest.min() < 1 - 1e-6:
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[seeds[-1]])
    centres = rows[seeds]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres.astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid, in code-point order
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray | None = None  # per centroid and length class; None where only ``MIN_COSINE`` counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and largest cosine (0 to 1) of each text; 'und' and 0 without a letter or without a model."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The same, and whether the text is too far from every centroid for its length."""
        names, scores, far = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if self.languages:
            for start in range(0, len(texts), BATCH):
                at, rows, classes = sized_vectors(texts[start:start + BATCH], self.idf)
                cosines = rows @ self.centroids.T
                for i, best, cosine, length in zip(at, cosines.argmax(axis=1), cosines.max(axis=1, initial=-1.0), classes):
                    names[start + i] = self.languages[best]
                    scores[start + i] = float(min(max(cosine, 0.0), 1.0))
                    far[start + i] = bool(cosine < (MIN_COSINE if self.limits is None else self.limits[best, length]))
        return names, scores, far


def bounded_sample(docs: DataFrame, id_column: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, text, order): at most ``rows`` labelled rows per label, those with the smallest hashes of the id.

    A hash threshold per label from its count leaves about three times as many
    for the ranking, so no task ranks a large group.
    """
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}") & F.col(id_column).isNotNull()).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(id_column).alias("order"))
    share = F.least(F.lit(1.0), 3.0 * rows / F.col("n"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", (share * 2**31).cast("long").alias("limit"))
    near = labelled.join(F.broadcast(counts), "label").where(F.pmod("order", F.lit(2**31)) <= F.col("limit"))
    ranked = Window.partitionBy("label").orderBy(F.pmod("order", F.lit(2**31)), "order", "text")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= rows).select("label", "text", "order")


def fit_languages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang",
                  rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Centroids and inverse document frequencies from a bounded sample of the given rows."""
    sample = bounded_sample(docs, id_column, text, label, rows).repartition(SAMPLE_TASKS, "order").persist()

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for counts in map(ngram_counts, batch["text"]):
                if counts is not None:
                    seen, total = seen + (counts > 0), total + 1
        yield pd.DataFrame({"n": [total], "seen": [seen]})

    try:
        parts = sample.select("text").mapInPandas(frequencies, T.StructType([
            T.StructField("n", T.LongType()), T.StructField("seen", T.ArrayType(T.LongType()))])).collect()  # SAMPLE_TASKS rows
        total = sum(p["n"] for p in parts)
        seen = sum((np.array(p["seen"]) for p in parts), np.zeros(DIMENSIONS, np.int64))
        idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

        def centroids(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["order", "text"])
            _, made, classes = sized_vectors(group["text"].tolist(), idf)
            means = spherical_means(made)
            limits = length_limits((made @ means.T).max(axis=1), classes)
            return pd.DataFrame({"label": group["label"].iloc[0], "centre": [list(map(float, m)) for m in means],
                                 "limits": [limits.tolist()] * len(means)})

        found = sample.groupBy("label").applyInPandas(centroids, T.StructType([
            T.StructField("label", T.StringType()), T.StructField("centre", T.ArrayType(T.FloatType())),
            T.StructField("limits", T.ArrayType(T.DoubleType()))])).collect()
    finally:
        sample.unpersist()
    found = sorted(found, key=lambda r: (r["label"], r["centre"]))
    centres = np.array([r["centre"] for r in found], np.float32).reshape(len(found), DIMENSIONS)
    limits = np.array([r["limits"] for r in found]).reshape(len(found), CLASSES)
    return LanguageModel(tuple(r["label"] for r in found), centres, idf, limits)


def held_out(id_column: str = "doc_id") -> Column:
    """True for the quarter of ids whose CRC-32 leaves remainder 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", min_cosine: float = 0.0) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    Null, empty and letterless texts are 'und' with score 0 and rejected; so is
    everything if no language was learned.  Equal texts get equal results.
    Ties go to the language first in code-point order.  Only the text counts.
    ``min_cosine`` rejects whatever is below it, beside the limits of the model.
    """
    result = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("far", T.BooleanType())])

    @F.pandas_udf(result)
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores, far = model.judge(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores, "far": far})

    found = docs.withColumn("_found", predict(F.col(text)))
    return found.withColumns({
        "lang_pred": F.col("_found.lang"), "score": F.col("_found.score"),
        "rejected": F.col("_found.far") | (F.col("_found.score") < min_cosine)}).drop("_found")
