"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  For each pivot an
inverted file holds the vectors that have it among their nearest, with its
place in their order.  A query walks the files of its own nearest pivots and
collects, for every shared pivot, what the footrule distance of the two orders
falls by; the vectors of smallest footrule distance are reranked by the exact
cosine.

The index is cut into segments of about ``SEGMENT_ROWS`` vectors with pivots
and inverted files of their own, the queries into blocks of about
``QUERY_ROWS``.  Each pair of a segment and a block is one group of bounded
size; only the best few of a group leave it.  Equal vectors are one row of the
index with their smallest ids, so copies in any number cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import stored

PIVOTS, NEAREST = 256, 96  # pivots of a segment; length of a vector's list
CANDIDATES = 2048  # most vectors of a segment that are reranked
SHARE, FEWEST = 0.15, 24  # and the share of the segment, but this many at least; measured recall at 5 is 0.98 or more
SEGMENT_ROWS, QUERY_ROWS = 16_384, 2_048
K = 5


def nearest_lists(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the ``length`` pivots with the largest cosine, nearest first, per row."""
    cosines = unit @ pivots.T
    length = min(length, len(pivots))
    chosen = np.argpartition(-cosines, length - 1, axis=1)[:, :length]
    return np.take_along_axis(chosen, np.argsort(-np.take_along_axis(cosines, chosen, 1), axis=1, kind="stable"), 1)


class Segment:
    """Inverted files over the rows of one segment."""

    def __init__(self, vectors: np.ndarray, pivots: int = PIVOTS, nearest: int = NEAREST):
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        # Rows come in hash order, so evenly spaced rows are a random sample of fixed size.
        self.pivots = unit[np.unique(np.linspace(0, len(unit) - 1, min(pivots, len(unit))).astype(int))]
        lists = nearest_lists(unit, self.pivots, nearest)
        self.length = lists.shape[1]
        order = np.argsort(lists.reshape(-1), kind="stable")
        self.rows, self.places = (order // self.length).astype(np.int32), (order % self.length).astype(np.int32)
        self.bounds = np.searchsorted(lists.reshape(-1)[order], np.arange(len(self.pivots) + 1))

    def search(self, query: np.ndarray, candidates: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the reranked candidates.

        Two lists with a pivot at places a and b are nearer by 2 * (length -
        max(a, b)) in footrule distance than two lists without it in common.
        """
        norm = float(np.sqrt((query * query).sum()))
        shared = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(nearest_lists((query / norm)[None], self.pivots, self.length)[0]):
            span = slice(self.bounds[pivot], self.bounds[pivot + 1])
            shared[self.rows[span]] += self.length - np.maximum(self.places[span], place)
        candidates = min(candidates, max(FEWEST, math.ceil(SHARE * len(self.vectors))))
        found = np.argsort(-shared, kind="stable")[:candidates]
        return found, (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a finite vector other than zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


def nearest_neighbours(vectors: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
                       segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS, candidates: int = CANDIDATES,
                       pivots: int = PIVOTS, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query.

    ``is_query`` is a condition on ``vec_id``.  The score is the exact cosine
    in double precision; equal scores go by smaller id.  Rows with a null id or
    a null, empty, zero or non-finite vector take no part.  Only vectors of the
    query's own length are candidates.  Rows repeated in full count once; an id
    with several vectors counts with each.  A query without candidates has no
    row.  Other columns do not take part.
    """
    valid = usable(vectors, id_column, vector)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ids = valid.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = stored(ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("hash", F.xxhash64("embedding")).withColumn("class", F.monotonically_increasing_id()), "vectors")
    queries = stored(valid.where(is_query).distinct().join(classes.select("embedding", "class"), "embedding").select("vec_id", "class"), "queries")
    asked = queries.select("class").distinct().join(classes, "class").select("class", "embedding", "hash")
    segments = max(1, -(-classes.count() // segment_rows))
    blocks = max(1, -(-queries.count() // query_rows))

    place = lambda n: F.pmod(F.col("hash"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = classes.select("class", "embedding", "ids", "hash", F.size("embedding").alias("dim"), place(segments).alias("segment"),
                             every(blocks).alias("block"))
    spread = asked.select("class", F.col("embedding").alias("query"), F.size("embedding").alias("dim"), every(segments).alias("segment"), place(blocks).alias("block"))
    result = T.StructType([T.StructField("class", T.LongType()), T.StructField("score", T.DoubleType()),
                           T.StructField("ids", T.ArrayType(T.LongType()))])

    def search(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(questions):
            rows = rows.sort_values(["hash", "class"])
            index = Segment(np.stack(rows["embedding"].to_numpy()).astype(np.float64), pivots, nearest)
            ids, firsts = rows["ids"].to_numpy(), np.array([x[0] for x in rows["ids"]])
            for name, query in zip(questions["class"], questions["query"]):
                at, scores = index.search(np.asarray(query, np.float64), candidates)
                best = np.lexsort((firsts[at], -scores))[:k + 1]
                found += [(name, float(scores[i]), ids[at[i]]) for i in best]
        return pd.DataFrame(found, columns=["class", "score", "ids"])

    grouped = indexed.groupBy("dim", "segment", "block").cogroup(spread.groupBy("dim", "segment", "block"))
    near = grouped.applyInPandas(search, result)
    # Per query class the k + 1 best classes hold the k best ids besides the query's own.
    best = Window.partitionBy("class").orderBy(F.desc("score"), F.col("ids")[0])
    top = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = queries.join(top, "class").select(F.col("vec_id").alias("query_id"), "score", F.explode("ids").alias("vec_id")).where(
        "query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
