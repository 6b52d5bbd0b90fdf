"""Hard-negative mining by exact integer scores, computed from subset-sum tables.

Components become integers.  Of every eight dimensions one bit of each is a
byte; a candidate is stored as these bytes, one per bit plane and group.  For an
anchor the sums of all subsets of eight components are tabulated once per group.
A byte then looks up the inner product of the anchor's eight components with one
bit of the candidate's; the planes are shifted and added, the highest with a
negative sign, which gives the whole inner product in integers.

Candidates are packed once into segments of about ``SEGMENT_ROWS`` rows, anchors
into blocks of about ``BLOCK_ROWS``; every pair of both is one group of bounded
size, of which only the best few per anchor leave.  One sweep finds the
positives, a second one the negatives in each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score between which a negative's score lies
SEGMENT_ROWS, BLOCK_ROWS, AT_ONCE = 8192, 512, 32
MOST_BITS = 31  # components are integers of at most this many bits
LABELS = 10


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of two's-complement integers; bit i of a byte is dimension i of its group."""
    rows, dim = values.shape
    groups = -(-dim // 8)
    padded = np.zeros((rows, groups * 8), np.int64)
    padded[:, :dim] = values
    size = max(int(values.max(initial=0)), int(-values.min(initial=0) - 1))
    planes = size.bit_length() + 1  # the last one is the sign
    bits = (padded[None] >> np.arange(planes)[:, None, None]) & 1
    packed = np.packbits(bits.astype(np.uint8).reshape(planes, rows, groups, 8), axis=3, bitorder="little")[..., 0]
    return np.ascontiguousarray(packed.transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, rows, 256) sums of every subset of each eight components."""
    rows, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((rows, groups * 8), np.int64)
    padded[:, :dim] = anchors
    eights = padded.reshape(rows, groups, 8).transpose(1, 0, 2)
    sums = np.zeros((groups, rows, 256), np.int64)
    for bit in range(8):  # subsets with this as their highest element: those without it, plus the element
        sums[:, :, 1 << bit:2 << bit] = sums[:, :, :1 << bit] + eights[:, :, bit, None]
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) inner products by looking up, shifting and adding."""
    total = None
    for number in range(len(planes) - 1, -1, -1):
        plane = sum(np.take(tables[group], planes[number, group], axis=1) for group in range(len(tables)))
        total = -plane if total is None else (total << 1) + plane
    return total


def top(values: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions in ``among`` of the k largest values, ties by position."""
    here = values[among]
    if len(here) > k:
        least = np.partition(here, len(here) - k)[len(here) - k]
        among, here = among[here >= least], here[here >= least]
    return among[np.argsort(-here, kind="stable")[:k]]


def labelled_integers(vectors: DataFrame, id_column: str, vector: str, label: str, relabel: Column | None = None,
                      scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): rows that take part, each once, with components floor(scale * x)."""
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("x"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    return kept.select("vec_id", (F.col("label") if relabel is None else relabel).alias("label"),
                       F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q")).distinct()


def _dealt(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """Rows dealt evenly by a hash into numbered parts of about ``size`` rows per vector length, and the number of parts."""
    count = rows.count()
    parts = max(1, -(-count // size))
    return rows.withColumns({"dim": F.size("q"), name: F.pmod(F.xxhash64("vec_id", "q"), F.lit(parts)).cast("int")}), parts


def _packed_segments(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """One stored row per segment: ids, labels and bit planes of its rows in the order of their ids."""
    dealt, parts = _dealt(rows, "segment", size)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        values = np.stack(group["q"].to_numpy()).astype(np.int64).reshape(len(group), -1)
        if max(values.max(initial=0), -1 - values.min(initial=0)) >> MOST_BITS:
            raise ValueError(f"a component is beyond {MOST_BITS} bits")
        planes = bit_planes(values)
        return pd.DataFrame({"dim": [key[0]], "segment": [key[1]], "planes": [len(planes)],
                             "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             "labels": [group["label"].to_numpy(np.int64).tobytes()], "bits": [planes.tobytes()]})

    made = dealt.groupBy("dim", "segment").applyInPandas(pack, "dim int, segment int, planes int, ids binary, labels binary, bits binary")
    return stored(made, "segments"), parts


def _sweep(segments: DataFrame, n_segments: int, asked: DataFrame, n_blocks: int, extra: list[str],
           choose: Callable[[np.ndarray, np.ndarray, np.ndarray, dict, int], list[tuple]], result: str) -> DataFrame:
    """Rows that ``choose`` takes from the scores of every anchor against every segment, block by block.

    A segment is a single row that is sent to each block's group, an anchor is
    sent to each segment's, so no group holds more than one of both.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = segments.withColumn("block", every(n_blocks)).groupBy("dim", "segment", "block")
    right = asked.withColumn("segment", every(n_segments)).groupBy("dim", "segment", "block")
    names = [field.name for field in T.StructType.fromDDL(result)]

    def search(key: tuple, held: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(held) and len(anchors):
            row = held.iloc[0]
            ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
            planes = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], -1, len(ids))
            for at in range(0, len(anchors), AT_ONCE):
                part = anchors.iloc[at:at + AT_ONCE]
                tables = subset_sums(np.stack(part["q"].to_numpy()).astype(np.int64).reshape(len(part), -1))
                products = scores(tables, planes) if len(tables) else np.zeros((len(part), len(ids)), np.int64)
                columns = {c: part[c].to_numpy() for c in ["vec_id", "label", *extra]}
                for n in range(len(part)):
                    found += choose(products[n], ids, labels, columns, n)
        return pd.DataFrame(found, columns=names)

    return left.cogroup(right).applyInPandas(search, result)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                   relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``, ``relabel`` an expression of
    ``vec_id`` and ``label`` that replaces the label.  A row's score is the inner
    product with the anchor of the integers floor(scale * x); higher comes
    first, equal ones go by smaller id, then by label and vector.  An anchor's
    positives are its first ``positives`` rows of the same label; for each, the
    first ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` per cent of the positive's are returned.

    Rows with a null id, label or vector, or a null or non-finite component take
    no part.  Rows repeated in full count once, an id with several vectors or
    labels with each; rows of the anchor's own id are never its partners.
    Vectors are compared with those of their own length.  A pair without a
    negative has no row; an empty table gives an empty result.  Components
    beyond 31 bits are an error.  Other columns do not take part.
    """
    rows = stored(labelled_integers(vectors, id_column, vector, label, relabel, scale), "integers")
    segments, n_segments = _packed_segments(rows, segment_rows)
    dealt, n_blocks = _dealt(rows.where(is_anchor), "block", block_rows)
    anchors = stored(dealt.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def same(products, ids, labels, columns, n):
        among = np.flatnonzero((labels == columns["label"][n]) & (ids != columns["vec_id"][n]))
        return [(int(columns["anchor"][n]), int(ids[i]), int(products[i])) for i in top(products, among, positives)]

    # Equal rows of one segment are told apart by nothing that is returned, so any of them may stand for the others.
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = _sweep(segments, n_segments, anchors, n_blocks, ["anchor"], same, "anchor long, positive_id long, positive_score long")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = stored(best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found")),
                   "positives")
    asked = anchors.join(pairs, "anchor").withColumns({
        "places": F.col("found.place"), "limits": F.col("found.positive_score")}).drop("found")

    def other(products, ids, labels, columns, n):
        found, differs = [], (labels != columns["label"][n]) & (ids != columns["vec_id"][n])
        for place, limit in zip(columns["places"][n], columns["limits"][n]):
            limit = int(limit)
            if limit >= 0:  # the window of a negative score is empty
                # Whole numbers s with low * limit <= 100 * s <= high * limit.
                among = np.flatnonzero(differs & (products >= -(-low * limit // 100)) & (products <= high * limit // 100))
                found += [(int(columns["anchor"][n]), int(place), int(ids[i]), int(products[i])) for i in top(products, among, negatives)]
        return found

    far = _sweep(segments, n_segments, asked, n_blocks, ["anchor", "places", "limits"], other,
                 "anchor long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = pairs.select("anchor", F.explode("found").alias("f")).select("anchor", "f.*")
    return ranked.join(named, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(count: int = LABELS, every: int = 7) -> Column:
    """The next label for rows whose id is divisible by ``every``."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % count).otherwise(F.col("label"))
