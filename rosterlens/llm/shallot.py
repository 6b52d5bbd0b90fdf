"""Centroid clustering: Lloyd's rounds with Shallot search.

Every vector carries its nearest centroid, the second-nearest it last saw, an
upper bound of the distance to the first and a lower bound of the distance to
all others.  When the centroids have moved, the bounds move with them; a vector
whose upper bound stays below the lower one, or below half the distance from
its centroid to the next, keeps its centroid unread.  The others measure their
two remembered centroids, start from the closer one and walk its neighbours in
order of distance.  No centroid farther from the start than the distance to the
start plus the second-smallest distance so far can be among the two nearest, and
that ball shrinks while the walk goes on.  Bounds are floating-point numbers
rounded outwards; what survives them is compared in integers, so the result is
that of comparing all.

A round is one pass: it reads the vectors with their bounds and writes them with
new ones beside one row per task and cluster, by how much the sums of the
clusters change.  Those rows are added up by Spark; the driver holds k centroids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import removed
from rosterlens.sources.tables import shared_dir

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
ROWS = 2048  # vectors searched at once
OUT, IN = 1 + 1e-12, 1 - 1e-12  # outward rounding of upper and lower bounds


def safe_size(dim: int) -> int:
    """Components up to this keep squared distances within 62 bits."""
    return isqrt((1 << 62) // dim) // 2


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as exact integers: 64 bits, or Python integers where these do not suffice."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if scaled.size == 0 or np.abs(scaled).max() <= safe_size(vectors.shape[1]):
        return scaled.astype(np.int64)
    exact = np.empty(vectors.shape, object)
    exact[:] = [[int(x) * scale + int((x - int(x)) * scale // 1) for x in row] for row in vectors.tolist()]
    return exact


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots as floating-point numbers, of Python integers rounded down by less than one."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    roots = [isqrt(int(s)) for s in squares.reshape(-1)]
    return np.array([float(r) if r >> 1000 == 0 else np.inf for r in roots], np.float64).reshape(squares.shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


@dataclass
class Centroids:
    """Centroids of a round, their distances among each other, and how far each came since the last round."""

    points: np.ndarray
    order: np.ndarray  # per centroid all centroids by distance
    gaps: np.ndarray  # lower bounds of the distances among them
    half: np.ndarray  # lower bound of half the distance to the next centroid
    moved: np.ndarray  # upper bounds
    moved_others: np.ndarray  # per centroid the largest move of another

    @classmethod
    def of(cls, points: list[list[int]], before: list[list[int]] | None) -> Centroids:
        size = max((abs(x) for p in points for x in p), default=0)
        exact = np.array(points, np.int64 if size <= safe_size(len(points[0])) else object)
        far = _root(np.stack([_squared(exact, p) for p in exact]))
        gaps = far * IN
        alone = gaps + np.diag(np.full(len(points), np.inf))
        old = exact if before is None else np.array(before, exact.dtype)
        moved = _root(_squared(exact, old)) * OUT + (exact.dtype == object)
        others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(len(points))])
        return cls(exact, np.argsort(far, axis=1, kind="stable"), gaps, alone.min(axis=1) / 2, moved, others)

    def assign(self, vectors: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
               ) -> int:
        """Update (near, second, upper, lower) in place; the number of integer distances that took."""
        points = self.points
        if vectors.dtype == object:
            points = points.astype(object)
        elif points.dtype == object:
            vectors = vectors.astype(object)
        slack = float(points.dtype == object)  # integer roots are rounded down by less than one
        if len(points) == 1:
            near[:], second[:] = 0, 0
            return 0
        upper[:] = (upper + self.moved[near]) * OUT
        lower[:] = lower * IN - self.moved_others[near]
        bound = np.maximum(lower, self.half[near])
        open_ = np.flatnonzero(~(upper * OUT < bound))
        if not len(open_):
            return 0
        first = _squared(vectors[open_], points[near[open_]])
        upper[open_] = _root(first) * OUT + slack
        still = ~(upper[open_] * OUT < bound[open_])
        counted, rows, first = len(open_), open_[still], first[still]
        # Start from the closer one of the two remembered centroids; equal distances go by number.
        other = _squared(vectors[rows], points[second[rows]])
        counted += len(rows)
        swap = (other < first) | ((other == first) & (second[rows] < near[rows]))
        best, runner = np.where(swap, second[rows], near[rows]), np.where(swap, near[rows], second[rows])
        best_d, runner_d = np.where(swap, other, first), np.where(swap, first, other)
        start, also, reach = best.copy(), runner.copy(), _root(best_d) * OUT + slack
        active = np.arange(len(rows))
        for step in range(1, len(points)):
            candidate = self.order[start[active], step]
            ball = reach[active] + _root(runner_d[active]) * OUT + slack
            inside = ~(self.gaps[start[active], candidate] > ball * OUT)
            active, candidate = active[inside], candidate[inside]
            if not len(active):
                break
            new = candidate != also[active]
            at, candidate = active[new], candidate[new]
            distance = _squared(vectors[rows[at]], points[candidate])
            counted += len(at)
            nearer = (distance < best_d[at]) | ((distance == best_d[at]) & (candidate < best[at]))
            closer = ~nearer & (distance < runner_d[at])
            runner[at] = np.where(nearer, best[at], np.where(closer, candidate, runner[at]))
            runner_d[at] = np.where(nearer, best_d[at], np.where(closer, distance, runner_d[at]))
            best[at], best_d[at] = np.where(nearer, candidate, best[at]), np.where(nearer, distance, best_d[at])
        near[rows], second[rows] = best, runner
        upper[rows], lower[rows] = _root(best_d) * OUT + slack, _root(runner_d) * IN
        return counted


def kept_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, embedding) of rows with exactly ``dim`` components, none null or non-finite."""
    x = F.col("embedding")
    kind = vectors.schema[vector].dataType.elementType
    plain = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), plain.alias("embedding")).where(
        x.isNotNull() & (F.size(x) == dim) & finite)


def starting_points(kept: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The k vectors whose id hashes smallest, in order of the hash; equal hashes go by vector, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "embedding").limit(k).collect()
    return [[int(x) for x in quantised(np.array([r["embedding"]], np.float64), scale)[0]] for r in rows]


def _pass(state: DataFrame, centroids: Centroids, scale: int, dim: int, last: bool) -> DataFrame:
    """One assignment of every vector; beside them per task and cluster a row with ``n`` and the changes of the sums."""
    k = len(centroids.points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, np.zeros((k, dim), object)
        inertia, distances = [0] * k, 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n = batch.num_rows
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            exact = quantised(flat.reshape(n, dim), scale)
            near, second, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "second", "upper", "lower"))
            fresh, before = near < 0, near.copy()
            near[fresh] = 0
            distances += centroids.assign(exact, near, second, upper, lower)
            moved = np.flatnonzero(fresh | (near != before))
            for c in np.unique(np.concatenate([near[moved], before[moved]])) if len(moved) else ():
                came, went = moved[near[moved] == c], moved[(before[moved] == c) & ~fresh[moved]]
                counts[c] += len(came) - len(went)
                sums[c] += exact[came].sum(axis=0).astype(object) - exact[went].sum(axis=0).astype(object)
            squares = [None] * n
            if last:
                own = centroids.points[near] if exact.dtype != object else centroids.points.astype(object)[near]
                squares = [int(d) for d in _squared(exact, own)]
                for c, d in zip(near.tolist(), squares):
                    inertia[c] += d
            fits = [d if d is not None and d < 1 << 63 else None for d in squares]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(near), pa.array(second),
                 pa.array(upper), pa.array(lower), pa.array(fits, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.list_(pa.decimal128(38, 0))), pa.nulls(n, pa.decimal128(38, 0))], names)
        values = pa.array([[Decimal(int(x)) for x in row] for row in sums], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, vector_type), pa.array(range(k), pa.int32()), pa.nulls(k, pa.int32()),
             pa.nulls(k, pa.float64()), pa.array([float(distances)] + [0.0] * (k - 1)), pa.nulls(k, pa.int64()),
             pa.array(counts, pa.int64()), values, pa.array([Decimal(d) for d in inertia], pa.decimal128(38, 0))], names)

    element = state.schema["embedding"].dataType.elementType
    vector_type = pa.list_(pa.float32() if isinstance(element, T.FloatType) else pa.float64())
    exact_type = T.DecimalType(38, 0)
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(element)),
        T.StructField("near", T.IntegerType()), T.StructField("second", T.IntegerType()), T.StructField("upper", T.DoubleType()),
        T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("sums", T.ArrayType(exact_type)), T.StructField("squares", exact_type)])
    names = schema.names
    return state.select("vec_id", "embedding", "near", "second", "upper", "lower").mapInArrow(assign, schema)


def cluster_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
                    dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(members, centroids) after ``rounds`` rounds and one more assignment.

    members: vec_id, cluster, distance (squared, in integers).  centroids:
    cluster, n, inertia, centroid (array of decimal integers), read (integer
    distances computed in all passes, summed over clusters).

    Components become floor(scale * x).  Rows with a null vector, another number
    of components, or a null or non-finite one take no part; other columns
    neither.  Repeated rows count as often as they stand; a row with a null id is
    a member and a start only where ids are too few.  Fewer vectors than ``k`` make fewer clusters, an
    empty table an empty result.  Equal distances go to the smaller number; an
    empty cluster keeps its centroid.  A squared distance beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_column, vector, dim)
    points, before = starting_points(kept, k, seed, scale), None
    made = T.StructType.fromDDL("cluster int, n long, inertia decimal(38,0), centroid array<decimal(38,0)>, read long")
    if not points:
        nothing = kept.where(F.lit(False))
        return nothing.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), spark.createDataFrame([], made)
    k = len(points)
    state = kept.withColumns({"near": F.lit(-1), "second": F.lit(min(1, k - 1)), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    counts, sums, inertia, read, old = [0] * k, [[0] * dim for _ in points], {}, 0, None
    for turn in range(rounds + 1):
        folder = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
        passed = _pass(state, Centroids.of(points, before), scale, dim, turn == rounds)
        passed.write.parquet(folder)
        table = spark.read.schema(passed.schema).parquet(folder)
        if old:
            removed(spark, old)
        old, state = folder, table.where("n IS NULL")
        changes = table.where("n IS NOT NULL").select("near", "n", "lower", "squares", F.posexplode("sums")).groupBy("near", "pos").agg(
            F.sum("n").alias("n"), F.sum("lower").alias("read"), F.sum("squares").alias("squares"), F.sum("col").alias("change")).collect()
        for row in changes:
            sums[row["near"]][row["pos"]] += int(row["change"])
            if row["pos"] == 0:
                counts[row["near"]] += row["n"]
                inertia[row["near"]] = row["squares"]
                read += int(row["read"])
        if turn < rounds:
            before, points = points, [[s // n for s in row] if n else p for row, n, p in zip(sums, counts, points)]
    rows = [(c, counts[c], inertia[c], [Decimal(x) for x in p], read if c == 0 else 0) for c, p in enumerate(points)]
    return state.select("vec_id", F.col("near").alias("cluster"), "distance"), spark.createDataFrame(rows, made)


def clustering_report(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every member with its cluster's and the whole inertia and the digest of its centroid."""
    whole = centroids.agg(F.sum("inertia").alias("inertia"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    small = centroids.select("cluster", F.col("inertia").alias("own"), digest.alias("centroid_sha256")).crossJoin(F.broadcast(whole))
    return members.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", long("own").alias("cluster_inertia"), long("inertia").alias("inertia"), "centroid_sha256")
