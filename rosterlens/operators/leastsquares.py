"""Triangular factors of tall tables: the R of a QR factorisation, by blocks of rows and then by blocks of triangles.

The squared matrix X'X, which halves the digits, is never formed.  A task holds
one batch of rows and one triangle (columns x columns); tasks meet as triangles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A column is redundant when less than this share of its deviation is left beside the earlier columns.
REDUNDANT = 1e-10
STEP = 1e-8  # a Newton step below this many standard errors ends the fit
_SCHEMA = "part long, triangle array<double>, total double"


@dataclass(frozen=True)
class Scale:
    """Mean and deviation of every column; a constant column has deviation 0."""

    mean: np.ndarray
    deviation: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        divisor = np.where(self.deviation == 0, 1.0, self.deviation)
        return np.where(self.deviation == 0, 0.0, (x - self.mean) / divisor)


def column_scale(df: DataFrame, columns: Sequence[str]) -> Scale:
    """One aggregate over the table.  Raises for an empty table and for nulls, NaN and infinite values."""
    # a comparison that a NaN, an infinity and a null all fail
    finite = [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        make(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, make in (
            ("m", lambda c: F.avg(F.col(c).cast("double"))), ("s", lambda c: F.stddev_pop(F.col(c).cast("double"))),
            ("c", lambda c: F.min(c) == F.max(c)))],
        *[F.bool_and(ok).alias(f"f{i}") for i, ok in enumerate(finite)]).first()
    if not row["n"]:
        raise ValueError("no rows to fit")
    bad = [c for i, c in enumerate(columns) if not row[f"f{i}"]]
    if bad:
        raise ValueError(f"null, NaN or infinite values in {', '.join(bad)}")
    places = range(len(columns))
    return Scale(np.array([row[f"m{i}"] for i in places], dtype=float),
                 np.array([0.0 if row[f"c{i}"] else row[f"s{i}"] for i in places], dtype=float))


def _folded(held: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([held, block]), mode="r")


def triangle(df: DataFrame, columns: Sequence[str], width: int,
             block: Callable[[np.ndarray], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """(R, total): the triangle of ``block(rows)[0]`` over all rows, and the sum of ``block(rows)[1]``.

    ``block`` turns a batch (rows x columns, doubles) into a matrix of ``width``
    columns and a number.  Every task folds its batches into one triangle; these
    are shuffled and folded again, one at a time, so a task of the second step
    holds two of them.  The driver folds what is left, at most one per
    shuffle partition.
    """
    names = list(columns)

    def one_row(part: int, held: np.ndarray, total: float) -> Iterator[pa.RecordBatch]:
        square = np.zeros((width, width))
        square[:len(held)] = held
        yield pa.RecordBatch.from_pydict({"part": [part], "triangle": [square.ravel()], "total": [total]}, schema=pa.schema(
            [("part", pa.int64()), ("triangle", pa.list_(pa.float64())), ("total", pa.float64())]))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, total = np.zeros((0, width)), 0.0
        for batch in batches:
            if batch.num_rows:
                matrix, part = block(np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]))
                held, total = _folded(held, matrix), total + part
        if len(held):
            yield from one_row(TaskContext.get().partitionId(), held, total)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros((0, width)), 0.0
        for batch in batches:
            for flat, part in zip(batch.column("triangle").to_pylist(), batch.column("total").to_pylist()):
                held, total = _folded(held, np.reshape(flat, (width, width))), total + part
        if len(held):
            yield from one_row(0, held, total)

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    tops = doubles.mapInArrow(of_rows, _SCHEMA).repartition("part").mapInArrow(of_triangles, _SCHEMA).collect()
    held = np.zeros((0, width))
    for row in tops:
        held = _folded(held, np.reshape(row["triangle"], (width, width)))
    return held, math.fsum(row["total"] for row in tops)


def independent(r: np.ndarray, tolerance: float = REDUNDANT) -> list[int]:
    """Places of the columns of a triangle that are no linear function of the first column and earlier ones.

    The first column is the intercept.  Works on the columns of R, which have
    the lengths and angles of the table's columns; each is freed twice from
    the kept directions, as once leaves rounding behind.
    """
    basis = r[:, :1] / np.linalg.norm(r[:, 0])
    kept = [0]
    for i in range(1, r.shape[1]):
        column = r[:, i]
        centred = column - basis[:, :1] @ (basis[:, :1].T @ column)
        rest = centred - basis @ (basis.T @ centred)
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > tolerance * np.linalg.norm(centred) and size > 0:
            kept.append(i)
            basis = np.column_stack([basis, rest / size])
    return kept


def _with_intercept(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def redundant_columns(df: DataFrame, columns: Sequence[str], scale: Scale) -> list[str]:
    """Columns that are linear functions of the intercept and earlier columns, from one pass."""
    r, _ = triangle(df, columns, len(columns) + 1, lambda x: (_with_intercept(scale.apply(x)), 0.0))
    kept = independent(r)
    return [c for i, c in enumerate(columns, 1) if i not in kept]


def logit_fit(df: DataFrame, label: str, columns: Sequence[str], scale: Scale, max_steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance) of the maximum-likelihood logit, intercept first, in the columns' own units.

    A Newton step is a least-squares problem in the working residuals, solved
    from its triangle; one pass per step.  A step that raises the deviance is
    halved.  Where the classes are separated no maximum exists; the values of
    the last step come back, with very large errors.
    """
    width = len(columns) + 2

    def block_at(beta: np.ndarray):
        def block(rows: np.ndarray) -> tuple[np.ndarray, float]:
            x, y = _with_intercept(scale.apply(rows[:, 1:])), rows[:, 0]
            eta = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            root = np.sqrt(np.maximum(p * (1.0 - p), 1e-12))
            deviance = 2.0 * float(np.sum(np.logaddexp(0.0, eta) - y * eta))
            return np.column_stack([x * root[:, None], (y - p) / root]), deviance
        return block

    beta, step, before = np.zeros(width - 1), np.zeros(width - 1), math.inf
    for _ in range(max_steps):
        r, deviance = triangle(df, [label, *columns], width, block_at(beta))
        if deviance > before * (1 + 1e-12) and np.abs(step).max() > 1e-12:
            step = step / 2
            beta = beta - step
            continue
        top = np.zeros((width - 1, width))
        top[:min(len(r), width - 1)] = r[:width - 1]
        step = np.linalg.solve(top[:, :-1], top[:, -1])
        beta, before = beta + step, deviance
        if np.linalg.norm(top[:, -1]) < STEP:  # the length of the step in standard errors
            break
    inverse = np.linalg.inv(top[:, :-1])
    covariance = inverse @ inverse.T
    back = np.eye(width - 1)  # from scaled columns to the columns' own units
    divisor = np.where(scale.deviation == 0, 1.0, scale.deviation)
    back[1:, 1:] = np.diag(1.0 / divisor)
    back[0, 1:] = -scale.mean / divisor
    return back @ beta, back @ covariance @ back.T
