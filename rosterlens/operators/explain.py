"""Exact path-dependent tree SHAP as a Spark job, and the reports on top of it.

For one leaf reached through ``m`` distinct features, let ``o_j`` be 1 when
the row satisfies all conditions on feature j along the path and ``z_j`` the
share of training weight that passes them.  The leaf's contribution to
feature j is

    value * (o_j - z_j) * integral over t in [0, 1] of
                          prod over i != j of (t * o_i + (1 - t) * z_i)

which equals the Shapley sum because the integral of t^s (1-t)^(m-1-s) is
s! (m-1-s)! / m!.  The integrand has degree m - 1, so Gauss-Legendre with
ceil(m / 2) nodes is exact.  A row matters to a leaf only through the bits
``o``, so each pattern that occurs in a batch of rows is evaluated once.
Neighbouring leaves share most conditions: a few of them are looked up at once
by the pattern of all thresholds they ask.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv

BATCH_ROWS = 32_768
SLICE_LEAVES, MARKED = 256, 10  # leaves handled at once; features up to which all patterns of a leaf have a place
BUNDLE_BITS = 9  # thresholds that the leaves of a bundle ask together
GROUP_NODES = 500_000  # nodes of the trees that are broadcast together; more trees make more groups


# --- the forest as paths ----------------------------------------------------------

def node_table(spark: SparkSession, forest_path: str) -> DataFrame:
    """(tree, id, left, right, feature, threshold, n0, n1) of a saved forest.

    Its size depends on the number of trees and their depth, not on the data.
    """
    node = F.col("nodeData")
    return spark.read.parquet(f"{forest_path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"), node["impurityStats"][0].alias("n0"), node["impurityStats"][1].alias("n1"))


def base_value(nodes: DataFrame) -> DataFrame:
    """Mean probability of class 1 at the roots."""
    return nodes.where("id = 0").agg(F.avg(F.col("n1") / (F.col("n0") + F.col("n1"))).alias("base_value"))


@dataclass(frozen=True)
class Leaves:
    """Up to ``SLICE_LEAVES`` leaves of a tree that use the same number of features, ready for batches of rows.

    ``conditions`` has, per feature, the leaves that use it, the bit it sets in
    their patterns, and the interval in which a value sets it.  ``features`` and
    the shares ``z`` have one row per leaf, ``value`` one number.  The size is in
    proportion to the conditions.
    """

    conditions: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    features: np.ndarray
    z: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Bundle:
    """Neighbouring leaves that ask at most ``BUNDLE_BITS`` thresholds together.

    Bit k of a row's pattern is set where its feature is at most the k-th of
    ``thresholds``.  A leaf's condition on a feature holds where the bits
    ``asked`` are exactly ``met``.  A feature that a leaf does not use has a
    condition that always holds and the share 1, which changes nothing.
    """

    thresholds: list[tuple[int, float]]
    features: np.ndarray
    asked: np.ndarray
    met: np.ndarray
    z: np.ndarray
    value: np.ndarray


def _thresholds(leaf: tuple) -> set[tuple[int, float]]:
    """Every (feature, threshold) that decides whether a row is in a leaf."""
    return {(int(f), float(t)) for f, *bounds in zip(*leaf[1:4]) for t in bounds if np.isfinite(t)}


def _bundle(leaves: list[tuple]) -> Bundle:
    thresholds = sorted(set().union(*map(_thresholds, leaves)))
    bit = {t: 1 << k for k, t in enumerate(thresholds)}
    features = np.unique(np.concatenate([leaf[1] for leaf in leaves]))
    place = {int(f): j for j, f in enumerate(features)}
    asked, met = (np.zeros((len(leaves), len(features)), np.int32) for _ in range(2))
    z = np.ones(asked.shape)
    for i, (_, names, lows, highs, shares) in enumerate(leaves):
        for f, low, high, share in zip(names, lows, highs, shares):
            j = place[int(f)]
            met[i, j] = bit.get((int(f), float(high)), 0)
            asked[i, j] = met[i, j] | bit.get((int(f), float(low)), 0)
            z[i, j] = share
    return Bundle(thresholds, features, asked, met, z, np.array([leaf[0] for leaf in leaves]))


def prepared(leaves: list[tuple]) -> list[Bundle | Leaves]:
    """A tree's leaves (value, features, lower, upper, z): bundles of neighbours, and slices of those that ask too much."""
    leaves = [leaf for leaf in leaves if len(leaf[1])]
    bundles, rest, held, asked = [], [], [], set()
    for leaf in leaves:
        mine = _thresholds(leaf)
        if len(mine) > BUNDLE_BITS:
            rest.append(leaf)
            continue
        if held and len(asked | mine) > BUNDLE_BITS:
            bundles.append(_bundle(held))
            held, asked = [], set()
        held.append(leaf)
        asked |= mine
    return bundles + ([_bundle(held)] if held else []) + _slices(rest)


def _slices(leaves: list[tuple]) -> list[Leaves]:
    sizes = np.array([len(leaf[1]) for leaf in leaves])
    slices = []
    for m in np.unique(sizes):
        members = np.flatnonzero(sizes == m)
        for at in range(0, len(members), SLICE_LEAVES):
            part = [leaves[i] for i in members[at:at + SLICE_LEAVES]]
            features, low, high, z = (np.array([leaf[i] for leaf in part]) for i in (1, 2, 3, 4))
            conditions = []
            for f in np.unique(features):
                leaf, place = np.nonzero(features == f)
                conditions.append((int(f), leaf, 1 << place, low[leaf, place], high[leaf, place]))
            slices.append(Leaves(conditions, features, z, np.array([leaf[0] for leaf in part])))
    return slices


def tree_groups(nodes: DataFrame, group_nodes: int = GROUP_NODES) -> list[tuple[int, int]]:
    """(first, last) tree of runs of trees with about ``group_nodes`` nodes; one row per tree is collected."""
    sizes = sorted((r["tree"], r["count"]) for r in nodes.groupBy("tree").count().collect())
    runs, held = [], 0
    for tree, size in sizes:
        if not runs or held + size > group_nodes:
            runs.append((tree, tree))
            held = 0
        runs[-1] = (runs[-1][0], tree)
        held += size
    return runs


def load_trees(nodes: DataFrame, first: int, last: int, count: int) -> list[list[Bundle | Leaves]]:
    """Trees ``first`` to ``last`` of a forest of ``count``, with leaf values as shares of the forest's mean."""
    frame = nodes.where(F.col("tree").between(first, last)).toPandas()  # about GROUP_NODES rows
    if ((frame["left"] >= 0) & (frame["categories"] >= 0)).any():
        raise ValueError("the forest has unordered category splits; train it on plain numeric vectors")
    return [prepared([(value / count, *rest) for value, *rest in _leaves(part)]) for _, part in frame.groupby("tree", sort=True)]


def _leaves(tree: pd.DataFrame) -> list[tuple]:
    nodes = {row.id: row for row in tree.itertuples(index=False)}
    leaves, stack = [], [(0, {})]
    while stack:
        node_id, conditions = stack.pop()
        node = nodes[node_id]
        if node.left < 0:
            names = sorted(conditions)
            bounds = np.array([conditions[f] for f in names]).reshape(-1, 3)
            leaves.append((node.n1 / (node.n0 + node.n1), np.array(names, dtype=np.int64),
                           bounds[:, 0], bounds[:, 1], bounds[:, 2]))
            continue
        weight = node.n0 + node.n1
        for child, goes_left in ((node.left, True), (node.right, False)):
            low, high, z = conditions.get(node.feature, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, node.threshold)) if goes_left else (max(low, node.threshold), high)
            share = (nodes[child].n0 + nodes[child].n1) / weight
            stack.append((child, {**conditions, node.feature: (low, high, z * share)}))
    return leaves


# --- contributions of a batch ------------------------------------------------------

@lru_cache(maxsize=None)
def _points(m: int) -> list[tuple[float, float]]:
    """Points and weights on [0, 1] that integrate a polynomial of degree m - 1 exactly."""
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    return list(zip((points + 1) / 2, weights / 2))


def _pattern_values(codes: np.ndarray, z: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contributions (pattern, feature) for patterns ``codes`` of leaves with shares ``z`` (pattern, feature)."""
    m = z.shape[1]
    o = ((codes[:, None] >> np.arange(m)) & 1).astype(float)
    total = np.zeros(o.shape)
    for t, w in _points(m):
        factor = t * o + (1 - t) * z
        total += w * factor.prod(axis=1, keepdims=True) / factor
    return value[:, None] * (o - z) * total


def _add_bundle(bundle: Bundle, columns: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of a bundle to ``out`` (feature, row), for values ``columns`` (feature, row)."""
    codes = np.zeros(columns.shape[1], np.uint16)
    for k, (f, threshold) in enumerate(bundle.thresholds):
        codes |= (columns[f] <= threshold).astype(np.uint16) << np.uint16(k)
    marks = np.zeros(1 << len(bundle.thresholds), bool)
    marks[codes] = True
    patterns = np.flatnonzero(marks)
    o = (patterns[:, None, None] & bundle.asked) == bundle.met  # (pattern, leaf, feature)
    total = np.zeros(o.shape)
    for t, w in _points(o.shape[2]):
        factor = t * o + (1 - t) * bundle.z
        total += w * factor.prod(axis=2, keepdims=True) / factor
    table = np.zeros((o.shape[2], len(marks)))
    table[:, patterns] = np.einsum("l,plf,plf->fp", bundle.value, o - bundle.z, total)
    at = codes.astype(np.intp)
    for j, f in enumerate(bundle.features):
        out[f] += table[j].take(at, mode="clip")  # all are in range; spares the check


def _add_leaves(leaves: Leaves, columns: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of some leaves to ``out`` (feature, row), for values ``columns`` (feature, row).

    Patterns that occur are marked in a table of all patterns of a leaf, which
    then holds their contributions, so a row's are read by its pattern.  Leaves
    with more than ``MARKED`` features have too many; theirs are sorted.
    """
    count, m = leaves.features.shape
    codes = np.zeros((count, columns.shape[1]), np.uint16 if m <= 15 else np.int64)
    for f, leaf, bit, low, high in leaves.conditions:
        inside = columns[f] > low[:, None]
        inside &= columns[f] <= high[:, None]
        codes[leaf] |= inside * bit[:, None].astype(codes.dtype)
    if m > MARKED:
        for k in range(count):
            patterns, at = np.unique(codes[k], return_inverse=True)
            found = _pattern_values(patterns, np.broadcast_to(leaves.z[k], (len(patterns), m)), np.full(len(patterns), leaves.value[k]))
            for j, f in enumerate(leaves.features[k]):
                out[f] += found[:, j][at]
        return
    marks = np.zeros((count, 1 << m), bool)
    for k in range(count):
        marks[k, codes[k]] = True
    leaf, pattern = np.nonzero(marks)
    table = np.zeros((m, count, 1 << m))
    table[:, leaf, pattern] = _pattern_values(pattern, leaves.z[leaf], leaves.value[leaf]).T
    for k in range(count):
        at = codes[k].astype(np.intp)
        for j, f in enumerate(leaves.features[k]):
            out[f] += table[j, k].take(at, mode="clip")  # all are in range; spares the check


def shap_matrix(trees: list[list[Bundle | Leaves]], x: np.ndarray) -> np.ndarray:
    """Contributions of every row and feature, summed over the trees; NaN counts as larger than every threshold."""
    columns = np.ascontiguousarray(np.nan_to_num(x.astype(float), nan=np.inf, posinf=np.inf, neginf=np.finfo(float).min).T)
    out = np.zeros(columns.shape)
    for tree in trees:
        for leaves in tree:
            (_add_bundle if isinstance(leaves, Bundle) else _add_leaves)(leaves, columns, out)
    return out.T


# --- the Spark job -----------------------------------------------------------------

def explain_forest(df: DataFrame, forest_path: str, id_column: str = fv.ID, vector: str = "features",
                   features: Sequence[str] = fv.FEATURES, carry: Sequence[str] = (),
                   group_nodes: int = GROUP_NODES) -> DataFrame:
    """(id, carried columns, contributions): one row in, one row out, no shuffle.

    ``contributions`` is an array of (feature, value, shap) in feature order.
    Trees are broadcast in groups of about ``group_nodes`` nodes, prepared once;
    a larger forest has more groups, one after the other in the same narrow
    plan.  Small Arrow batches are joined to bounded larger ones, so that a
    pattern is evaluated once for many rows.
    """
    context = df.sparkSession.sparkContext
    nodes = node_table(df.sparkSession, forest_path)
    runs = tree_groups(nodes, group_nodes)
    count = runs[-1][1] - runs[0][0] + 1
    keys = [id_column, *carry]
    x = vector_to_array(vector)
    raw = df.select(*keys, F.transform(x, lambda _: F.lit(0.0)).alias("_shap"), x.alias("_x"))

    def adding(trees):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _joined(batches):
                found = shap_matrix(trees.value, np.stack(frame["_x"].to_numpy()))
                yield frame.assign(_shap=list(np.stack(frame["_shap"].to_numpy()) + found))
        return run

    for first, last in runs:  # each group of trees adds its contributions to the row
        raw = raw.mapInPandas(adding(context.broadcast(load_trees(nodes, first, last, count))), raw.schema)
    names = F.array(*map(F.lit, features))
    zipped = F.transform(F.arrays_zip(names.alias("f"), F.col("_x").alias("v"), F.col("_shap").alias("s")),
                         lambda c: F.struct(c["f"].alias("feature"), c["v"].alias("value"), c["s"].alias("shap")))
    return raw.select(*keys, zipped.alias("contributions"))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        if batch.empty:
            continue
        held.append(batch)
        size += len(batch)
        if size >= BATCH_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def to_long(explained: DataFrame) -> DataFrame:
    """One row per contribution, next to the other columns."""
    others = [c for c in explained.columns if c != "contributions"]
    return explained.select(*others, F.inline("contributions"))


# --- reports on explanations ---------------------------------------------------------

def _by_place(explained: DataFrame, features: Sequence[str], **columns) -> DataFrame:
    """One row per feature from one aggregate over the arrays: ``columns`` are functions of (shap, value)."""
    at = lambda i, field: F.get("contributions", F.lit(i))[field]
    row = explained.agg(*[make(at(i, "shap"), at(i, "value")).alias(f"{name}_{i}")
                          for i in range(len(features)) for name, make in columns.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in columns]) for i, f in enumerate(features)])))


def shap_importance(explained: DataFrame, k: int = 15, features: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Mean absolute contribution per feature, the ``k`` largest.

    Contributions stand in the order of ``features`` in every row, so one
    average per place is enough and no row is taken apart.
    """
    return _by_place(explained, features, mean_abs_shap=lambda shap, value: F.avg(F.abs(shap))).orderBy(
        F.desc("mean_abs_shap"), "feature").limit(k)


def shap_summary_data(explained: DataFrame, id_column: str = fv.ID, k: int = 15,
                      features: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Every point of the ``k`` strongest features with its value scaled to [0, 1].

    One aggregate finds the features and their spans, a second pass the points.
    """
    top = _by_place(explained, features, mean_abs_shap=lambda shap, value: F.avg(F.abs(shap)),
                    _lo=lambda shap, value: F.min(value), _hi=lambda shap, value: F.max(value)).orderBy(
        F.desc("mean_abs_shap"), "feature").limit(k).select("feature", "_lo", "_hi")
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return to_long(explained).join(F.broadcast(top), "feature").select(  # k rows
        id_column, "feature", "value", "shap", scaled.alias("scaled"))


def _by_strength(contributions: str = "contributions"):
    """Contributions, largest absolute value first, ties by feature name; sorted natively, no element is null."""
    keyed = F.transform(contributions, lambda c: F.struct(
        (-F.abs(c["shap"])).alias("k"), c["feature"].alias("feature"), c["value"].alias("value"),
        c["shap"].alias("shap")))
    return F.sort_array(keyed)


def top_factors(explained: DataFrame, id_column: str = fv.ID, k: int = 6) -> DataFrame:
    """The ``k`` strongest factors of every row, with direction and label.

    Sorting happens inside the row's array, so nothing is shuffled.
    """
    ranked = explained.select(id_column, F.posexplode(F.slice(_by_strength(), 1, k)).alias("_pos", "c"))
    return ranked.select(
        id_column, (F.col("_pos") + 1).alias("rank"), F.col("c.feature").alias("feature"),
        ex.display_name("c.feature").alias("label"), F.col("c.value").alias("value"),
        F.col("c.shap").alias("shap"), ex.direction("c.shap").alias("direction"))


def waterfall(explained: DataFrame, base: DataFrame | float, id_column: str = fv.ID,
              max_display: int = 12) -> DataFrame:
    """Steps from the base value to the prediction, weakest group first.

    The strongest ``max_display - 1`` features stand alone and the rest are
    one step; with no more than ``max_display`` features all stand alone.
    (id, step, label, value, shap, start, end); all inside the row.
    """
    start_at = base.scalar() if isinstance(base, DataFrame) else F.lit(float(base))
    ranked = explained.select(id_column, start_at.alias("base_value"), _by_strength().alias("c"))
    n = F.size("c")
    shown = F.when(n <= max_display, n).otherwise(F.lit(max_display - 1))
    entry = lambda label, value, shap: F.struct(
        label.alias("label"), value.cast("double").alias("value"), shap.alias("shap"))
    single = F.transform(F.slice("c", F.lit(1), shown), lambda c: entry(c["feature"], c["value"], c["shap"]))
    rest = F.slice("c", shown + 1, n)
    rest_sum = F.aggregate(rest, F.lit(0.0), lambda acc, c: acc + c["shap"])
    tail = F.when(F.size(rest) > 0, F.array(entry(
        F.concat(F.size(rest).cast("string"), F.lit(" other features")), F.lit(None), rest_sum))).otherwise(
        F.array().cast("array<struct<label:string,value:double,shap:double>>"))
    steps = ranked.select(id_column, "base_value", F.reverse(F.concat(single, tail)).alias("s"))
    # Starts are summed inside the array, so that no step's row carries the whole array along.
    before = lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.col("base_value"), lambda acc, c: acc + c["shap"])
    placed = F.transform("s", lambda c, i: F.struct(
        (i + 1).alias("step"), c["label"].alias("label"), c["value"].alias("value"), c["shap"].alias("shap"), before(i).alias("start")))
    return steps.select(id_column, F.inline(placed)).withColumn("end", F.col("start") + F.col("shap"))


def shap_dependence(explained: DataFrame, feature: str = "OverTime", by: str = "JobSatisfaction",
                    id_column: str = fv.ID) -> DataFrame:
    """Value and contribution of one feature with the value of another, per row."""
    pick = lambda name: F.get(F.filter("contributions", lambda c: c["feature"] == name), F.lit(0))
    return explained.select(id_column, pick(feature).alias("_f"), pick(by).alias("_b")).select(
        id_column, F.col("_f.value").alias("value"), F.col("_f.shap").alias("shap"), F.col("_b.value").alias("by_value"))
