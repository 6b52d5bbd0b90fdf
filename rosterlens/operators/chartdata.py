"""Data behind scatter charts whose size does not grow with the table: counts per cell and a sample of points.

A chart of every point has as many rows as the table.  Here a plane is cut into
cells; each comes with its count, and at most a few points of each cell,
chosen by a hash of the id, stand for the rest with a weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import explain

HASH_DIGITS = 15  # hex digits of a hash that fit a positive bigint
SPAN = ("_x_lo", "_x_hi", "_y_lo", "_y_hi")


def _finite(name: str) -> Column:
    """The value as a double; null where it is null, NaN or infinite."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def spans(points: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Lowest and highest finite ``x`` and ``y``: one row, or one per group."""
    return points.groupBy(*group).agg(F.min(_finite(x)).alias("_x_lo"), F.max(_finite(x)).alias("_x_hi"),
                                      F.min(_finite(y)).alias("_y_lo"), F.max(_finite(y)).alias("_y_hi"))


def _bin(name: str, low: str, high: str, bins: int) -> Column:
    value = _finite(name)
    place = F.floor((value - F.col(low)) / (F.col(high) - F.col(low)) * bins).cast("int") + 1
    return F.when(value.isNotNull() & F.col(low).isNotNull(), F.when(F.col(low) == F.col(high), 1).otherwise(F.least(place, F.lit(bins))))


def with_cells(points: DataFrame, x: str, y: str, group: Sequence[str] = (), bins: int = 20,
               span: DataFrame | None = None) -> DataFrame:
    """The points with ``x_bin`` and ``y_bin``, 1 to ``bins``, of equal width between the group's lowest and highest value.

    The last bin is closed, equal values are all in bin 1, and a value that is
    null, NaN or infinite is in no bin (null), as are null groups.  ``span`` is
    the result of ``spans`` where the caller has it; it has a row per group and is
    joined as Spark sees fit.  The columns ``x_bin`` and ``y_bin`` must be free.
    """
    found = spans(points, x, y, group) if span is None else span
    joined = points.join(found, list(group), "left") if group else points.crossJoin(F.broadcast(found))  # one row
    return joined.withColumns({"x_bin": _bin(x, "_x_lo", "_x_hi", bins), "y_bin": _bin(y, "_y_lo", "_y_hi", bins)}).drop(*SPAN)


def density(cells: DataFrame, group: Sequence[str] = (), averages: Sequence[str] = ()) -> DataFrame:
    """(group, x_bin, y_bin, n, averages): rows per cell, with ``avg_<column>`` of other columns, say for a colour.

    At most groups * (bins + 1)^2 rows, combined before the shuffle.
    """
    return cells.groupBy(*group, "x_bin", "y_bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in averages])


def hash_start(id_column: str, seed: int) -> Column:
    """The first digits of the MD5 of id and seed as a number, in the order of the hash."""
    hashed = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(hashed, 1, HASH_DIGITS), 16, 10).cast("bigint")


def sample(cells: DataFrame, id_column: str, group: Sequence[str] = (), per_cell: int = 3, seed: int = fv.SEED,
           few_groups: bool = False) -> DataFrame:
    """At most ``per_cell`` rows of every cell, with ``n`` rows in the cell and ``weight`` = n / rows kept of it.

    The rows with the smallest MD5 of id and seed, ties by id; the choice
    repeats on any cluster and does not depend on other cells.  One combined
    aggregate finds the smallest hash of each of a cell's slots.  Rows in
    different slots differ, so ``per_cell`` of these bound the hashes to keep, and
    only the few rows up to the bound are shuffled and ranked, also in a cell
    with a third of all rows.  A cell with fewer slots in use ranks all its
    rows.  ``few_groups`` sends the table of cells to every task; without it
    groups may be many.  ``cells`` may bring ``hash_start`` as ``_start``.  Rows
    without a bin form cells of their own.  Rows that agree in id are told apart
    by nothing: any may stay.
    """
    keys = [*group, "x_bin", "y_bin"]
    hashed = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))
    points = cells if "_start" in cells.columns else cells.withColumn("_start", hash_start(id_column, seed))
    least = points.groupBy(*keys, F.pmod("_start", F.lit(max(16, 4 * per_cell))).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_start").alias("_least"))
    bound = F.get(F.sort_array(F.collect_list("_least")), F.lit(per_cell - 1))  # of one value per slot; null with fewer
    found = least.groupBy(*keys).agg(F.sum("_rows").alias("n"), bound.alias("_bound")).withColumnsRenamed({c: f"_in_{c}" for c in keys})
    near = points.join(F.broadcast(found) if few_groups or not group else found, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in keys]).where(
        F.col("_start").isNull() | F.col("_bound").isNull() | (F.col("_start") <= F.col("_bound"))).drop(*[f"_in_{c}" for c in keys])
    order = Window.partitionBy(*keys).orderBy(hashed, id_column)
    kept = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_cell).drop("_place", "_start", "_bound")
    return kept.withColumn("weight", F.col("n") / F.least(F.col("n"), F.lit(per_cell)))


# --- explanations -----------------------------------------------------------------------

def _strongest(explained: DataFrame, k: int, features: Sequence[str], bins: int) -> DataFrame:
    """Contributions of the ``k`` strongest features, with the cell of value (x) and contribution (y)."""
    make = lambda least, of: lambda shap, value: least(F.when(F.abs(of(shap, value)) < float("inf"), of(shap, value)))
    first, second = (lambda shap, value: value), (lambda shap, value: shap)
    top = explain._by_place(
        explained, features, _strength=lambda shap, value: F.avg(F.abs(shap)), _x_lo=make(F.min, first), _x_hi=make(F.max, first),
        _y_lo=make(F.min, second), _y_hi=make(F.max, second)).orderBy(F.desc("_strength"), "feature").limit(k).drop("_strength")
    points = explain.to_long(explained)
    return with_cells(points.join(F.broadcast(top.select("feature")), "feature", "left_semi"),  # k rows
                      "value", "shap", ["feature"], bins, F.broadcast(top))


def shap_density(explained: DataFrame, k: int = 15, features: Sequence[str] = fv.FEATURES, bins: int = 20) -> DataFrame:
    """(feature, value_bin, shap_bin, n): the summary chart as counts, at most k * bins^2 rows and one for nulls."""
    return density(_strongest(explained, k, features, bins), ["feature"]).withColumnsRenamed({"x_bin": "value_bin", "y_bin": "shap_bin"})


def shap_sample(explained: DataFrame, id_column: str = fv.ID, k: int = 15, features: Sequence[str] = fv.FEATURES,
                bins: int = 20, per_cell: int = 3, seed: int = fv.SEED) -> DataFrame:
    """(id, feature, value, shap, value_bin, shap_bin, n, weight): points that stand for the summary chart."""
    hashed = explained.select(id_column, "contributions", hash_start(id_column, seed).alias("_start"))  # once per id, not per point
    cells = _strongest(hashed, k, features, bins)
    return sample(cells, id_column, ["feature"], per_cell, seed, few_groups=True).withColumnsRenamed({"x_bin": "value_bin", "y_bin": "shap_bin"})


def dependence_density(explained: DataFrame, feature: str = "OverTime", by: str = "JobSatisfaction",
                       id_column: str = fv.ID, bins: int = 20) -> DataFrame:
    """(value_bin, shap_bin, n, avg_by_value): the dependence chart as counts, coloured by the other feature's mean."""
    points = explain.shap_dependence(explained, feature, by, id_column)
    return density(with_cells(points, "value", "shap", bins=bins), averages=["by_value"]).withColumnsRenamed(
        {"x_bin": "value_bin", "y_bin": "shap_bin"})
