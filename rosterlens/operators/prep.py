"""Model preparation: feature table, encoding, splits, scaling, weights, defaults."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import expressions as ex
from rosterlens.functions import fixed_values as fv
from rosterlens.operators.ranking import approximate_quantiles, exact_quantiles, hash_slices

CODE_SUFFIX = "_code"
MISSING = "nan"


# --- feature tables ---------------------------------------------------------------

def feature_table(hr: DataFrame) -> DataFrame:
    """The stored 38-column feature table."""
    return hr.select(
        fv.ID, fv.TARGET, ex.attrition_flag().alias(fv.FLAG), *fv.STORED_NUMERIC,
        ex.tenure_bucket().alias("tenure_bucket"), ex.income_band().alias("income_band"),
        *[c.alias(name) for name, c in ex.derived_features().items()], *fv.CATEGORICAL_FEATURES)


def model_frame(hr: DataFrame, carry: Sequence[str] = (fv.ID,)) -> DataFrame:
    """The 33 model columns in fixed order, preceded by the carried columns."""
    return hr.select(
        *carry, ex.attrition_flag().alias(fv.FLAG), *fv.NUMERIC_FEATURES,
        *[c.alias(name) for name, c in ex.derived_features().items()], *fv.CATEGORICAL_FEATURES)


def feature_columns(df: DataFrame, drop: Sequence[str] = (fv.FLAG, fv.ID)) -> list[str]:
    return [c for c in df.columns if c not in drop]


# --- encoding ---------------------------------------------------------------------

def with_category_text(df: DataFrame, columns: Sequence[str] = fv.CATEGORICAL_FEATURES) -> DataFrame:
    return df.withColumns({c: ex.category_text(c) for c in columns})


def fit_encoder(df: DataFrame, columns: Sequence[str] = fv.CATEGORICAL_FEATURES) -> StringIndexerModel:
    """Codes 0..k-1 in sorted order of the values; an unseen value raises later."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[c + CODE_SUFFIX for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="error").fit(with_category_text(df.select(*columns), columns))


def label_encode(df: DataFrame, columns: Sequence[str] = fv.CATEGORICAL_FEATURES,
                 encoder: StringIndexerModel | None = None) -> DataFrame:
    """Replace each column by its code."""
    encoder = encoder or fit_encoder(df, columns)
    coded = encoder.transform(with_category_text(df, columns))
    return coded.select(*[
        F.col(c + CODE_SUFFIX).cast("int").alias(c) if c in columns else F.col(c) for c in df.columns])


def encode_value(encoder: StringIndexerModel, column: str, value: str) -> int:
    """Code of one value with a fitted encoder."""
    labels = dict(zip(encoder.getInputCols(), encoder.labelsArray))[column]
    try:
        return labels.index(value)
    except ValueError:
        raise ValueError(f"unseen value {value!r} for {column}") from None


def feature_pipeline(features: Sequence[str] = fv.FEATURES, output: str = "features") -> Pipeline:
    """Categories to codes, then one vector in fixed feature order.

    The addition of zero drops the category metadata that ``StringIndexer``
    attaches.  With it, trees would split codes as unordered sets; without it
    codes are ordered numbers, which is the behaviour to match.
    """
    categories = [f for f in features if f in fv.CATEGORICAL_FEATURES]
    text = ", ".join(f"coalesce(string({c}), '{MISSING}') AS {c}_text" for c in categories)
    codes = ", ".join(f"{c}_index + 0.0D AS {c}{CODE_SUFFIX}" for c in categories)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {text} FROM __THIS__"),
        StringIndexer(inputCols=[f"{c}_text" for c in categories], outputCols=[f"{c}_index" for c in categories],
                      stringOrderType="alphabetAsc", handleInvalid="error"),
        SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__"),
        VectorAssembler(inputCols=[f + CODE_SUFFIX if f in categories else f for f in features],
                        outputCol=output, handleInvalid="error")])


def design_matrix(df: DataFrame, fitted: PipelineModel, output: str = "features") -> DataFrame:
    """The frame with its feature vector, without the columns made on the way."""
    return fitted.transform(df).select(*df.columns, output)


# --- splits -----------------------------------------------------------------------

def _test_rows(classes: dict[int, int], fraction: float) -> dict[int, list[int]]:
    """Test rows per class: ceil(fraction * all), shared out by largest remainder."""
    everyone = sum(classes.values())
    wanted = math.ceil(everyone * fraction)
    shares = {c: divmod(n * wanted, everyone) for c, n in classes.items()}
    left = wanted - sum(whole for whole, _ in shares.values())
    favoured = sorted(shares, key=lambda c: (-shares[c][1], c))[:left]
    return {c: [whole + (c in favoured)] for c, (whole, _) in shares.items()}


def stratified_split(df: DataFrame, label: str = fv.FLAG, id_column: str = fv.ID,
                     fraction: float = fv.TEST_FRACTION, seed: int = fv.SEED,
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Add ``split`` = test / train with the exact share of every class.

    A row's side depends on the hash of its id and the seed only, so the split
    repeats on any cluster and in any engine that has MD5.
    """
    sliced = hash_slices(df, id_column, label, lambda c: _test_rows(c, fraction), seed, classes, "_slice")
    return sliced.withColumn("split", F.when(F.col("_slice") == 0, "test").when(
        F.col("_slice") == 1, "train")).drop("_slice")


def _fold_ranks(classes: dict[int, int], k: int) -> dict[int, list[int]]:
    """Upper ranks of the first k-1 folds of every class.

    With the classes laid end to end, fold i owns every k-th position, which
    keeps the fold sizes of each class, and of the whole, within one row.
    """
    def upto(position: int, fold: int) -> int:
        """Positions below ``position`` that belong to folds 0..fold."""
        whole, rest = divmod(position, k)
        return whole * (fold + 1) + min(rest, fold + 1)

    ranks, start = {}, 0
    for value in sorted(classes):
        end = start + classes[value]
        ranks[value] = [upto(end, fold) - upto(start, fold) for fold in range(k - 1)]
        start = end
    return ranks


def stratified_folds(df: DataFrame, label: str = fv.FLAG, id_column: str = fv.ID, k: int = fv.FOLDS,
                     seed: int = fv.SEED, classes: Sequence[int] = (0, 1), name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1 with class counts within one row of each other."""
    return hash_slices(df, id_column, label, lambda c: _fold_ranks(c, k), seed, classes, name)


# --- scaling, weights, defaults -----------------------------------------------------

def scaling_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation; a constant column has std 1."""
    row = train.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns],
                    *[F.stddev_pop(c).alias(f"std_{c}") for c in columns])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"),
        F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")).alias("std")) for c in columns])))


def standard_scale(train: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``target`` by the statistics of ``train``."""
    stats = scaling_stats(train, columns).agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("mean", "std"))))).scalar()  # one entry per column
    scaled = {c: (F.col(c) - F.col("_stats")[c]["mean"]) / F.col("_stats")[c]["std"] for c in columns}
    return target.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def balanced_weights(df: DataFrame, label: str = fv.FLAG, name: str = "weight") -> DataFrame:
    """Weight n / (2 * rows of the class), so that both classes weigh the same."""
    counts = df.agg(F.struct(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")))
    n0, n1 = F.col("_counts.n0"), F.col("_counts.n1")
    return df.withColumn("_counts", counts.scalar()).withColumn(
        name, (n0 + n1) / (2.0 * F.when(F.col(label) == 1, n1).otherwise(n0))).drop("_counts")


def default_values(df: DataFrame, numeric: Sequence[str] = fv.NUMERIC_FEATURES,
                   categorical: Sequence[str] = fv.CATEGORICAL_FEATURES,
                   derived: Sequence[str] = fv.DERIVED_FEATURES, approximate: bool = False) -> DataFrame:
    """(feature, num_value, cat_value): median or most frequent value, derived ones null.

    All numeric columns go through one value histogram, so no column's values
    ever meet in one task.  Ties of the mode go to the smallest value.
    """
    def unpivoted(columns: Sequence[str], kind: str) -> DataFrame:
        return df.select(F.posexplode(F.array(*[F.col(c).cast(kind) for c in columns])).alias("i", "value"))

    def named(columns: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("feature")

    quantiles = approximate_quantiles if approximate else exact_quantiles
    medians = quantiles(unpivoted(numeric, "double"), "value", {"num_value": 0.5}, ["i"]).select(
        named(numeric), "num_value", F.lit(None).cast("string").alias("cat_value"))

    counts = unpivoted(categorical, "string").where("value IS NOT NULL").groupBy("i", "value").agg(
        F.count(F.lit(1)).alias("n"))
    # Smallest of (-n, value): the most frequent value, first in order on ties.
    modes = counts.groupBy("i").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("best")).select(
        named(categorical), F.lit(None).cast("double").alias("num_value"), F.col("best.value").alias("cat_value"))
    blanks = df.sparkSession.sql(
        "SELECT feature, double(NULL) AS num_value, string(NULL) AS cat_value FROM (SELECT explode(:names) AS feature)",
        args={"names": F.array(*map(F.lit, derived))})
    return medians.unionByName(modes).unionByName(blanks)
