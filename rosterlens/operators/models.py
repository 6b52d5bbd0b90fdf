"""Random forest: training, scoring, importance and cross-validated AUC."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators.metrics import roc_auc
from rosterlens.operators.prep import balanced_weights, stratified_folds

# Bagging depends on the partitions of the training rows, so their number is a parameter of the model and never
# follows the cluster.  It follows the table beyond 9.6 million rows: a task reads its rows' bagging counts and node ids,
# some kilobytes a row, at every level.
FIT_PARTITIONS, FIT_ROWS = 32, 300_000
SEED_STEP = 1_000_003  # between groups of trees; Spark adds the partition's number to the seed of its bagging


def partitions_for(df: DataFrame, fit_rows: int = FIT_ROWS) -> int:
    """Fit partitions of a table: ``FIT_PARTITIONS``, more where one would have over ``fit_rows`` rows; one count."""
    return max(FIT_PARTITIONS, -(-df.count() // fit_rows))


def tree_groups_for(df: DataFrame, trees: int, room: int = FIT_PARTITIONS * FIT_ROWS * fv.FOREST_TREES) -> int:
    """Groups in which the trees of a forest are fitted: one up to ``room`` pairs of row and tree, more of half that size beyond.

    The default is 9.6 million rows for ``FOREST_TREES`` trees.  Spark keeps bagging counts and node ids of four bytes
    for every pair, so a group's share is all that is on disk at once.  One count.
    """
    if trees == 1:
        return 1
    pairs = df.count() * trees
    return 1 if pairs <= room else min(trees, -(-2 * pairs // room))


def joined_forest(forests: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several, in their order."""
    java = [f._java_obj for f in forests]
    trees = [tree for one in java for tree in one.trees()]
    context = SparkContext._active_spark_context
    array = context._gateway.new_array(context._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    whole = context._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        java[0].uid(), array, java[0].numFeatures(), java[0].numClasses())
    java[0].copyValues(whole, context._jvm.org.apache.spark.ml.param.ParamMap.empty())
    whole.set(whole.numTrees(), len(trees))
    return JavaParams._from_java(whole)


def training_order(df: DataFrame, partitions: int = FIT_PARTITIONS, key: str = fv.ID) -> DataFrame:
    """Rows in a fixed number of partitions, each sorted by id, so that a fit repeats on any cluster."""
    return df.repartition(partitions, key).sortWithinPartitions(key)


def fit_forest(train: DataFrame, label: str = fv.FLAG, features: str = "features", trees: int = fv.FOREST_TREES,
               depth: int = fv.FOREST_DEPTH, min_leaf: int = fv.FOREST_MIN_LEAF, seed: int = fv.SEED,
               subsample: float = 1.0, bootstrap: bool = True, fit_partitions: int | None = None,
               keep_node_ids: bool = True, tree_groups: int | None = None) -> RandomForestClassificationModel:
    """Class-balanced forest with sqrt(features) candidates per split.

    Every tree level of all trees is one distributed aggregation.  The forest
    depends on rows, seed and ``fit_partitions`` only; without a number of these,
    the rows decide (``partitions_for``).  ``keep_node_ids`` saves
    a walk over all trees at every level and takes four bytes per row and tree;
    turn it off where the executors have no room for that.  ``subsample`` below
    1 bags less of a very large table per tree.

    Beyond 9.6 million rows (``tree_groups_for``) the trees are fitted in groups,
    one after the other over the same rows, each with a seed of its own; trees of
    a forest do not depend on one another, so all of them make one forest.
    """
    fit_partitions = fit_partitions or partitions_for(train)
    groups = tree_groups or tree_groups_for(train, trees)
    data = training_order(train.select(fv.ID, features, F.col(label).cast("double").alias(label)), fit_partitions)
    weighted = balanced_weights(data, label)

    def fit(group: int) -> RandomForestClassificationModel:
        return RandomForestClassifier(
            featuresCol=features, labelCol=label, weightCol="weight", numTrees=trees // groups + (group < trees % groups), maxDepth=depth,
            minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", subsamplingRate=subsample, seed=seed + SEED_STEP * group,
            bootstrap=bootstrap, maxMemoryInMB=1024, cacheNodeIds=keep_node_ids, checkpointInterval=10).fit(weighted)

    if groups == 1:
        return fit(0)
    weighted = weighted.persist()
    try:
        fitted = []
        for group in range(groups):
            fitted.append(fit(group))
            train.sparkSession.sparkContext._jvm.System.gc()  # Spark removes a group's shuffle files when they are collected
    finally:
        weighted.unpersist()
    return joined_forest(fitted)


def score(model: RandomForestClassificationModel, df: DataFrame, name: str = "score",
          predicted: str | None = "predicted") -> DataFrame:
    """Add P(class 1) and the predicted class; a narrow transformation."""
    scored = model.transform(df)
    kept = [F.col(c) for c in df.columns] + [vector_to_array("probability")[1].alias(name)]
    if predicted:
        kept.append(F.col("prediction").cast("int").alias(predicted))
    return scored.select(*kept)


def feature_importance(model: RandomForestClassificationModel, spark, features: Sequence[str] = fv.FEATURES,
                       k: int = 15) -> DataFrame:
    """Normalised Gini importances, largest first (one row per feature, from the model)."""
    pairs = list(zip(features, (float(v) for v in model.featureImportances.toArray())))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(k)


def fold_aucs(df: DataFrame, label: str = fv.FLAG, features: str = "features", k: int = fv.FOLDS,
              seed: int = fv.SEED, parallelism: int = 2, fit_partitions: int | None = None, **forest) -> DataFrame:
    """(fold, auc): fit on the other folds, evaluate on the fold.

    A few fits run side by side so that the short last levels of one forest
    overlap with another.  The folds are kept across the fits.
    """
    spark = df.sparkSession
    fit_partitions = fit_partitions or partitions_for(df)
    folded = stratified_folds(df.select(fv.ID, label, features), label, k=k, seed=seed)
    folded = training_order(folded, fit_partitions).persist()

    def one(fold: int) -> tuple[int, float]:
        model = fit_forest(folded.where(F.col("fold") != fold), label, features, seed=seed,
                           fit_partitions=fit_partitions, **forest)
        held_out = score(model, folded.where(F.col("fold") == fold), predicted=None)
        return fold, roc_auc(held_out, label, "score").first()["auc"]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(one, range(k)))
    finally:
        folded.unpersist()
    return spark.createDataFrame(results, "fold int, auc double")


def cv_auc(df: DataFrame, **options) -> DataFrame:
    """Mean and population deviation of the fold AUCs."""
    return fold_aucs(df, **options).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
