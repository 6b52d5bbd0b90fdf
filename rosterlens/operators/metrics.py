"""Exact evaluation of binary scores, distributed over the distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.expressions import pct
from rosterlens.operators.ranking import running_totals


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; a hot score becomes one row.

    Rows without a score are dropped after they are combined: a filter on the
    score would be pushed below it and compute a model's score a second time.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"), F.count(score).alias("_scored"))
    return counts.where("_scored > 0").drop("_scored")


def roc_auc(df: DataFrame, label: str, score: str, **ranking) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half.

    Null when a class is absent.
    """
    ranked = running_totals(score_counts(df, label, score), "score", ["pos", "neg"], **ranking)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, drop_collinear: bool = False,
              **ranking) -> DataFrame:
    """(threshold, fpr, tpr) from the strictest threshold down, starting at (0, 0).

    ``drop_collinear`` leaves out points on a straight line between their
    neighbours.
    """
    ranked = running_totals(score_counts(df, label, score), "score", ["pos", "neg"], **ranking)
    if drop_collinear:
        ranked = _bends(ranked)
    at_least = lambda c: F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(at_least("neg").cast("double"), F.col("total_neg").cast("double")).alias("fpr"),
        F.try_divide(at_least("pos").cast("double"), F.col("total_pos").cast("double")).alias("tpr"))
    start = df.sparkSession.sql("SELECT double('infinity') AS threshold, 0.0D AS fpr, 0.0D AS tpr")
    return start.unionByName(points)


def _bends(ranked: DataFrame) -> DataFrame:
    """Keep both ends and the points where the step to the next one changes.

    The next lower score of a bucket's first row is the last row of the nearest
    earlier bucket, taken from the table of buckets.
    """
    stepped = ranked.withColumn("_step", F.struct("pos", "neg"))
    across = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # one row per bucket
    edges = stepped.groupBy("_bucket").agg(F.max_by("_step", "score").alias("_last")).select(
        F.col("_bucket").alias("_at"), F.lag("_last").over(across).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("score")
    following = F.coalesce(F.lag("_step").over(inside), F.col("_before"))
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("total_pos") + F.col("total_neg")
    return stepped.join(F.broadcast(edges), F.col("_bucket") == F.col("_at")).withColumn("_next", following).where(
        first | F.col("_next").isNull() | (F.col("_next") != F.col("_step")))


def _cells(label: str, predicted: str) -> list[Column]:
    actual, guess = F.col(label) == 1, F.col(predicted) == 1
    return [F.count_if(~actual & ~guess).alias("tn"), F.count_if(~actual & guess).alias("fp"),
            F.count_if(actual & ~guess).alias("fn"), F.count_if(actual & guess).alias("tp")]


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(actual, predicted, n), zero cells included; one global aggregation."""
    cell = lambda a, p, c: F.struct(
        F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
    return df.agg(*_cells(label, predicted)).select(F.inline(F.array(
        cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with the three summary rows."""
    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    counts = df.agg(*_cells(label, predicted))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    counts = counts.withColumns({
        "p0": ratio(tn, tn + fn), "r0": ratio(tn, tn + fp), "p1": ratio(tp, tp + fp), "r1": ratio(tp, tp + fn),
        "s0": tn + fp, "s1": tp + fn, "acc": ratio(tn + tp, tn + fp + fn + tp)})
    counts = counts.withColumns({
        f"f{i}": ratio(F.lit(2.0) * F.col(f"p{i}") * F.col(f"r{i}"), F.col(f"p{i}") + F.col(f"r{i}")) for i in (0, 1)})
    n = F.col("s0") + F.col("s1")

    def weighted(name: str) -> Column:
        return ratio(F.col(f"{name}0") * F.col("s0") + F.col(f"{name}1") * F.col("s1"), n)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    macro = [(F.col(f"{c}0") + F.col(f"{c}1")) / 2.0 for c in "prf"]
    blank = F.lit(None).cast("double")
    return counts.select(F.inline(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", blank, blank, F.col("acc"), n),
        row("macro avg", *macro, n),
        row("weighted avg", *[weighted(c) for c in "prf"], n))))


def leavers_caught(df: DataFrame, label: str, predicted: str) -> DataFrame:
    counts = df.agg(*_cells(label, predicted))
    actual = F.col("tp") + F.col("fn")
    return counts.select(F.col("tp").alias("caught"), actual.alias("left"), pct(F.col("tp"), actual, 0).alias("caught_pct"))
