"""The whole analysis in order: prepare, train, score, explain, summarise."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import explain, models, prep, risk, scoring
from rosterlens.sources.artifacts import RiskModel, new_version, publish, save_artifacts
from rosterlens.sources.tables import create_or_replace, settle

READABLE = ("Department", "JobRole", "OverTime")


def prepare(hr: DataFrame, path: str, seed: int = fv.SEED, partitions: int | None = None) -> tuple[DataFrame, PipelineModel]:
    """Store one design table that training, evaluation and scoring all read.

    (id, flag, raw features, split, vector).  The source is read once, to store
    the rows; in its own splits, often few, only their columns are derived.  The
    encoder is fitted and vectors and split are made from the stored rows, in
    as many tasks as these were spread over, so lost executors only cost a re-read.
    """
    frame = prep.model_frame(hr).repartition(partitions or models.partitions_for(hr), fv.ID)
    rows = create_or_replace(frame, f"{path}/rows")
    encoder = prep.feature_pipeline().fit(rows)
    design = prep.stratified_split(prep.design_matrix(rows, encoder), seed=seed)
    return create_or_replace(design, f"{path}/design"), encoder


def train_risk_model(hr: DataFrame, path: str, scope: str = "all", seed: int = fv.SEED,
                     fit_partitions: int | None = None, **forest) -> RiskModel:
    """Train on all rows or, with ``scope='train'``, on the 80 percent split, and publish a new version under ``path``.

    Rows, design and artifacts go into the version's own folder, which is
    published last: until then, and after a crash on the way, readers get the
    version before.  The default values do not depend on the forest, so their
    jobs run beside it.
    """
    folder = new_version(path)
    fit_partitions = fit_partitions or models.partitions_for(hr)
    with ThreadPoolExecutor(1) as pool:
        defaults = pool.submit(lambda: settle(prep.default_values(prep.model_frame(hr))))
        design, encoder = prepare(hr, folder, seed, fit_partitions)
        rows = design if scope == "all" else design.where(F.col("split") == "train")
        fitted = models.fit_forest(rows, seed=seed, fit_partitions=fit_partitions, **forest)
        model = save_artifacts(folder, encoder, fitted, fv.FEATURES, defaults.result())
    publish(hr.sparkSession, path, folder)
    return model


def design_of(model: RiskModel) -> DataFrame:
    """The stored design table of a model trained by this package."""
    return model.defaults.sparkSession.read.parquet(f"{model.path}/design")


def risk_frame(model: RiskModel, design: DataFrame, scope: str = "all") -> DataFrame:
    """Every employee with probability, actual outcome and tier.

    Readable columns are carried through scoring, so no join brings them
    back.  ``scope='holdout'`` scores the test rows only; over all rows the
    tier rates are optimistic because they include the training rows.
    """
    rows = design if scope == "all" else design.where(F.col("split") == "test")
    scored = models.score(model.forest, rows, risk.SCORE, predicted="predicted")
    return risk.assign_tiers(scored.withColumnRenamed(fv.FLAG, risk.ACTUAL))


def store_explanations(model: RiskModel, design: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Explain every row of the design once and keep the result.

    The explanation reports read it several times; without storing it, each
    pass would compute all contributions again.  The rows are spread over tasks
    first, since a file of the design is one task's work however many rows it has.
    """
    explained = explain.explain_forest(scoring.spread(design), model.forest_path, features=model.features, carry=carry)
    return create_or_replace(explained, path)
