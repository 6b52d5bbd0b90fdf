"""The batch training job: an employee table in, a saved model and its cross-validated AUC out.

    spark-submit rosterlens/plans/train_job.py INPUT [INPUT ...] FOLDER
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import models
from rosterlens.plans import attrition
from rosterlens.sources.artifacts import RiskModel
from rosterlens.sources.tables import hr_schema, read_first_available


def train_on_all(hr: DataFrame, path: str, seed: int = fv.SEED, folds: int = fv.FOLDS, **forest) -> tuple[RiskModel, DataFrame]:
    """Fit on all rows, save, and cross-validate on the same rows: (model, one row with mean and deviation of the AUC).

    The AUC is also stored as ``cv_auc`` beside the model.
    """
    model = attrition.train_risk_model(hr, path, scope="all", seed=seed, **forest)
    auc = models.cv_auc(attrition.design_of(model), k=folds, seed=seed, **forest)
    auc.coalesce(1).write.mode("overwrite").parquet(f"{model.path}/cv_auc")  # one row
    return model, hr.sparkSession.read.parquet(f"{model.path}/cv_auc")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("inputs", nargs="+", help="places of the employee table, the first that exists is read")
    parser.add_argument("folder", help="where the model is saved")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("rosterlens-train").getOrCreate()
    _, auc = train_on_all(read_first_available(spark, given.inputs, hr_schema()), given.folder)
    row = auc.first()
    print(f"cross-validated AUC {row['auc_mean']:.4f} (deviation {row['auc_std']:.4f}), model in {given.folder}")


if __name__ == "__main__":
    main()
