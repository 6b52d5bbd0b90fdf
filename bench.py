"""Time the headline queries; prints one JSON line.

Every query is planned and fully materialised ``BENCH_RUNS`` times (default 3)
after one warm-up report, and the median counts.  Model training and the
explanation of every row are timed once.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import tempfile
import time

from rosterlens.operators import explain
from rosterlens.plans import attrition
from rosterlens.plans.catalog import QUERIES
from rosterlens.session import local_session
from rosterlens.sources.hr_fixture import hr_raw

HEADLINE = [
    "workforce_snapshot", "rate_by_department", "rate_by_role", "income_quartiles", "segment_role_department",
    "triple_risk_outcome", "all_segment_reports", "feature_table", "default_values", "stratified_split", "roc_auc",
    "roc_curve", "shap_importance", "risk_summary",
]


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(cores, "rosterlens-bench", spark__checkpoint__dir=folder)
    spark.sparkContext.setLogLevel("ERROR")

    materialise(QUERIES["rate_by_tenure"](spark, sf_dir))
    seconds = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        samples = [timed(lambda: materialise(QUERIES[name](spark, sf_dir))) for _ in range(runs)]
        seconds[name] = round(statistics.median(samples), 3)

    if os.environ.get("BENCH_MODEL", "1") == "1":
        hr, state = hr_raw(spark, sf_dir), {}
        seconds["train_and_save_300_trees"] = round(timed(lambda: state.update(
            model=attrition.train_risk_model(hr, f"{folder}/model", scope="train"))), 3)
        model = state["model"]
        design = attrition.design_of(model)
        seconds["score_all"] = round(timed(lambda: materialise(attrition.risk_frame(model, design))), 3)
        seconds["explain_holdout"] = round(timed(lambda: materialise(explain.explain_forest(
            design.where("split = 'test'"), model.forest_path))), 3)

    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
