"""Training, scoring, inference and explanations on a small forest."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import explain, inference, metrics, models, prep, risk, scoring
from rosterlens.plans import attrition
from rosterlens.sources.artifacts import discard_artifacts, is_complete, load_artifacts, load_or_fit
from rosterlens.sources.tables import shared_dir
from rosterlens.streaming.scoring import profile_stream, start_scoring


@pytest.fixture(scope="module")
def model(spark, hr):
    path = f"{shared_dir(spark)}/small-model"
    return attrition.train_risk_model(hr, path, scope="train", trees=12, depth=6)


@pytest.fixture(scope="module")
def design(model):
    return attrition.design_of(model)


# --- forest ---------------------------------------------------------------------

def test_holdout_auc_is_well_above_chance(model, design):
    holdout = attrition.risk_frame(model, design, "holdout")
    assert holdout.count() == 300
    assert metrics.roc_auc(holdout, risk.ACTUAL, risk.SCORE).first()["auc"] > 0.7


def test_prediction_is_the_likelier_class(model, design):
    scored = models.score(model.forest, design)
    assert scored.where(F.col("predicted") != F.when(F.col("score") > 0.5, 1).otherwise(0)).where("score <> 0.5").count() == 0
    assert scored.where("score < 0 OR score > 1").count() == 0


def test_trees_split_codes_as_ordered_numbers(spark, model):
    assert explain.node_table(spark, model.forest_path).where("left >= 0 AND categories >= 0").count() == 0


def test_importances_sum_to_one(spark, model):
    table = models.feature_importance(model.forest, spark, k=32)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert models.feature_importance(model.forest, spark).count() == 15


def test_balanced_weights_equalise_the_classes(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], f"{fv.FLAG} int")
    sums = {r[0]: r[1] for r in prep.balanced_weights(df).groupBy(fv.FLAG).agg(F.sum("weight")).collect()}
    assert sums == {0: pytest.approx(5), 1: pytest.approx(5)}


def test_cross_validation(design):
    folds = models.fold_aucs(design.where("split = 'train'"), k=3, trees=8, depth=4)
    aucs = [r["auc"] for r in folds.collect()]
    assert len(aucs) == 3 and min(aucs) > 0.6


# --- encoding ---------------------------------------------------------------------

def test_unseen_category_raises(spark, hr):
    encoder = prep.fit_encoder(hr)
    assert prep.encode_value(encoder, "OverTime", "Yes") == 1
    with pytest.raises(ValueError, match="unseen value 'Maybe'"):
        prep.encode_value(encoder, "OverTime", "Maybe")
    with pytest.raises(Exception, match="[Uu]nseen"):
        prep.label_encode(hr.withColumn("OverTime", F.lit("Maybe")), encoder=encoder).agg(F.sum("OverTime")).collect()


def test_missing_category_is_its_own_text(spark):
    df = spark.createDataFrame([("b",), (None,), ("z",)], "c string")
    coded = prep.label_encode(df, ["c"])
    assert sorted(r["c"] for r in coded.collect()) == [0, 1, 2]
    assert prep.fit_encoder(df, ["c"]).labelsArray[0] == ["b", "nan", "z"]


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in prep.standard_scale(df, df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_defaults_take_even_medians_and_the_smallest_mode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (5, "b"), (9, "a")], "n long, c string")
    rows = {r["feature"]: r for r in prep.default_values(df, ["n"], ["c"], ["d"]).collect()}
    assert rows["n"]["num_value"] == 3.5 and rows["c"]["cat_value"] == "a"
    assert rows["d"]["num_value"] is None and rows["d"]["cat_value"] is None


# --- inference ----------------------------------------------------------------------

def test_logit_agrees_with_newton_steps_and_reports_aliases(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500), rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.4 + 0.8 * a - 0.5 * b)))).astype(int)
    rows = [(int(t), float(u), float(v), float(u - v), 3.0) for t, u, v in zip(y, a, b)]
    df = spark.createDataFrame(rows, f"{fv.FLAG} int, a double, b double, gap double, same double")
    found = {r["feature"]: r for r in inference.logit_inference(df, ["a", "b", "gap", "same"]).collect()}
    assert [f for f, r in found.items() if r["aliased"]] == ["gap", "same"]
    assert found["gap"]["pvalue"] is None

    x, beta = np.column_stack([np.ones(500), a, b]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    for i, name in enumerate(["intercept", "a", "b"]):
        assert found[name]["coef"] == pytest.approx(beta[i], abs=1e-6)
        assert found[name]["std_err"] == pytest.approx(errors[i], rel=1e-4)
        z = beta[i] / errors[i]
        assert found[name]["pvalue"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-3, abs=1e-12)
        assert found[name]["ci_upper"] == pytest.approx(beta[i] + 1.959964 * errors[i], rel=1e-4)


def test_the_engineered_columns_are_the_aliased_ones(model, design):
    coded = prep.label_encode(design.drop("features", "split"))
    assert inference.aliased_columns(coded, fv.FEATURES) == ["satisfaction_composite", "manager_tenure_gap"]


# --- explanations ----------------------------------------------------------------------

def brute_force(leaves, x):
    """Shapley values of the path-dependent game of one tree, by subsets."""
    used = sorted({int(f) for leaf in leaves for f in leaf[1]})

    def worth(known):
        total = 0.0
        for value, names, low, high, z in leaves:
            weight = value
            for f, lo, hi, share in zip(names, low, high, z):
                weight *= float(lo < x[f] <= hi) if f in known else share
            total += weight
        return total

    phi, m = np.zeros(len(x)), len(used)
    for f in used:
        others = [g for g in used if g != f]
        for size in range(m):
            for subset in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[f] += weight * (worth({*subset, f}) - worth(set(subset)))
    return phi


def test_contributions_equal_brute_force_shapley_values():
    leaf = lambda value, conditions: (value, np.array(sorted(conditions)), *(
        np.array([conditions[f][i] for f in sorted(conditions)]) for i in range(3)))
    inf = np.inf
    tree = [
        leaf(0.9, {0: (-inf, 1.0, 0.3), 2: (-inf, 5.0, 0.5)}),
        leaf(0.1, {0: (-inf, 1.0, 0.3), 2: (5.0, inf, 0.5)}),
        leaf(0.4, {0: (1.0, inf, 0.7), 1: (-inf, 0.0, 0.2), 3: (-inf, 2.0, 0.6)}),
        leaf(0.7, {0: (1.0, inf, 0.7), 1: (-inf, 0.0, 0.2), 3: (2.0, inf, 0.4)}),
        leaf(0.2, {0: (1.0, 4.0, 0.7 * 0.45), 1: (0.0, inf, 0.8)}),
        leaf(0.6, {0: (4.0, inf, 0.7 * 0.55), 1: (0.0, inf, 0.8)}),
    ]
    x = np.array([[a, b, c, d] for a in (0.5, 1.0, 2.0, 9.0) for b in (-1.0, 0.0, 1.0)
                  for c in (5.0, 6.0) for d in (2.0, 3.0)])
    expected = np.array([brute_force(tree, row) for row in x])
    assert np.abs(explain.shap_matrix([explain.prepared(tree)], x) - expected).max() < 1e-14


def random_leaves(rng, depth, features, low=(), high=(), share=()):
    """Leaves of a tree whose paths may ask a feature several times."""
    low, high, share = dict(low), dict(high), dict(share)
    if depth == 0 or share and rng.random() < 0.1:
        names = sorted(share)
        return [(rng.random(), np.array(names, dtype=np.int64), *(np.array([d.get(f, default) for f in names], dtype=float) for d, default in (
            (low, -np.inf), (high, np.inf), (share, 1.0))))]
    f = int(rng.integers(features))
    t, z = rng.uniform(low.get(f, 0.0), high.get(f, 1.0)), rng.uniform(0.2, 0.8)
    return (random_leaves(rng, depth - 1, features, low, {**high, f: t}, {**share, f: share.get(f, 1.0) * z})
            + random_leaves(rng, depth - 1, features, {**low, f: t}, high, {**share, f: share.get(f, 1.0) * (1 - z)}))


@pytest.mark.parametrize("depth", [0, 3, 5, 8, 12])
def test_neighbouring_leaves_are_looked_up_together(depth):
    rng = np.random.default_rng(depth)
    tree, x = random_leaves(rng, depth, 6), rng.random((300, 6))
    x[0], x[1] = np.nan, tree[0][3][0] if depth else 0.5  # a row on a threshold
    filled = np.nan_to_num(x, nan=np.inf)
    some = np.r_[0:12]
    expected = np.array([brute_force(tree, row) for row in filled[some]]) if depth <= 5 else None
    slices = explain.prepared(tree)
    alone = explain._slices([leaf for leaf in tree if len(leaf[1])])
    found = explain.shap_matrix([slices], x)
    assert np.abs(found - explain.shap_matrix([alone], x)).max() < 1e-13  # as leaf by leaf
    assert expected is None or np.abs(found[some] - expected).max() < 1e-13
    assert depth != 8 or len(slices) < len(tree) / 3  # a third of the look-ups at most


def test_explanations_of_one_file_are_many_tasks(model, design, tmp_path):
    stored = attrition.store_explanations(model, design.coalesce(1), str(tmp_path / "explained"))
    assert stored.count() == 1500 and len(list((tmp_path / "explained").glob("part-*"))) == 32


def test_groups_of_trees_add_up(model, design):
    few = design.limit(50)
    one = {r[fv.ID]: [c["shap"] for c in r["contributions"]] for r in explain.explain_forest(few, model.forest_path).collect()}
    many = explain.explain_forest(few, model.forest_path, group_nodes=300)
    assert len(explain.tree_groups(explain.node_table(few.sparkSession, model.forest_path), 300)) > 1
    for r in many.collect():
        assert np.abs(np.array([c["shap"] for c in r["contributions"]]) - one[r[fv.ID]]).max() < 1e-12


def test_a_forest_does_not_depend_on_the_partitions_of_its_input(design):
    scores = []
    for parts in (2, 8):
        forest = models.fit_forest(design.repartition(parts), trees=5, depth=4)
        scores.append({r[fv.ID]: r["score"] for r in models.score(forest, design).collect()})
    assert scores[0] == scores[1]


def test_trees_fitted_in_groups_are_one_forest(spark, design, tmp_path):
    train = design.where("split = 'train'")
    forest = models.fit_forest(train, trees=5, depth=3, tree_groups=2)
    first = models.fit_forest(train, trees=3, depth=3, tree_groups=1)
    assert forest.getNumTrees == 5 and forest.numFeatures == first.numFeatures and forest.numClasses == 2
    shapes = [tree.toDebugString.split("\n", 1)[1] for tree in forest.trees]
    assert shapes[:3] == [tree.toDebugString.split("\n", 1)[1] for tree in first.trees] and len(set(shapes)) == 5
    path = str(tmp_path / "forest")
    forest.save(path)
    loaded = type(forest).load(path)
    score = lambda one: models.score(one, design, predicted="p").select(fv.ID, "score", "p").orderBy(fv.ID).collect()
    assert score(loaded) == score(forest) and loaded.getNumTrees == 5
    assert loaded.getOrDefault("numTrees") == forest.getOrDefault("numTrees") == 5
    explained = explain.explain_forest(design, path, features=fv.FEATURES, carry=[])
    base = explain.base_value(explain.node_table(spark, path)).first()[0]
    total = {r[0]: base + sum(c["shap"] for c in r["contributions"]) for r in explained.collect()}
    assert all(abs(total[i] - p) < 1e-9 for i, p, _ in score(forest))


def test_groups_of_trees_follow_the_rows_beyond_one_group(spark):
    rows = spark.range(1000)
    assert models.tree_groups_for(rows, 300) == models.tree_groups_for(rows, 30, room=30_000) == 1
    assert (models.tree_groups_for(rows, 31, room=30_000), models.tree_groups_for(rows, 300, room=30_000)) == (3, 20)
    assert (models.tree_groups_for(rows, 2, room=10), models.tree_groups_for(rows, 1, room=10)) == (2, 1)


def test_a_model_being_replaced_does_not_load(spark, model, tmp_path):
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(model.path, copy)
    assert is_complete(spark, copy)
    discard_artifacts(spark, copy)
    assert not is_complete(spark, copy)


def test_base_plus_contributions_is_the_prediction_for_every_row(spark, model, design):
    base = explain.base_value(explain.node_table(spark, model.forest_path)).first()[0]
    assert base == pytest.approx(0.5, abs=0.05)  # balanced classes, not the attrition rate
    explained = explain.explain_forest(design, model.forest_path, carry=[fv.FLAG])
    total = F.aggregate("contributions", F.lit(base), lambda acc, c: acc + c["shap"])
    both = models.score(model.forest, design).join(explained.select(fv.ID, total.alias("total")), fv.ID)
    assert both.count() == 1500
    assert both.agg(F.max(F.abs(F.col("total") - F.col("score")))).first()[0] < 1e-12
    assert explain.to_long(explained).count() == 1500 * 32


def test_waterfall_ends_at_the_prediction(spark, model, design):
    nodes = explain.node_table(spark, model.forest_path)
    few = design.limit(20)
    steps = explain.waterfall(explain.explain_forest(few, model.forest_path), explain.base_value(nodes))
    last = {r[fv.ID]: r["end"] for r in steps.where("step = 12").collect()}
    for r in models.score(model.forest, few).collect():
        assert last[r[fv.ID]] == pytest.approx(r["score"], abs=1e-12)
    assert {r["label"] for r in steps.where("step = 1").collect()} == {"21 other features"}


def test_waterfall_without_a_rest(spark):
    df = spark.sql("SELECT 1L AS EmployeeNumber, array(named_struct('feature','a','value',1.0D,'shap',0.2D), "
                   "named_struct('feature','b','value',2.0D,'shap',-0.3D)) AS contributions")
    steps = explain.waterfall(df, 0.5).orderBy("step").collect()
    assert [(r["label"], r["shap"]) for r in steps] == [("a", 0.2), ("b", -0.3)]
    assert steps[-1]["end"] == pytest.approx(0.4)


# --- artifacts, profiles, streams --------------------------------------------------------

def test_saved_model_scores_the_same(spark, model, design):
    again = load_artifacts(spark, model.path)
    assert again.features == fv.FEATURES
    before = {r[fv.ID]: r["score"] for r in models.score(model.forest, design).collect()}
    after = {r[fv.ID]: r["score"] for r in models.score(again.forest, design).collect()}
    assert before == after


def test_load_or_fit_trains_only_once(spark, model):
    def refuse(path):
        raise AssertionError("must not train")

    assert load_or_fit(spark, model.path, refuse).path == model.path
    with pytest.raises(AssertionError, match="must not train"):
        load_or_fit(spark, model.path + "-missing", refuse)


@pytest.fixture(scope="module")
def profiles(spark, hr):
    return hr.where("EmployeeNumber < 40").select(
        F.col(fv.ID).alias("profile_id"), *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES).withColumn("Age", F.lit(None).cast("long"))


def test_profiles_take_defaults(model, profiles):
    defaults = {r["feature"]: r["num_value"] for r in model.defaults.collect()}
    filled = scoring.fill_profile(profiles, model.defaults)
    assert {r["Age"] for r in filled.collect()} == {defaults["Age"]}
    assert {r["DailyRate"] for r in filled.collect()} == {defaults["DailyRate"]}
    own = scoring.fill_profile(profiles, model.defaults, always_default=())
    assert len({r["DailyRate"] for r in own.collect()}) > 1


def test_profile_scores_follow_the_training_rules(model, design, profiles):
    full = scoring.score_profiles(model, profiles.drop("Age").join(
        design.select(F.col(fv.ID).alias("profile_id"), "Age"), "profile_id"), always_default=())
    expected = {r[fv.ID]: r["score"] for r in models.score(model.forest, design).collect()}
    for r in full.collect():
        assert r["probability"] == pytest.approx(expected[r["profile_id"]], abs=1e-12)
        assert r["risk_tier"] == ("HIGH RISK" if r["probability"] >= 0.55 else "MEDIUM RISK" if r["probability"] >= 0.30 else "LOW RISK")
        assert r["verdict"] == ("likely to leave" if r["probability"] >= 0.5 else "likely to stay")


def test_profile_factors(model, profiles):
    factors = scoring.explain_profiles(model, scoring.score_profiles(model, profiles))
    assert factors.count() == 6 * profiles.count()
    assert factors.where("rank = 1 AND abs(shap) < 0.0001").count() == 0


def test_stream_scores_like_a_batch(spark, model, profiles, tmp_path):
    incoming, target = str(tmp_path / "in"), str(tmp_path / "out")
    profiles.repartition(3).write.json(incoming)
    start_scoring(model, profile_stream(spark, incoming), target, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    batch = {r["profile_id"]: r["probability"] for r in scoring.score_profiles(model, profiles).collect()}
    streamed = {r["profile_id"]: r["probability"] for r in spark.read.parquet(target).collect()}
    assert streamed == batch
    profiles.withColumn("profile_id", F.col("profile_id") + 1000).limit(2).write.mode("append").json(incoming)
    start_scoring(model, profile_stream(spark, incoming), target, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(target).count() == len(batch) + 2


def test_training_job_on_all_rows(spark, hr, tmp_path):
    from rosterlens.plans.train_job import train_on_all

    folder = str(tmp_path / "job")
    trained, auc = train_on_all(hr, folder, folds=2, trees=4, depth=3)
    assert is_complete(spark, folder) and trained.forest.getNumTrees == 4
    assert auc.count() == 1 and 0.5 < auc.first()["auc_mean"] <= 1
    frame = attrition.risk_frame(trained, attrition.design_of(trained))
    assert frame.count() == hr.count()
