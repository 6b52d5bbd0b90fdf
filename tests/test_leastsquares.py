"""Triangles of tall tables, redundant columns and the logit fit."""

import math

import numpy as np
import pytest

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import inference, leastsquares

FLAG = fv.FLAG


def table(spark, columns, parts=5):
    names = list(columns)
    rows = [tuple(float(v) for v in row) for row in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_the_triangle_has_the_lengths_and_angles_of_the_table(spark, parts):
    x = np.random.default_rng(1).normal(size=(200, 4))
    df = table(spark, {f"c{i}": x[:, i] for i in range(4)}, parts)  # more parts than rows leave some empty
    r, total = leastsquares.triangle(df, df.columns, 4, lambda rows: (rows, float(len(rows))))
    assert np.allclose(r.T @ r, x.T @ x, atol=1e-9) and np.allclose(r, np.triu(r)) and total == 200


def test_near_copies_stay_and_exact_functions_go(spark):
    rng = np.random.default_rng(2)
    a, b, noise = rng.normal(size=(3, 400))
    columns = {"a": a, "b": 1e6 + b, "near": a + 1e-7 * noise, "exact": 3 * a - 2 * (1e6 + b) + 7, "tenth": np.full(400, 0.1),
               "far": 1e9 + 0.25 * np.round(8 * b), "far_copy": 5e8 + 0.125 * np.round(8 * b)}
    assert inference.aliased_columns(table(spark, columns), list(columns)) == ["exact", "tenth", "far_copy"]
    shuffled = ["far_copy", "exact", "tenth", "near", "a", "far", "b"]  # the earlier column stays
    assert inference.aliased_columns(table(spark, columns), shuffled) == ["tenth", "far", "b"]


def test_a_redundant_column_does_not_hide_a_later_one(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 100))
    columns = {"a": a, "b": b, "sum": a + b, "c": c, "copy": a, "all": a + b + c}
    assert inference.aliased_columns(table(spark, columns), list(columns)) == ["sum", "copy", "all"]


def newton(x, y, steps=60):
    q, r = np.linalg.qr(x)  # an orthonormal basis keeps the plain Newton steps exact for nearly collinear columns
    gamma = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-q @ gamma))
        information = q.T @ (q * (p * (1 - p))[:, None])
        gamma = gamma + np.linalg.solve(information, q.T @ (y - p))
    back = np.linalg.inv(r)
    return back @ gamma, np.sqrt(np.diag(back @ np.linalg.inv(information) @ back.T))


def test_a_nearly_collinear_logit_equals_newton_steps(spark):
    rng = np.random.default_rng(5)
    a, noise, c = rng.normal(size=(3, 800))
    near = a + 1e-5 * noise
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + a - 0.2 * c)))).astype(float)
    df = table(spark, {FLAG: y, "a": a, "near": near, "c": 4000 + 900 * c})
    found = {r["feature"]: r for r in inference.logit_inference(df, ["a", "near", "c"]).collect()}
    beta, errors = newton(np.column_stack([np.ones(800), a, near, 4000 + 900 * c]), y)
    assert not any(r["aliased"] for r in found.values())
    for i, name in enumerate(["intercept", "a", "near", "c"]):
        assert found[name]["coef"] == pytest.approx(beta[i], rel=1e-6)
        assert found[name]["std_err"] == pytest.approx(errors[i], rel=1e-6)
        assert found[name]["pvalue"] == pytest.approx(math.erfc(abs(beta[i] / errors[i]) / math.sqrt(2)), rel=1e-6)


def test_a_rare_class_and_a_strong_effect_converge(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=3000) * 4
    y = (rng.random(3000) < 1 / (1 + np.exp(-(-9 + 2.5 * a)))).astype(float)
    found = {r["feature"]: r["coef"] for r in inference.logit_inference(table(spark, {FLAG: y, "a": a}), ["a"]).collect()}
    beta, _ = newton(np.column_stack([np.ones(3000), a]), y)
    assert (found["intercept"], found["a"]) == pytest.approx(tuple(beta), rel=1e-7)


def test_all_columns_redundant_leaves_the_intercept(spark):
    df = table(spark, {FLAG: [0, 1, 1, 1], "same": [2, 2, 2, 2]})
    first, second = inference.logit_inference(df, ["same"]).collect()
    assert first["coef"] == pytest.approx(math.log(3)) and second["aliased"] and second["coef"] is None


def test_what_cannot_be_fitted_raises(spark):
    with pytest.raises(ValueError, match="no rows"):
        inference.aliased_columns(spark.createDataFrame([], "a double"), ["a"])
    for bad in (None, float("nan"), float("inf")):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, bad)], "a double, b double")
        with pytest.raises(ValueError, match="in b"):
            inference.aliased_columns(df, ["a", "b"])
