"""Ranks, quantiles and slices against brute force, with few and many buckets."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import prep
from rosterlens.operators.metrics import roc_auc, roc_curve
from rosterlens.operators.ranking import exact_quantiles, running_totals

BUCKETS = pytest.mark.parametrize("ranking", [{}, {"bucket_rows": 20}], ids=["few buckets", "many buckets"])


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups (one null); a third of the rows share one value."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.33 else round(rng.expovariate(0.1), 2))
            for _ in range(3000)] + [("a", None)] * 10
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5).cache()


@BUCKETS
def test_running_totals(skewed, ranking):
    rows, df = skewed
    counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in running_totals(counts, "v", ["n"], ["g"], **ranking).collect():
        same = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["total_n"] == len(same)
        assert r["cum_n"] == sum(v <= r["v"] for v in same)


@BUCKETS
def test_quantiles_agree_with_numpy(skewed, ranking):
    rows, df = skewed
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "top": 1.0}
    found = {r["g"]: r for r in exact_quantiles(df, "v", wanted, ["g"], moments=True, **ranking).collect()}
    assert set(found) == {"a", "b", None}
    for g, r in found.items():
        same = np.array([v for k, v in rows if k == g and v is not None])
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(same, p), abs=1e-12)
        assert (r["min"], r["max"]) == (same.min(), same.max())
        assert r["avg"] == pytest.approx(same.mean())


@BUCKETS
def test_quantiles_without_groups(skewed, ranking):
    rows, df = skewed
    same = np.array([v for _, v in rows if v is not None])
    assert exact_quantiles(df, "v", {"m": 0.5}, **ranking).first()["m"] == pytest.approx(np.median(same))


@BUCKETS
def test_auc_counts_pairs_and_ties_as_half(spark, ranking):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), 0.5 if rng.random() < 0.33 else round(rng.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc_auc(df, "y", "s", **ranking).first()["auc"] == pytest.approx(pairs, abs=1e-12)


def test_auc_without_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert roc_auc(df, "y", "s").first()["auc"] is None


@BUCKETS
@pytest.mark.parametrize("drop", [False, True])
def test_curve_points(spark, ranking, drop):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1 if i % 2 else 2)) for i in range(400)]
    cuts = sorted({s for _, s in rows}, reverse=True)
    tp = [sum(y for y, s in rows if s >= c) for c in cuts]
    fp = [sum(1 - y for y, s in rows if s >= c) for c in cuts]
    kept = range(len(cuts))
    if drop:
        kept = [i for i in kept if i in (0, len(cuts) - 1)
                or tp[i - 1] - 2 * tp[i] + tp[i + 1] != 0 or fp[i - 1] - 2 * fp[i] + fp[i + 1] != 0]
    expected = [(math.inf, 0.0, 0.0)] + [(cuts[i], fp[i] / fp[-1], tp[i] / tp[-1]) for i in kept]
    df = spark.createDataFrame(rows, "y int, s double")
    got = roc_curve(df, "y", "s", drop_collinear=drop, **ranking).orderBy(F.desc("threshold")).collect()
    assert [tuple(r) for r in got] == [tuple(map(lambda v: pytest.approx(v), row)) for row in expected]


def hash_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n0, n1", [(97, 13), (5, 5), (40, 1), (10, 0)])
def test_split_has_exact_class_shares_and_repeats(spark, n0, n1):
    rows = [(i, int(i >= n0)) for i in range(n0 + n1)]
    df = spark.createDataFrame(rows, "id long, y int")
    first = {r["id"]: r["split"] for r in prep.stratified_split(df, "y", "id", 0.2, 7).collect()}
    again = {r["id"]: r["split"] for r in prep.stratified_split(df.repartition(3), "y", "id", 0.2, 7).collect()}
    assert first == again and len(first) == n0 + n1
    test_rows = {c: [i for i, y in rows if y == c and first[i] == "test"] for c in (0, 1)}
    assert sum(map(len, test_rows.values())) == math.ceil(0.2 * (n0 + n1))
    for c, n in ((0, n0), (1, n1)):
        assert abs(len(test_rows[c]) - n * math.ceil(0.2 * (n0 + n1)) / (n0 + n1)) < 1
        assert sorted(test_rows[c]) == sorted(hash_order([i for i, y in rows if y == c], 7)[:len(test_rows[c])])


@pytest.mark.parametrize("k", [2, 5])
def test_folds_are_balanced(spark, k):
    rows = [(i, int(i % 7 == 0)) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, y int")
    folds = {r["id"]: r["fold"] for r in prep.stratified_folds(df, "y", "id", k, 3).collect()}
    assert set(folds.values()) == set(range(k))
    for c in (0, 1):
        sizes = [sum(1 for i, y in rows if y == c and folds[i] == f) for f in range(k)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(y == c for _, y in rows)
        order = hash_order([i for i, y in rows if y == c], 3)
        assert [folds[i] for i in order] == sorted(folds[i] for i in order)
    whole = [list(folds.values()).count(f) for f in range(k)]
    assert max(whole) - min(whole) <= 1


def test_rows_of_other_labels_get_no_slice(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 9)], "id long, y int")
    split = {r["id"]: r["split"] for r in prep.stratified_split(df, "y", "id", 0.5, 1).collect()}
    assert split[3] is None and split[4] is None and set(split) == {1, 2, 3, 4}
