"""Evaluation of a trained tree against SQL, and chart data of bounded size."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlens.operators import chartdata
from rosterlens.plans import checked, checked_oracle
from tests.compare import connect, difference
from tests.conftest import MEDIUM, SMALL


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(checked.QUERIES))
def test_matches_sql(spark, databases, name):
    assert difference(checked.QUERIES[name](spark, SMALL), databases[SMALL], checked_oracle.ORACLE[name]) is None


@pytest.mark.parametrize("name", ["stump_fold_aucs", "shap_sample", "line_price_density"])
def test_matches_sql_at_larger_scale(spark, databases, name):
    assert difference(checked.QUERIES[name](spark, MEDIUM), databases[MEDIUM], checked_oracle.ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(checked.QUERIES) == set(checked_oracle.ORACLE)


def test_cells(spark):
    rows = [("a", 0.0, 5.0), ("a", 1.0, 5.0), ("a", 4.0, 5.0), ("a", 2.0, None), ("a", float("nan"), 5.0), ("a", float("inf"), 5.0),
            ("b", 7.0, -1.0), ("b", 7.0, 1.0), (None, 1.0, 1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = sorted((tuple(r) for r in chartdata.with_cells(df, "x", "y", ["g"], 4).select("g", "x_bin", "y_bin").collect()), key=str)
    expected = [("a", 1, 1), ("a", 2, 1), ("a", 4, 1), ("a", 3, None), ("a", None, 1), ("a", None, 1), ("b", 1, 1), ("b", 1, 4),
                (None, None, None), ("c", None, None)]
    assert found == sorted(expected, key=str)
    assert chartdata.with_cells(df.limit(0), "x", "y", ["g"]).collect() == []
    assert chartdata.with_cells(df.limit(0), "x", "y").collect() == []


def test_the_output_does_not_grow_with_the_rows(spark):
    sizes = []
    for n in (20_000, 80_000):
        points = spark.range(n).select("id", (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 997).alias("y"))
        cells = chartdata.with_cells(points, "x", "y", bins=10)
        sizes.append((chartdata.density(cells).count(), chartdata.sample(cells, "id", per_cell=4).count()))
    assert sizes[0] == sizes[1] == (100, 400)


@pytest.mark.parametrize("parts", [1, 9])
def test_a_sample_is_the_first_by_hash_and_its_weights_count_every_row(spark, parts):
    import hashlib

    rng = random.Random(3)
    rows = [(i, rng.choice([1.0, 1.0, 1.0, 4.0, 9.0, None]), rng.choice([0.0, 3.0])) for i in range(600)]  # half the rows in two cells
    cells = chartdata.with_cells(spark.createDataFrame(rows, "id long, x double, y double").repartition(parts), "x", "y", bins=5)
    found = chartdata.sample(cells, "id", per_cell=3, seed=11).collect()
    kept = {}
    for i, x, y in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:11".encode()).hexdigest()):
        kept.setdefault((x, y), []).append(i)
    assert sorted(r["id"] for r in found) == sorted(i for ids in kept.values() for i in ids[:3])
    assert sum(r["weight"] for r in found) == pytest.approx(600)
    assert all(r["n"] == len(kept[r["x"], r["y"]]) for r in found)


def test_every_partition_limits_a_cell_before_the_shuffle(spark):
    points = spark.range(10).select("id", F.col("id").alias("x"), F.col("id").alias("y"))
    plan = chartdata.sample(chartdata.with_cells(points, "x", "y"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
