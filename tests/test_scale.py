"""Work that must not grow faster than the table."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from rosterlens.functions import fixed_values as fv
from rosterlens.operators import chartdata, explain, metrics, models, prep, scoring
from rosterlens.plans import attrition
from rosterlens.sources.hr_fixture import hr_raw_sql
from rosterlens.streaming.scoring import profile_stream, write_profiles


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _explained(spark, rows):
    return spark.createDataFrame(rows, "id long, contributions array<struct<feature:string,value:double,shap:double>>")


def test_the_waterfall_sorts_a_row_once(spark, tmp_path):
    rows = [(1, [("a", 1.0, 0.25), ("b", 2.0, -0.5), ("c", 3.0, 0.125)]), (2, [("a", 1.0, 0.0), ("b", None, 0.0), ("c", 3.0, -1.0)])]
    _explained(spark, rows).write.parquet(str(tmp_path / "explained"))
    steps = explain.waterfall(spark.read.parquet(str(tmp_path / "explained")), 0.5, "id", max_display=2)
    assert _plan(steps).count("sort_array(") + _plan(steps).count("array_sort(") == 1
    found = [tuple(r) for r in steps.where("id = 1").orderBy("step").collect()]
    assert found == [(1, 1, "2 other features", None, 0.375, 0.5, 0.875), (1, 2, "b", 2.0, -0.5, 0.875, 0.375)]
    assert [r["label"] for r in steps.where("id = 2").orderBy("step").collect()] == ["2 other features", "c"]


def test_only_rows_up_to_a_bound_are_ranked_for_a_sample(spark):
    rows = [(i % 900 if i % 7 else None, "f", 1 if i % 3 else 2, 1) for i in range(2000)] + [(5, "g", None, 1)] * 4
    cells = spark.createDataFrame(rows, "id long, feature string, x_bin int, y_bin int")
    sampled = chartdata.sample(cells, "id", ["feature"], per_cell=3, seed=7, few_groups=True)
    assert "_bound" in _plan(sampled).partition("Window ")[2]
    wanted = []
    for cell in {r[1:] for r in rows}:
        ids = [r[0] for r in rows if r[1:] == cell]
        ids.sort(key=lambda i: ("", 0) if i is None else (hashlib.md5(f"{i}:7".encode()).hexdigest(), i))
        wanted += [(i, *cell, len(ids), len(ids) / min(len(ids), 3)) for i in ids[:3]]
    assert sorted(map(tuple, sampled.collect()), key=str) == sorted(wanted, key=str)


def test_a_sample_without_few_groups_is_the_same(spark):
    cells = spark.range(3000).select("id", (F.col("id") % 5).alias("feature"), F.lit(1).alias("x_bin"), (F.col("id") % 2).alias("y_bin"))
    one, other = (chartdata.sample(cells, "id", ["feature"], few_groups=few) for few in (True, False))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and one.count() == 30


def test_profiles_of_one_file_are_spread_over_tasks(spark):
    one_file = spark.range(200).withColumnRenamed("id", scoring.PROFILE_ID).coalesce(1)
    assert scoring.spread(one_file).rdd.getNumPartitions() == scoring.FEWEST_TASKS
    assert scoring.spread(one_file, task_rows=4).rdd.getNumPartitions() == 50
    assert scoring.spread(one_file).exceptAll(one_file).isEmpty()


def test_files_for_a_stream_grow_in_number_not_in_size(spark, tmp_path):
    profiles = spark.range(100).select(F.col("id").alias(scoring.PROFILE_ID), F.lit(30.0).alias("Age"))
    folder = str(tmp_path / "in")
    assert write_profiles(profiles, folder, file_rows=10) == 10
    assert write_profiles(profiles, folder) == 4
    files = sorted(p.name for p in (tmp_path / "in").glob("part-*"))
    assert len(files) == 14 and all(name.endswith(".gz") for name in files)
    assert spark.read.json(folder).groupBy(scoring.PROFILE_ID).count().where("count = 2").count() == 100
    assert profile_stream(spark, folder).isStreaming


def test_fit_partitions_follow_a_large_table(spark):
    assert models.partitions_for(spark.range(1000)) == models.FIT_PARTITIONS
    assert models.partitions_for(spark.range(54_000_000)) == 180
    assert models.partitions_for(spark.range(1001), fit_rows=10) == 101


def test_the_source_is_read_once_and_vectors_come_from_the_stored_rows(spark, tmp_path):
    orders = "(SELECT id * 3 AS o_orderkey, id * 97.5D AS o_totalprice FROM range(0, 400, 1, 1))"
    hr, reads = spark.sql(hr_raw_sql(orders)), spark.sparkContext.accumulator(0)

    def counted(row):
        reads.add(1)
        return row

    source = spark.createDataFrame(hr.rdd.map(counted), hr.schema)
    design, encoder = attrition.prepare(source, str(tmp_path), partitions=4)
    assert reads.value == 400
    stored = spark.read.parquet(str(tmp_path / "rows"))
    assert stored.columns == prep.model_frame(hr).columns and stored.exceptAll(prep.model_frame(hr)).isEmpty()
    wanted = {r[fv.ID]: r["features"] for r in prep.design_matrix(prep.model_frame(hr), encoder).collect()}
    assert {r[fv.ID]: r["features"] for r in design.collect()} == wanted and len(wanted) == 400
    assert design.columns == [*stored.columns, "features", "split"] and design.where("split = 'test'").count() == 80


def test_a_score_is_computed_once_for_the_curve(spark):
    slow = F.udf(lambda x: None if x % 10 == 9 else float(x % 3), "double", useArrow=False)
    scored = spark.range(40).select(slow("id").alias("score"), F.expr("if(id < 4, null, id % 2)").alias("label"))
    counts = metrics.score_counts(scored, "label", "score")
    assert _plan(counts.select("pos")).count("BatchEvalPython [") == 1
    kept = [(float(i % 3), i % 2) for i in range(4, 40) if i % 10 != 9]
    wanted = {(s, sum(k == (s, 1) for k in kept), sum(k == (s, 0) for k in kept)) for s, _ in kept}
    assert {tuple(r) for r in counts.collect()} == wanted and counts.columns == ["score", "pos", "neg"]
