"""Versions of a saved model."""

import threading

import pytest
from pyspark.sql import functions as F

from rosterlens.operators import models, prep
from rosterlens.sources import artifacts
from rosterlens.sources.tables import path_exists


@pytest.fixture(scope="module")
def parts(hr):
    frame = prep.model_frame(hr)
    encoder = prep.feature_pipeline(["OverTime"]).fit(frame)
    return encoder, models.fit_forest(prep.design_matrix(frame, encoder), trees=1, depth=1, bootstrap=False)


def write(spark, path, parts, number):
    """A version whose feature order and defaults both carry the number."""
    folder = artifacts.new_version(path)
    defaults = spark.range(1).select(F.lit(f"v{number}").alias("feature"), F.lit(float(number)).alias("num_value"), F.lit(None).cast("string").alias("cat_value"))
    artifacts.save_artifacts(folder, *parts, (f"v{number}",), defaults)
    return folder


def number_of(model):
    row = model.defaults.first()
    assert model.features == (row["feature"],) == (f"v{int(row['num_value'])}",)  # both of one version
    return int(row["num_value"])


def test_readers_meet_whole_versions_while_others_are_written(spark, parts, tmp_path):
    path = str(tmp_path / "model")
    artifacts.publish(spark, path, write(spark, path, parts, 0))
    failed = []

    def writer():
        try:
            for i in (1, 2, 3):
                artifacts.publish(spark, path, write(spark, path, parts, i))
        except Exception as error:  # noqa: BLE001  shown by the assertion below
            failed.append(error)

    thread, seen = threading.Thread(target=writer), []
    thread.start()
    while thread.is_alive():
        seen.append(number_of(artifacts.load_artifacts(spark, path)))
    thread.join()
    seen.append(number_of(artifacts.load_artifacts(spark, path)))
    assert not failed and seen == sorted(seen) and seen[-1] == 3


def test_an_unfinished_version_changes_nothing(spark, parts, tmp_path):
    path = str(tmp_path / "model")
    assert not artifacts.is_complete(spark, path) and artifacts.versions(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifacts(spark, path)
    artifacts.publish(spark, path, write(spark, path, parts, 1))
    half = artifacts.new_version(path)
    parts[1].write().save(f"{half}/forest")  # the writer stops here
    with pytest.raises(ValueError, match="not a complete model"):
        artifacts.publish(spark, path, half)
    assert number_of(artifacts.load_artifacts(spark, path)) == 1
    assert sorted((r["complete"], r["current"]) for r in artifacts.versions(spark, path).collect()) == [(False, False), (True, True)]


def test_old_versions_stay_readable_and_can_come_back(spark, parts, tmp_path):
    path = str(tmp_path / "model")
    folders = [write(spark, path, parts, i) for i in range(3)]
    for folder in folders:
        artifacts.publish(spark, path, folder)
    names = [f.rsplit("/", 1)[1] for f in folders]
    assert [number_of(artifacts.load_artifacts(spark, path, n)) for n in names] == [0, 1, 2]
    assert number_of(artifacts.load_artifacts(spark, folders[1])) == 1  # a version's own folder
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifacts(spark, path, "missing")
    artifacts.publish(spark, path, folders[0])
    assert artifacts.current_version(spark, path) == folders[0]
    held = artifacts.load_artifacts(spark, path)

    assert artifacts.remove_versions(spark, path, keep=2) == [names[1]]  # 0 and 2 were published last
    assert not path_exists(spark, folders[1]) and number_of(held) == 0
    assert artifacts.remove_versions(spark, path, keep=0) == [names[2]]  # the published one always stays
    assert number_of(artifacts.load_artifacts(spark, path)) == 0


def test_writers_at_the_same_time_lose_no_version(spark, parts, tmp_path):
    path = str(tmp_path / "model")
    folders = sorted(write(spark, path, parts, i) for i in range(2))
    for folder in folders:  # both saw an empty folder and took number 0
        files, target = artifacts._files(spark, f"{path}/current/{0:010d}-{folder.rsplit('/', 1)[1]}")
        files.create(target, False).close()
    assert artifacts.current_version(spark, path) == folders[1]
    artifacts.publish(spark, path, folders[0])
    assert artifacts.current_version(spark, path) == folders[0]
    assert artifacts.versions(spark, path).where("complete").count() == 2
