"""The component store and the run catalogue."""

import os

import pytest
from pyspark.sql import functions as F

from levelcast.sources import runs, scans, store


def projection(spark, scenarios, value):
    return spark.createDataFrame([(s, i, 2000 + i % 2, value + i) for s in scenarios for i in range(4)], "scenario string, sample_id int, year int, value double")


def test_a_version_replaces_all_that_is_given_and_keeps_the_rest(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.versions(spark, root) == [] and store.components(spark, root).count() == 0
    post = spark.createDataFrame([(0, 1.5)], "draw int, a double")
    one = store.replace(spark, root, "ice", {"order": 2, "bad": float("nan"), "none": None}, post, post, projection(spark, ["low", "high"], 1.0))
    two = store.replace(spark, root, "ice", projections=projection(spark, ["high"], 100.0))
    assert (one, two) == (1, 2) == tuple(store.versions(spark, root))
    sums = lambda v=None: {r.scenario: r.s for r in store.load(spark, root, "ice", "projections", v).groupBy("scenario").agg(F.sum("value").alias("s")).collect()}
    assert sums() == {"low": 10.0, "high": 406.0} and sums(1) == {"low": 10.0, "high": 10.0}
    assert {(r.key, r.value) for r in store.metadata(spark, root).collect()} == {("order", "2")}
    assert {tuple(r) for r in store.components(spark, root).collect()} == {("ice", "posteriors", None), ("ice", "observations", None), ("ice", "projections", "low"), ("ice", "projections", "high")}
    assert store.load(spark, root, "ice", "posteriors").first().a == 1.5
    assert store.vacuum(spark, root) == 0 and store.versions(spark, root) == [2] and sums() == {"low": 10.0, "high": 406.0}
    with pytest.raises(KeyError):
        store.load(spark, root, "sea", "projections")
    with pytest.raises(ValueError):
        store.load(spark, root, "ice", "projections", 1)


def test_readers_see_nothing_of_a_write_that_failed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.replace(spark, root, "ice", {"order": 1}, projections=projection(spark, ["low"], 1.0))
    bad = projection(spark, ["low"], 2.0).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    post = spark.createDataFrame([(0, 9.0)], "draw int, a double")
    with pytest.raises(Exception, match="lost"):
        store.replace(spark, root, "ice", {"order": 7}, post, projections=bad)
    assert store.versions(spark, root) == [1] and store.metadata(spark, root).first().value == "1"
    assert store.load(spark, root, "ice", "projections").agg(F.sum("value")).first()[0] == 10.0
    # two writers that start from one version: the second changes nothing
    before = store._manifest(spark, root)
    store.replace(spark, root, "sea", projections=projection(spark, ["low"], 5.0))
    monkeypatch.setattr(store, "_manifest", lambda *a: before)
    with pytest.raises(RuntimeError):
        store.replace(spark, root, "ice", {"order": 8})
    monkeypatch.undo()
    assert {r.component for r in store.components(spark, root).collect()} == {"ice", "sea"}
    assert store.vacuum(spark, root) == 2  # the posteriors, and what was begun of the projections
    assert not [f for f in os.listdir(root) if f.startswith(".part") and not f.endswith(".crc")]


def test_components_without_scenarios_are_repeated(spark, tmp_path):
    root = str(tmp_path / "store")
    store.replace(spark, root, "a", {}, projections=projection(spark, ["x", "y", "z"], 0.0))
    store.replace(spark, root, "b", {"scenario_independent": True}, projections=projection(spark, ["x"], 7.0))
    got = {(r.component, r.scenario): r.s for r in store.projections(spark, root).groupBy("component", "scenario").agg(F.sum("value").alias("s")).collect()}
    assert got == {(c, s): v for c, v in (("a", 6.0), ("b", 34.0)) for s in "xyz"}


def test_runs_less_their_control(spark, tmp_path):
    rows = [("g", "m", "ctrl", t, 1.0 * t) for t in (0.0, 1.0, 2.0, 4.0)] + [("g", "m", "e1", t, 10.0 * t) for t in (0.0, 2.0, 3.0)] + [("g", "n", "e1", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "group string, model string, experiment string, time double, ivaf double")
    root = str(tmp_path / "runs")
    scans.write_cells(df, root, list(runs.KEYS), ["time"], {"ivaf": {}}, "{0}/{1}/{2}/computed_{2}")
    scans.put(f"{root}/g/m/e2/computed_e2.nc", [b"CDF\x01 and no more"])
    scans.put(f"{root}/g/m/e2/notes.txt", [b"not a run"])
    found = {(r.group, r.model, r.experiment): r.problem for r in runs.catalogue(spark, root).collect()}
    assert set(found) == {("g", "m", "ctrl"), ("g", "m", "e1"), ("g", "n", "e1"), ("g", "m", "e2")}
    assert found.pop(("g", "m", "e2")) and set(found.values()) == {None}
    less = runs.less_control(runs.cells(spark, root, ["time", "ivaf"]), "ivaf", "time", F.col("experiment") == "ctrl")
    assert {(r.model, r.experiment, r.time, r.ivaf) for r in less.collect()} == {("m", "e1", 0.0, 0.0), ("m", "e1", 1.0, 9.0), ("m", "e1", 2.0, 18.0), ("m", "e1", 4.0, 26.0)}
    with pytest.raises(Exception, match="header|byte"):
        scans.cells(spark, root, ["time", "ivaf", "file"], match=r"\.nc$").collect()


def test_what_queries_wrote_can_be_released(spark):
    from levelcast.sources import scratch

    table = scratch.written(spark.range(5), "numbers")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 5 and os.path.isdir(folder)
    scratch.release(spark)
    assert not os.path.exists(folder)
