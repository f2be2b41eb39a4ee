import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import DataFrameWriter

from sigloom.queries import sessions as session_queries
from sigloom.schemas import EPOCHS, require_columns
from sigloom.sources import tables


@pytest.fixture
def sessions(spark, tmp_path):
    for name in ("s2", "s1", "s3"):
        samples = spark.createDataFrame([(name, i, float(i), [1.0 * i, 2.0]) for i in range(3)], "session_id string, idx long, ts double, x array<double>")
        samples.coalesce(1).write.parquet(str(tmp_path / "root" / name / "samples.parquet"))
        if name != "s3":
            spark.createDataFrame([(name, 0.5, [9, 4])], "session_id string, ts double, payload array<int>").write.parquet(str(tmp_path / "root" / name / "markers.parquet"))
        (tmp_path / "root" / name / "task.json").write_text(json.dumps({"samples": [{"sample_type": "Rest"}, {"sample_type": "Image"}], "events": []}))
    return tmp_path / "root"


def test_sessions_are_found_and_read(spark, sessions):
    found = tables.discover_sessions(spark, str(sessions)).collect()
    assert [(r.session_id, r.complete) for r in found] == [("s1", True), ("s2", True), ("s3", False)]
    assert [r.session_id for r in tables.discover_sessions(spark, str(sessions), only=["s2"]).collect()] == ["s2"]
    assert tables.read_samples(spark, str(sessions / "s1" / "samples.parquet")).count() == 3
    assert tables.read_markers(spark, str(sessions / "s1" / "markers.parquet")).first().code == 4
    task = tables.read_task_json(spark, str(sessions / "*" / "task.json")).orderBy("session_id", "pos").collect()
    assert [(r.session_id, r.pos, r.sample_type) for r in task][:2] == [("s1", 0, "Rest"), ("s1", 1, "Image")] and len(task) == 6


@pytest.mark.parametrize("root", ["rec", "run+1", "a (b)", "100%"])
def test_sessions_below_roots_of_any_name(spark, tmp_path, root):
    """A session may be named as its root, and a root's name may hold signs of patterns."""
    for session in ("rec", "x.y"):
        for name in ("samples.parquet", "markers.parquet"):
            (tmp_path / root / session / name).mkdir(parents=True)
            (tmp_path / root / session / name / "part").write_text("x")
    assert [tuple(r) for r in tables.discover_sessions(spark, str(tmp_path / root)).collect()] == [("rec", True), ("x.y", True)]


def test_epochs_metrics_models_and_cache(spark, tmp_path):
    epochs = spark.createDataFrame([(1, 2, 0, 1.0, False, True, False, 2, 3, [0.0] * 6)], EPOCHS)
    tables.write_epochs(epochs, str(tmp_path / "e"))
    assert tables.read_epochs(spark, str(tmp_path / "e"), ["label"]).first().sample == [0.0] * 6
    with pytest.raises(ValueError, match="vas"):
        tables.read_epochs(spark, str(tmp_path / "e"), ["vas"])
    metrics = spark.createDataFrame([(1, 0.5)], "subject_id long, f1 double")
    tables.write_metrics_csv(metrics, str(tmp_path / "m"))
    assert tables.read_metrics_csv(spark, str(tmp_path / "m"), "subject_id long, f1 double").first().f1 == 0.5
    tables.save_model({"means": metrics}, str(tmp_path / "model"))
    assert tables.load_model(spark, str(tmp_path / "model"), {"means": ["f1"]})["means"].count() == 1
    with pytest.raises(ValueError, match="recall"):
        tables.load_model(spark, str(tmp_path / "model"), {"means": ["recall"]})
    saved = tables.calibrated_cache(metrics, str(tmp_path / "c"), use=True, save=True)
    assert saved.first().f1 == 0.5
    again = tables.calibrated_cache(metrics.withColumn("f1", F.lit(0.9)), str(tmp_path / "c"), use=True, save=False)
    assert again.first().f1 == 0.5 and tables.calibrated_cache(metrics, str(tmp_path / "none"), True, False) is metrics


def test_results_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([("error", 1, 0.5), (None, 0, 0.25)], "type string, prediction int, probability double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    tables.write_results_stream(tables.result_envelope(stream, ["type", "prediction", "probability"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    lines = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda x: x["type"])
    assert lines == [{"type": "data", "prediction": 0, "probability": 0.25}, {"type": "error", "prediction": 1, "probability": 0.5}]


def test_machine_tables(spark):
    config = {"initial_state": "A", "states": {"A": {"transitions": {1: "B"}, "exit_actions": [{"action": "PREDICT", "group": "g"}]}, "B": {"label": 1, "group": "g"}}, "windowing": [{"window_size": 5, "action": "PREDICT", "window_step": 2}]}
    dims = tables.dimension_tables(spark, *tables.parse_state_machine(config))
    assert {k: v.count() for k, v in dims.items()} == {"states": 2, "transitions": 1, "actions": 1, "windowing": 1}
    with pytest.raises(ValueError, match="unknown states"):
        tables.parse_state_machine({"initial_state": "A", "states": {"A": {"transitions": {1: "Z"}}}})


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_stand_in_sessions_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """Sessions are few bytes: left to their size, all of their files would be one task's."""
    seen, write = [], DataFrameWriter.csv
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, *a, **k: (seen.append(self._df.rdd.getNumPartitions()), write(self, *a, **k))[1])
    rows = session_queries.QUERIES["discover_sessions"](spark, sf_dir).collect()
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and rows and rows == sorted(rows)
