import numpy as np
import pytest

from sigloom.functions import filters, signal_ops
from sigloom.sources import tables
from sigloom.streaming import live
from sigloom.streaming.states import Action, Machine, action_intervals, action_toggles, state_visits

CONFIG = {
    "initial_state": "IDLE",
    "states": {
        "IDLE": {"transitions": {1: "REST"}},
        "REST": {"label": 0, "group": "bg", "transitions": {2: "GO"}, "entry_actions": [{"action": "COLLECT_FOR_TRAIN", "group": "bg"}], "exit_actions": [{"action": "COLLECT_FOR_TRAIN", "group": "bg"}]},
        "GO": {"label": 1, "group": "trial", "transitions": {1: "REST"}, "entry_actions": [{"action": "PREDICT", "group": "trial", "delay_seconds": 1}]},
    },
    "windowing": [{"window_size": 3, "action": "PREDICT", "window_step": 1}],
}


def test_strict_machine(spark):
    machine, actions, _ = tables.parse_state_machine(CONFIG)
    markers = spark.createDataFrame([("s", 1.0, 1), ("s", 2.0, -1), ("s", 3.0, 2), ("s", 4.0, 2), ("s", 5.0, 1)], "session_id string, ts double, code int")
    visits = state_visits(markers, machine).orderBy("ts").collect()
    assert [(v.state, v.visit, v.problem is None) for v in visits] == [("REST", 1, True), ("GO", 2, True), ("GO", 2, False), ("REST", 3, True)]
    spans = action_intervals(action_toggles(state_visits(markers, machine).filter("problem IS NULL"), actions))
    assert sorted((r.action, r.start, r.end) for r in spans.collect()) == [("COLLECT_FOR_TRAIN", 1.0, 3.0), ("COLLECT_FOR_TRAIN", 5.0, None), ("PREDICT", 4.0, None)]


@pytest.mark.parametrize("broken", [{"action": "DANCE", "group": "g"}, {"action": "PREDICT"}])
def test_bad_actions_are_errors(broken):
    config = {"initial_state": "A", "states": {"A": {"entry_actions": [broken]}}}
    with pytest.raises(ValueError):
        tables.parse_state_machine(config)


def _stream_inputs(spark):
    random = np.random.RandomState(0)
    samples = [(s, 1000.0 + i, random.normal(size=2).tolist()) for s in ("a", "b") for i in range(40)]
    markers = [(s, t, c) for s, shift in (("a", 0), ("b", 3)) for t, c in ((1001.5 + shift, 1), (1008.5 + shift, 2), (1020.5 + shift, 1), (1025.5 + shift, 2), (1027.0, 9))]
    return spark.createDataFrame(samples, "session_id string, ts double, x array<double>"), spark.createDataFrame(markers, "session_id string, ts double, code int")


def test_stream_equals_replay(spark, tmp_path):
    machine, actions, _ = tables.parse_state_machine(CONFIG)
    settings = live.Settings(machine, actions, 3, 1, filters.butter_bandpass(4, 40, 250))
    samples, markers = _stream_inputs(spark)
    shown = lambda rows: sorted(str((*r[:12], [round(v, 9) for v in r.sample or []], r.message)) for r in rows)
    expected = shown(live.replay_windows(samples, markers, settings, chunk=7, stretch=11.0).collect())
    late = spark.createDataFrame([("z", 1500.0, [0.0, 0.0])], samples.schema)
    for k, part in enumerate((samples.filter("ts % 2 = 1"), samples.filter("ts % 2 = 0"), late, late.selectExpr("session_id", "ts + 500 AS ts", "x"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "samples"))
        if k == 0:
            markers.coalesce(1).write.parquet(str(tmp_path / "markers"))
    s = tables.stream_samples(spark, str(tmp_path / "samples"), "session_id string, ts double, x array<double>")
    m = tables.stream_markers(spark, str(tmp_path / "markers"), "session_id string, ts double, code int")
    out = live.live_windows(live.tagged(s, m, "60 seconds"), settings)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).filter("session_id <> 'z'")
    assert shown(got.collect()) == expected
    assert any("window" in r for r in expected) and any("does not take" in r for r in expected)


def test_actions_take_their_states_group():
    config = {"initial_state": "A", "states": {"A": {"group": "g", "entry_actions": [{"action": "PREDICT"}, {"action": "FIT", "group": "h"}]}}}
    assert [a.group for a in tables.parse_state_machine(config)[1]] == ["g", "h"]


def test_toggles_at_the_time_of_a_sample(spark):
    """A marker comes after the sample of its time; a delayed toggle before it."""
    machine = Machine("A", {"A": {1: "B"}, "B": {1: "B", 2: "A"}}, groups={"B": "g"}, labels={"B": 1})
    for delay in (0.0, 2.0):
        settings = live.Settings(machine, [Action("transition:B:B", "PREDICT", "g", delay)], 2, 2)
        samples = spark.createDataFrame([("s", float(t), [float(t)]) for t in range(12)], "session_id string, ts double, x array<double>")
        markers = spark.createDataFrame([("s", 1.0, 1), ("s", 4.0, 1), ("s", 7.0, 1), ("s", 9.0, 2)], "session_id string, ts double, code int")
        got = sorted((r.window, r.start_timestamp, r.emitted, r.state_visit_id) for r in live.replay_windows(samples, markers, settings, 5, 3.0).collect())
        rows = [(float(t), 0, None, [float(t)]) for t in range(12)] + [(t, 1, c, None) for _, t, c in markers.collect()]
        assert got == sorted((o[5], o[6], o[8], o[2]) for o in live.advance(live.Session("A"), rows, settings))


def test_chunked_filter_equals_one_pass(spark):
    x = np.random.RandomState(3).normal(size=(230, 2))
    df = spark.createDataFrame([("s", i, row.tolist()) for i, row in enumerate(x)], "session_id string, idx long, x array<double>")
    chunks = signal_ops.to_chunks(df, 64)
    got = np.array([r.x for r in signal_ops.from_chunks(signal_ops.bandpass(chunks, 4, 40, 250), 64).orderBy("idx").collect()])
    sections = filters.butter_bandpass(4, 40, 250)
    assert np.allclose(got, filters.sosfilt(sections, x.T)[0].T)
    started = np.array([r.x for r in signal_ops.from_chunks(signal_ops.bandpass(chunks, 4, 40, 250, start="unit_step"), 64).orderBy("idx").collect()])
    state = np.repeat(filters.unit_step_state(sections)[:, :, None], 2, 2)
    assert np.allclose(started, filters.sosfilt(sections, x.T, state)[0].T)


def test_resampled_chunks_equal_one_pass(spark):
    x = np.random.RandomState(4).normal(size=(1, 192))
    df = spark.createDataFrame([("s", i, [v]) for i, v in enumerate(x[0].tolist())], "session_id string, idx long, x array<double>")
    got = [v for r in signal_ops.resample(signal_ops.to_chunks(df, 64), 4, 64).orderBy("chunk").collect() for v in r.signal]
    taps = filters.decimation_taps(4)
    wide = np.pad(x[0], 40, mode="edge")
    assert np.allclose(got, [wide[t : t + 81] @ taps for t in range(0, 192, 4)])
    with pytest.raises(ValueError, match="divide"):
        signal_ops.resample(df, 5, 64)


def test_action_on_both_sides():
    machine = Machine("A", {"A": {1: "B"}, "B": {1: "A"}}, groups={"B": "g"})
    settings = live.Settings(machine, [Action("entry:B", "PREDICT", "g")], 2, 2)
    session = live.Session("A")
    rows = [(0.0, 1, 1, None), *[(float(t), 0, None, [float(t)]) for t in range(1, 6)]]
    assert [o[5] for o in live.advance(session, rows, settings)] == [0, 1] and len(session.tail) == 1
