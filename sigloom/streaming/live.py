"""Live sessions: state machine, filter, windows, adaptation and prediction as one stateful operator per session, by event time."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.functions import filters, linalg, matrix, signal_ops
from sigloom.operators.joins import asof_state
from sigloom.operators.stretches import row_numbers
from sigloom.operators.windows import segments, sliding_windows
from sigloom.sources.staging import stage
from sigloom.streaming.states import Action, Machine, action_intervals, action_toggles, covered, next_covered, state_marks, state_visits, walk

EVENTS = "session_id {key}, ts timestamp, tag int, code int, x array<double>"
WINDOWS = (
    "session_id {key}, kind string, action string, state_visit_id int, label int, segment long, window long, start_timestamp double, end_timestamp double, emitted double, n_channels int, n_times int, sample array<double>, message string"
)


@dataclass
class Settings:
    """``size`` and ``step`` of the windows of every action; ``sections`` of a causal filter (None: none); no list keeps more than a window needs."""

    machine: Machine
    actions: list[Action]
    size: int
    step: int
    sections: np.ndarray | None = None


@dataclass
class Session:
    """What is carried from batch to batch for one session."""

    state: str
    visit: int = 0
    group: str | None = None
    segment: int = 0
    seen: int = 0
    tail: list = field(default_factory=list)
    done: dict = field(default_factory=dict)
    on: dict = field(default_factory=dict)
    due: list = field(default_factory=list)
    filter: np.ndarray | None = None
    late: int = 0
    waiting: list = field(default_factory=list)


def tagged(samples: DataFrame, markers: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Both streams in one, samples with tag 0 and markers with 1, under one watermark. ``ts``: seconds since the epoch."""
    at = F.timestamp_micros((F.col("ts") * 1e6).cast("long"))
    a = samples.select("session_id", at.alias("ts"), F.lit(0).alias("tag"), F.lit(None).cast("int").alias("code"), "x")
    b = markers.select("session_id", at.alias("ts"), F.lit(1).alias("tag"), F.col("code").cast("int").alias("code"), F.lit(None).cast("array<double>").alias("x"))
    return a.unionByName(b).withWatermark("ts", delay)


def advance(session: Session, rows: list, settings: Settings) -> list[tuple]:
    """Take in rows (seconds, tag, code, x) in order; give what is emitted: windows and reports of codes that a state does not take.

    Samples before markers at equal times. Due toggles come before the row at whose time they are due.
    """
    out: list[tuple] = []
    for ts, tag, code, x in sorted(rows, key=lambda r: (r[0], r[1])):
        for moment, action, group in sorted(d for d in session.due if d[0] <= ts):
            session.on[(action, group)] = not session.on.get((action, group), False)
        session.due = [d for d in session.due if d[0] > ts]
        if tag == 1:
            for previous, state, visit, problem in walk(settings.machine, session.state, session.visit, [code]):
                if problem:
                    out.append(("problem", None, session.visit, None, None, None, ts, ts, ts, None, None, None, problem))
                    continue
                session.state, session.visit = state, visit
                for trigger in (f"transition:{previous}:{state}", f"exit:{previous}", f"entry:{state}"):
                    session.due += [(ts + a.delay, a.action, a.group) for a in settings.actions if a.trigger == trigger]
            continue
        x = np.asarray(x, float)
        if settings.sections is not None:
            y, session.filter = filters.sosfilt(settings.sections, x[:, None], session.filter)
            x = y[:, 0]
        group = settings.machine.groups.get(session.state)
        if group is None:
            session.group = None
            continue
        if group != session.group:
            session.group, session.segment, session.seen, session.tail, session.done = group, session.segment + 1, 0, [], {}
        session.tail.append((ts, x))
        session.seen += 1
        label = settings.machine.labels.get(session.state)
        for action in [a for (a, g), active in session.on.items() if active and g == group]:
            number = session.done.get(action, 0)
            while number * settings.step + settings.size <= session.seen:
                first = number * settings.step - (session.seen - len(session.tail))
                if first >= 0:
                    held = session.tail[first : first + settings.size]
                    data = np.stack([v for _, v in held], 1)
                    out.append(("window", action, session.visit, label, session.segment, number, held[0][0], held[-1][0], ts, data.shape[0], data.shape[1], data.ravel().tolist(), None))
                number += 1
            session.done[action] = number
        _trim(session, settings)
    return out


def _trim(session: Session, settings: Settings) -> None:
    """Forget samples that every action of the group has passed; where an action may still switch on, windows begin at the segment's start, so all are kept."""
    wanted = {a.action for a in settings.actions if a.group == session.group}
    number = min((session.done.get(a, 0) for a in wanted), default=session.seen)
    first = number * settings.step - (session.seen - len(session.tail))
    if first > 0:
        del session.tail[:first]


def live_windows(events: DataFrame, settings: Settings, idle: str = "1 hour") -> DataFrame:
    """Windows and problem reports of a ``tagged`` stream, in append mode.

    Rows are held back until the watermark passes them and then taken in order, so the order of arrival inside the watermark does not matter;
    rows older than it are dropped and counted in the next problem report. An idle session's rest is flushed by an event-time timeout.
    """
    key = events.schema["session_id"].dataType.simpleString()

    def run(names, batches, state: GroupState):
        session = pickle.loads(state.get[0]) if state.exists else Session(settings.machine.start)
        mark = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            for rows in batches:
                for ts, tag, code, x in zip(rows.ts, rows.tag, rows.code, rows.x, strict=True):
                    seconds = ts.value // 1000 / 1e6
                    if seconds < mark:
                        session.late += 1
                    else:
                        session.waiting.append((seconds, int(tag), None if pd.isna(code) else int(code), x))
        ready = [r for r in session.waiting if r[0] <= mark or state.hasTimedOut]
        session.waiting = [r for r in session.waiting if not (r[0] <= mark or state.hasTimedOut)]
        out = advance(session, ready, settings)
        if session.late and (ready or state.hasTimedOut):
            out.append(("problem", None, session.visit, None, None, None, mark, mark, mark, None, None, None, f"{session.late} late rows dropped"))
            session.late = 0
        if state.hasTimedOut and not session.waiting:
            state.remove()
        else:
            state.update((pickle.dumps(session),))
            if session.waiting:
                state.setTimeoutTimestamp(int(max(mark, max(r[0] for r in session.waiting)) * 1000) + 1)
        columns = [c.strip().split(" ")[0] for c in WINDOWS.format(key=key).split(",")]
        yield pd.DataFrame([(names[0], *o) for o in out], columns=columns)

    return events.groupBy("session_id").applyInPandasWithState(run, WINDOWS.format(key=key), "session binary", "append", GroupStateTimeout.EventTimeTimeout)


def replay_windows(samples: DataFrame, markers: DataFrame, settings: Settings, chunk: int = 4096, stretch: float = 3600.0) -> DataFrame:
    """What ``live_windows`` gives, for recorded sessions: the same windows and problem reports from the library's batch parts.

    Samples are numbered, filtered in chunks, given the state before them and cut into segments and windows; a window is emitted at its last sample,
    or at the first later one of its segment that its action covers. Only markers, chunks' end states and rows a stretch are ever in one
    order for a session; its samples are worked out in stretches of ``stretch`` seconds and chunks of ``chunk`` samples.
    """
    machine, key = settings.machine, "session_id"
    visits = stage(state_visits(markers, machine), "visits")
    rows = stage(row_numbers(samples.select(key, "ts", "x"), [key], "ts", "idx", stretch, ("x",)), "numbered")
    if settings.sections is not None:
        filtered = signal_ops.from_chunks(signal_ops.run_filters(signal_ops.to_chunks(rows, chunk), [settings.sections]), chunk)
        rows = stage(rows.drop("x").join(filtered, [key, "idx"]), "filtered")
    accepted = visits.filter("problem IS NULL")
    marks = state_marks(accepted, machine).select(key, "ts", F.struct("visit", "label", "grp").alias("at"))
    marks = marks.groupBy(key, "ts").agg(F.max_by("at", "at.visit").alias("at"))
    told = asof_state(rows, marks, "at").select(*rows.columns, F.coalesce("at.visit", F.lit(0)).alias("visit"), "at.label", "at.grp")
    start = machine.groups.get(machine.start), machine.labels.get(machine.start)
    told = told.withColumn("grp", F.when(F.col("visit") == 0, F.lit(start[0]).cast("string")).otherwise(F.col("grp"))).withColumn("label", F.when(F.col("visit") == 0, F.lit(start[1]).cast("int")).otherwise(F.col("label")))
    held = stage(segments(told, at="at"), "segments")
    windows = sliding_windows(held, settings.size, settings.step, (key, "segment", "grp"), collect={"__x": "x", "__at": "idx"}, at="at")
    windows = stage(windows.withColumn("__last", F.element_at("__at", -1)).drop("__at"), "windows")
    # A sample comes before a marker of its time, so what a marker toggles at once holds from just after it (times are microseconds).
    toggles = action_toggles(accepted, [replace(a, delay=a.delay or 5e-7) for a in settings.actions])
    intervals = action_intervals(toggles).select(key, "grp", "action", "start", "end")
    pairs = intervals.select(key, F.struct("grp", "action").alias("action"), "start", "end")
    spans = covered(held.select(key, "segment", "grp", "idx", "ts"), pairs, [key, "segment", "grp"], index="idx", bucket=int(stretch))
    spans = stage(spans.filter("grp = action.grp").select(key, "segment", "action.action", "first", "last"), "spans")
    kinds = spans.select(key, "segment", "action").distinct()
    found = next_covered(windows.join(kinds, [key, "segment"]), spans, [key, "segment", "action"], "__last")
    there = held.select(key, F.col("idx").alias("emitted"), F.col("ts").alias("__ts"), "visit", "label")
    channels = F.size(F.col("__x")[0])
    flat = F.flatten(F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.transform("__x", lambda v: v[c])))
    null = lambda kind: F.lit(None).cast(kind)
    emitted = found.join(there, [key, "emitted"]).select(
        key, F.lit("window").alias("kind"), "action", F.col("visit").alias("state_visit_id"), "label", "segment", "window", "start_timestamp", "end_timestamp",
        F.col("__ts").alias("emitted"), channels.alias("n_channels"), F.size("__x").alias("n_times"), flat.alias("sample"), null("string").alias("message"),
    )
    problems = visits.filter("problem IS NOT NULL").select(
        key, F.lit("problem").alias("kind"), null("string").alias("action"), F.col("visit").alias("state_visit_id"), null("int").alias("label"), null("long").alias("segment"), null("long").alias("window"),
        *[F.col("ts").alias(c) for c in ("start_timestamp", "end_timestamp", "emitted")], null("int").alias("n_channels"), null("int").alias("n_times"), null("array<double>").alias("sample"), F.col("problem").alias("message"),
    )
    return emitted.unionByName(problems)


def predict_stream(windows: DataFrame, n_channels: int, model: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``probability`` to windows: covariance, spatial filters and a linear model of log variances.

    ``model``: one row with ``filters`` (flat), ``weights`` and ``bias``; without a row nothing is predicted.
    """
    joined = windows.filter("kind = 'window' AND action = 'PREDICT'").join(F.broadcast(model), F.lit(True))
    features = matrix.filtered("filters", matrix.covariance("sample", n_channels))
    score = F.aggregate(F.zip_with(features, "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("bias")
    proba = 1 / (1 + F.exp(-score))
    return joined.withColumn("__p", proba).withColumns({"prediction": (F.col("__p") >= 0.5).cast("int"), "probability": F.greatest("__p", 1 - F.col("__p"))}).drop("__p", "filters", "weights", "bias")
