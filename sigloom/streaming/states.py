"""The marker-driven state machine on whole sessions, its actions, and rates by event time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.joins import asof_state, compare_sequences

IGNORED = -1


@dataclass
class Machine:
    """``transitions``: state -> code -> next state; ``labels`` and ``groups``: what samples in a state are marked with."""

    start: str
    transitions: dict[str, dict[int, str]]
    labels: dict[str, int] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, code: int) -> str | None:
        return self.transitions.get(state, {}).get(code)


@dataclass
class Action:
    """``trigger``: ``entry:<state>``, ``exit:<state>`` or ``transition:<from>:<to>``; it toggles ``action`` for ``group`` after ``delay`` seconds."""

    trigger: str
    action: str
    group: str
    delay: float = 0.0


VISITS = "session_id {key}, ts double, code int, previous string, state string, visit int, problem string"


def walk(machine: Machine, state: str, visit: int, codes) -> Iterator[tuple[str, str, int, str | None]]:
    """(previous, state, visit, problem) for every code that is not ignored; a code that a state does not take changes nothing."""
    for code in codes:
        if code == IGNORED:
            continue
        after = machine.step(state, code)
        if after is None:
            yield state, state, visit, f"{state} does not take code {code}"
            continue
        visit += 1
        yield state, after, visit, None
        state = after


def state_visits(markers: DataFrame, machine: Machine) -> DataFrame:
    """States that each session visits, in order of time (ties by code); unaccepted codes are rows with a ``problem``."""
    schema = VISITS.format(key=markers.schema["session_id"].dataType.simpleString())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.code != IGNORED].sort_values(["ts", "code"], kind="stable")
        steps = list(walk(machine, machine.start, 0, rows.code.tolist()))
        out = pd.DataFrame(steps, columns=["previous", "state", "visit", "problem"])
        return pd.concat([rows[["session_id", "ts", "code"]].reset_index(drop=True), out], axis=1)

    return markers.select("session_id", "ts", F.col("code").cast("int")).groupBy("session_id").applyInPandas(run, schema)


def state_marks(visits: DataFrame, machine: Machine) -> DataFrame:
    """Visits with the ``label`` and ``grp`` of their state."""
    table = lambda d, kind: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("state")] if d else F.lit(None).cast(kind)
    return visits.filter("problem IS NULL").withColumns({"label": table(machine.labels, "int"), "grp": table(machine.groups, "string")})


def action_toggles(visits: DataFrame, actions: list[Action]) -> DataFrame:
    """(session_id, action, grp, ts, seq): when each action is toggled; at one visit transition comes before exit before entry."""
    triggers = F.array(F.concat(F.lit("transition:"), "previous", F.lit(":"), "state"), F.concat(F.lit("exit:"), "previous"), F.concat(F.lit("entry:"), "state"))
    table = visits.sparkSession.createDataFrame([(a.trigger, a.action, a.group, float(a.delay)) for a in actions], "trigger string, action string, grp string, delay double")
    fired = visits.select("session_id", "ts", "visit", F.posexplode(triggers).alias("order", "trigger")).join(F.broadcast(table), "trigger")
    return fired.select("session_id", "action", "grp", (F.col("ts") + F.col("delay")).alias("ts"), (F.col("visit") * 3 + F.col("order")).alias("seq"))


def action_intervals(toggles: DataFrame) -> DataFrame:
    """[``start``, ``end``) in which an action is on for a group: every second toggle turns it off; an open end is null."""
    w = Window.partitionBy("session_id", "action", "grp").orderBy("ts", "seq")
    numbered = toggles.withColumns({"n": F.row_number().over(w), "end": F.lead("ts").over(w)})
    return numbered.filter("n % 2 = 1").select("session_id", "action", "grp", F.col("ts").alias("start"), "end")


def covered(rows: DataFrame, intervals: DataFrame, keys: list[str], ts: str = "ts", index: str | None = None, bucket: int = 3600) -> DataFrame:
    """(``keys``, action, ``first``, ``last``): the times (or ``index``) of the first and last row inside each interval; intervals without rows go.

    Rows and intervals meet by key and stretch of ``bucket`` seconds. ``keys``: those of the rows; an open interval ends after the last row.
    """
    named = [k for k in keys if k in intervals.columns]
    last = rows.groupBy(*named).agg(F.max(ts).alias("__last"))
    spans = intervals.join(last, named).select(*named, "action", "start", F.coalesce("end", F.col("__last") + 1).alias("end")).filter("end > start")
    slot = lambda c: F.floor(c / bucket).cast("long")
    spread = spans.withColumn("__b", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))))
    met = rows.select(*keys, F.col(ts).alias("__t"), F.col(index or ts).alias("__i")).withColumn("__b", slot(F.col("__t"))).join(spread, [*named, "__b"])
    inside = met.filter((F.col("__t") >= F.col("start")) & (F.col("__t") < F.col("end")))
    return inside.groupBy(*keys, "action", "start").agg(F.min("__i").alias("first"), F.max("__i").alias("last")).drop("start")


def next_covered(asked: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str = "first", high: str = "last") -> DataFrame:
    """Add ``emitted`` to each row of ``asked``: the first time from ``at`` on that a span of its keys covers; rows that none such follows go.

    Spans of the same keys do not overlap, so the span is the next that ends at ``at`` or later: an as-of join on reversed time.
    """
    key = F.struct(*keys).alias("__key")
    back = spans.select(key, (-F.col(high)).alias("__ts"), F.col(low).alias("__low"))
    found = asof_state(asked.select("*", key, (-F.col(at)).alias("__ts")), back, "__low", "__key", "__ts", at_once=True)
    return found.filter("__low IS NOT NULL").withColumn("emitted", F.greatest(at, "__low")).drop("__key", "__ts", "__low")


def windowed_actions(windows: DataFrame, rows: DataFrame, intervals: DataFrame, key: str = "session_id") -> DataFrame:
    """When each window is emitted for each action of its group: the first sample with a group from the window's end on at
    which the action is on, before the group's next segment; windows that none such follows are not emitted.

    ``windows``: key, segment, window, grp, end_timestamp; ``rows``: samples with segment, grp, ts. Intervals shrink to the samples that they cover
    (see ``covered``); as a window ends at a sample, it is emitted there or where the next such interval begins.
    """
    firsts = rows.groupBy(key, "grp", "segment").agg(F.min("ts").alias("__f"))
    until = firsts.select(key, "segment", F.lead("__f").over(Window.partitionBy(key, "grp").orderBy("segment")).alias("__next"))
    kinds = intervals.select(key, "grp", "action").distinct()
    asked = windows.select(key, "segment", "window", "grp", "end_timestamp").join(until, [key, "segment"]).join(kinds, [key, "grp"])
    names = intervals.select(key, F.struct("grp", "action").alias("action"), "start", "end")
    spans = covered(rows.select(key, "ts"), names, [key]).select(key, "action.grp", "action.action", "first", "last")
    found = next_covered(asked, spans, [key, "grp", "action"], "end_timestamp").filter(F.col("__next").isNull() | (F.col("emitted") < F.col("__next")))
    return found.select(key, "segment", "window", "grp", "action", "emitted")


def check_states(visits: DataFrame, expected: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: positions compared and how many differ, problems found."""
    actual = visits.filter("problem IS NULL").select(key, (F.col("visit") - 1).alias("pos"), "state")
    compared = compare_sequences(expected, actual).groupBy(key).agg(F.count_if(~F.col("same")).alias("different"), F.count("*").alias("n"))
    problems = visits.groupBy(key).agg(F.count("problem").alias("problems"))
    return compared.join(problems, key, "left")


def rate_windows(df: DataFrame, size: str, slide: str | None = None, keys: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum by tumbling or sliding windows of event time; batch and stream alike."""
    return df.groupBy(*(keys or []), F.window(ts, size, slide or size)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*(keys or []), F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def session_rate(df: DataFrame, gap: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum by sessions that end after ``gap`` without an event."""
    return df.groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
