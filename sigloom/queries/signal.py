"""Channels, segments, windows, runs and state machines on sample-like rows, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import pairs
from sigloom.functions.nearest import nearest_within
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W
from sigloom.queries import standins as S
from sigloom.sources import tables
from sigloom.sources.staging import stage
from sigloom.streaming import states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


SAMPLES = f"WITH {S.SAMPLES_SQL}"
ANNOTATED = f"WITH {S.SAMPLES_SQL}, {S.ANNOTATIONS_SQL}"
MARKED = f"WITH {S.SAMPLES_SQL}, {S.MARKERS_SQL}"
EPOCHS = f"WITH {S.EPOCHS_SQL}"


@register(f"{SAMPLES} SELECT session_id, event_id, [(k - ref) / 1e6::DOUBLE, 0::DOUBLE] AS x FROM samples")
def rereference(spark, sf_dir):
    s = S.samples(spark, sf_dir)
    out = P.select_channels(P.scale(P.rereference(s, S.CHANNELS, "ref")), S.CHANNELS, ["k", "ref"])
    return out.select("session_id", "event_id", "x")


@register(f"{SAMPLES} SELECT session_id, event_id, ((k + ref) / 2 + 0.0) AS veog, k - ref AS heog FROM samples")
def eog_channels(spark, sf_dir):
    s = S.samples(spark, sf_dir).withColumn("x", F.array(F.col("x")[1], F.col("x")[2], F.col("x")[2], F.col("x")[1]))
    return P.eog_channels(s, ["Fp1", "Fp2", "F7", "F8"]).select("session_id", "event_id", "veog", "heog")


@register("SELECT p_partkey AS pos, CASE p_brand WHEN 'Brand#11' THEN 'Fp1' WHEN 'Brand#12' THEN 'Fp2' ELSE p_brand END AS label FROM part WHERE p_brand NOT IN ('Brand#13', 'Brand#21')")
def rename_drop_channels(spark, sf_dir):
    parts = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("label"))
    return P.rename_drop_channels(parts, {"Brand#11": "Fp1", "Brand#12": "Fp2"}, ["Brand#13", "Brand#21"])


@register(f"{EPOCHS} SELECT vec_id, -label AS label, 9 AS subject FROM epochs")
def replace_pick_fields(spark, sf_dir):
    return P.pick_fields(P.replace_field(S.epochs(spark, sf_dir), "label", -F.col("label")), ["vec_id", "label"], subject=9)


def _upper_sql(n: int, k: int) -> str:
    return "[" + ", ".join(f"sample[{i * n + j + 1}]" for i in range(n) for j in range(i + k, n)) + "]"


@register(f"{EPOCHS} SELECT vec_id, {_upper_sql(8, 0)} AS with_diagonal, {_upper_sql(8, 1)} AS without FROM epochs")
def flatten_upper(spark, sf_dir):
    x = F.col("sample")
    return S.epochs(spark, sf_dir).select("vec_id", P.flatten_upper(x, 8).alias("with_diagonal"), P.flatten_upper(x, 8, 1).alias("without"))


@register(
    f"""{EPOCHS}, parts AS (SELECT vec_id, unnest([0, 1, 2]) AS part, sample FROM epochs)
    SELECT vec_id, part, list_transform(range(0, 20), lambda i: sample[(i // 5) * 16 + part * 5 + i % 5 + 1]) AS sample FROM parts"""
)
def split_window(spark, sf_dir):
    return P.split_window(S.epochs(spark, sf_dir)).select("vec_id", "part", "sample")


@register(f"{EPOCHS} SELECT vec_id, list_transform(range(0, 128), lambda i: sample[((i // 8) % 4) * 16 + (i // 32) * 2 + i % 8 + 1]) AS sample FROM epochs")
def lag_embed(spark, sf_dir):
    return P.lag_embed(S.epochs(spark, sf_dir), 4, 2).select("vec_id", "sample")


_PAIR = f"{EPOCHS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY vec_id) - 1 AS i FROM epochs), pairs AS (SELECT a.subject_id, a.i AS i, b.i AS j, a.sample AS a, b.sample AS b FROM ordered a JOIN ordered b ON a.subject_id = b.subject_id AND a.i < b.i)"
_EUCLID = "sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) ** 2)))"


def _indexed(spark, sf_dir):
    return W.sample_index(S.epochs(spark, sf_dir), ["vec_id"], name="i")


_METRICS = {"euclidean": pairs.euclidean, "cityblock": pairs.cityblock, "cosine": pairs.cosine}


@register(
    f"""{_PAIR} SELECT subject_id, i, j, round({_EUCLID}, 6) AS euclidean, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) AS cityblock,
    round(1 - list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a, lambda v: v * v))) * sqrt(list_sum(list_transform(b, lambda v: v * v)))), 6) AS cosine FROM pairs"""
)
def vector_distances(spark, sf_dir):
    found = pairs.measured_pairs(_indexed(spark, sf_dir), {m: ("sample", f) for m, f in _METRICS.items()})
    return found.select("subject_id", "i", "j", *[P.round_half_away(F.col(m), 6).alias(m) for m in _METRICS])


@register(f"{_PAIR} SELECT subject_id, i, j, list_transform(list_zip(a, b), lambda p: round(p[2] - p[1], 6)) AS difference, list_transform(a, lambda v: round(sqrt(greatest(0, 2 * (1 - v))), 6)) AS far FROM pairs WHERE j = i + 1")
def difference_vector(spark, sf_dir):
    along = Window.partitionBy("subject_id").orderBy("i")
    rows = _indexed(spark, sf_dir).select("subject_id", "i", F.col("sample").alias("a"), F.lead("i").over(along).alias("j"), F.lead("sample").over(along).alias("b"))
    p = rows.filter("j IS NOT NULL")
    r = lambda c: F.transform(c, lambda v: P.round_half_away(v, 6))
    return p.select("subject_id", "i", "j", r(P.difference_vector(F.col("a"), F.col("b"))).alias("difference"), r(P.correlation_distance(F.col("a"))).alias("far"))


_KNN = f"""{_PAIR}, d AS (SELECT subject_id, i, j, round({_EUCLID}, 9) AS d FROM pairs),
    two AS (SELECT subject_id, i AS test, j AS candidate, d FROM d UNION ALL SELECT subject_id, j, i, d FROM d),
    named AS (SELECT two.*, t.event_id AS e1, t.label AS true_label, c.event_id AS e2, c.label AS label FROM two JOIN ordered t ON t.subject_id = two.subject_id AND t.i = test JOIN ordered c ON c.subject_id = two.subject_id AND c.i = candidate),
    open AS (SELECT *, max(CAST(e1 <> e2 AS INTEGER)) OVER (PARTITION BY subject_id, test) AS other FROM named),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, test ORDER BY d, candidate) AS INTEGER) AS rank FROM open WHERE e1 <> e2 OR other = 0)"""


def _near(spark, sf_dir):
    return W.nearest_k(nearest_within(stage(_indexed(spark, sf_dir), "rows"), "sample", P.vector_distance, 5, digits=9), 5)


@register(f"{_KNN} SELECT subject_id, test, candidate, rank FROM near WHERE rank <= 5")
def nearest_k(spark, sf_dir):
    return _near(spark, sf_dir).select("subject_id", "test", "candidate", "rank")


@register(
    f"""{_KNN}, v AS (SELECT subject_id, test, true_label, label, count(*) AS n FROM near WHERE rank <= 5 GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY subject_id, test ORDER BY n DESC, label) AS r FROM v) SELECT subject_id, test, true_label, label AS predicted_label FROM w WHERE r = 1"""
)
def knn_vote_euclid(spark, sf_dir):
    return W.knn_vote(_near(spark, sf_dir))


@register(
    f"""{_PAIR}, d AS (SELECT subject_id, i, j, {_EUCLID} AS d FROM pairs), w AS (SELECT *, min(d) OVER p AS a, max(d) OVER p AS b, min(j - i) OVER p AS c, max(j - i) OVER p AS e FROM d WINDOW p AS (PARTITION BY subject_id))
    SELECT subject_id, i, j, round(0.5 * d + 0.5 * (a + coalesce((j - i - c) / nullif(e - c, 0), 0) * (b - a)), 6) AS fused FROM w"""
)
def temporal_distance_fused(spark, sf_dir):
    d = pairs.measured_pairs(_indexed(spark, sf_dir), {"d": ("sample", pairs.euclidean)})
    return W.temporal_distance_fused(d).select("subject_id", "i", "j", P.round_half_away(F.col("fused"), 6).alias("fused"))


_STATES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.STATES.items())
ASOF = f"""{MARKED}, st AS (SELECT session_id, ts, CASE code {_STATES} END AS state FROM markers WHERE code <> -1),
    labelled AS (SELECT s.*, st.state FROM samples s ASOF LEFT JOIN st ON s.session_id = st.session_id AND s.ts > st.ts)"""


def _states(spark, sf_dir):
    name = F.create_map(*[x for k, v in S.STATES.items() for x in (F.lit(k), F.lit(v))])
    return S.markers(spark, sf_dir).filter("code <> -1").select("session_id", "ts", name[F.col("code")].alias("state"))


def _labelled(spark, sf_dir):
    return J.asof_state(S.samples(spark, sf_dir), _states(spark, sf_dir))


@register(f"{ASOF} SELECT session_id, idx, state FROM labelled")
def asof_state(spark, sf_dir):
    return _labelled(spark, sf_dir).select("session_id", "idx", "state")


# Only two of the states belong to a group, so that the others part segments.
SEGMENTS = f"""{ASOF}, grouped AS (SELECT *, CASE state WHEN 'Rest' THEN 'r' WHEN 'Imagery' THEN 'i' WHEN 'Point' THEN 'i' END AS grp FROM labelled),
    flagged AS (SELECT *, CAST(grp IS NOT NULL AND grp IS DISTINCT FROM lag(grp) OVER (PARTITION BY session_id ORDER BY idx) AS INTEGER) AS fresh FROM grouped),
    seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS segment FROM flagged)"""


def _segments(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    group = F.when(F.col("state") == "Rest", "r").when(F.col("state").isin("Imagery", "Point"), "i")
    return W.segments(rows.withColumn("grp", group), at="at")


@register(f"{SEGMENTS} SELECT session_id, idx, segment, grp FROM seg WHERE grp IS NOT NULL")
def segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("session_id", "idx", "segment", "grp")


@register(
    f"""{SEGMENTS}, n AS (SELECT session_id, segment, ts, event_id, row_number() OVER (PARTITION BY session_id, segment ORDER BY idx) - 1 AS p FROM seg WHERE grp IS NOT NULL),
    w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((p - 2) / 2)) AS BIGINT), p // 2 + 1)) AS win FROM n)
    SELECT session_id, segment, win AS "window", min(ts) AS start_timestamp, max(ts) AS end_timestamp, list(event_id ORDER BY p) AS events FROM w GROUP BY ALL HAVING count(*) = 3"""
)
def sliding_windows(spark, sf_dir):
    return W.sliding_windows(_segments(spark, sf_dir), 3, 2, collect={"events": "event_id"}, at="at")


_RUNS = """, flagged AS (SELECT session_id, idx, isnan(v) AS flag, CAST(isnan(v) IS DISTINCT FROM lag(isnan(v)) OVER (PARTITION BY session_id ORDER BY idx) AS INTEGER) AS fresh FROM samples),
    runs AS (SELECT session_id, flag, run, min(idx) AS start, max(idx) AS "end", count(*) AS rows FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS run FROM flagged) GROUP BY session_id, flag, run)"""


@register(f'{SAMPLES}{_RUNS} SELECT session_id, run, start, "end", rows FROM runs WHERE flag')
def missing_runs(spark, sf_dir):
    return W.missing_runs(S.samples(spark, sf_dir))


@register(f'{SAMPLES}{_RUNS} SELECT session_id, run, start, "end", rows FROM runs WHERE NOT flag')
def valid_runs(spark, sf_dir):
    return W.valid_runs(S.samples(spark, sf_dir))


@register(
    f"""{SAMPLES}{_RUNS}, best AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rows DESC, start) AS r FROM runs WHERE NOT flag)
    SELECT samples.session_id, idx, event_id FROM samples JOIN best ON samples.session_id = best.session_id AND r = 1 AND idx BETWEEN start AND "end" """
)
def crop_to_longest_run(spark, sf_dir):
    return W.crop_to_longest_run(S.samples(spark, sf_dir)).select("session_id", "idx", "event_id")


# Whole hours since the first event, so that windows hold several events; ties in time are told apart by the event.
HOURLY = ANNOTATED + """, hourly AS (SELECT subject_id, idx * 1000 + event_id % 1000 AS idx, split_part(description, '@@', 1) AS label, event_id FROM annotations),
    runs AS (SELECT *, sum(CAST(label IS DISTINCT FROM prev AS INTEGER)) OVER (PARTITION BY subject_id ORDER BY idx) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY subject_id ORDER BY idx) AS prev FROM hourly)),
    ended AS (SELECT runs.*, s.start AS "end" FROM runs LEFT JOIN (SELECT subject_id, run, min(idx) AS start FROM runs GROUP BY subject_id, run) s ON s.subject_id = runs.subject_id AND s.run = runs.run + 1)"""


def hourly(spark, sf_dir):
    a = S.annotations(spark, sf_dir)
    return a.select("subject_id", (F.col("idx") * 1000 + F.col("event_id") % 1000).alias("idx"), F.split_part("description", F.lit("@@"), F.lit(1)).alias("label"), "event_id")


@register(f'{HOURLY} SELECT subject_id, idx, label, event_id, "end" FROM ended')
def next_different(spark, sf_dir):
    return J.next_different(hourly(spark, sf_dir), "label")


_SPAN = 20_000_000


@register(
    f"""{HOURLY}, w AS (SELECT subject_id, event_id, label, unnest(range(idx + {_SPAN // 2}, "end" - {_SPAN} + 1, {_SPAN})) AS start FROM ended WHERE "end" IS NOT NULL AND "end" - {_SPAN} >= idx + {_SPAN // 2})
    SELECT subject_id, event_id, label, start, start + {_SPAN} AS "end" FROM w"""
)
def event_windows(spark, sf_dir):
    out = W.event_windows(hourly(spark, sf_dir), "label", 1, _SPAN // 2, _SPAN, _SPAN)
    return out.select("subject_id", "event_id", "label", "start", "end")


@register(
    f"""{HOURLY}, n AS (SELECT *, lead(idx) OVER (PARTITION BY subject_id ORDER BY idx) AS nxt FROM hourly),
    w AS (SELECT subject_id, event_id, unnest(range(idx + {_SPAN // 2}, nxt - {_SPAN} + 1, {_SPAN // 4})) AS start FROM n WHERE nxt - {_SPAN} >= idx + {_SPAN // 2})
    SELECT subject_id, event_id, start, start + {_SPAN} AS "end" FROM w"""
)
def event_subwindows(spark, sf_dir):
    out = W.event_subwindows(hourly(spark, sf_dir), 1, _SPAN // 2, _SPAN, _SPAN // 4)
    return out.select("subject_id", "event_id", "start", "end")


@register(
    f"""{HOURLY}, w AS (SELECT subject_id, event_id AS of_event, unnest(range(idx, "end" - {5 * _SPAN} + 1, {5 * _SPAN})) AS start FROM ended WHERE "end" - {5 * _SPAN} >= idx)
    SELECT h.subject_id, of_event, start, h.event_id FROM hourly h JOIN w ON h.subject_id = w.subject_id AND h.idx >= start AND h.idx < start + {5 * _SPAN}"""
)
def interval_join(spark, sf_dir):
    h = hourly(spark, sf_dir)
    spans = W.event_windows(h, "label", 1, 0, 5 * _SPAN, 5 * _SPAN).select("subject_id", F.col("event_id").alias("of_event"), "start", "end")
    joined = J.interval_join(h.select("subject_id", "idx", "event_id"), spans, "subject_id", "idx", "start", "end", bucket=_SPAN)
    return joined.select("subject_id", "of_event", "start", "event_id")


@register(
    f"""{HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, label = 'Background' AND "end" IS NOT NULL ORDER BY idx) AS r FROM ended)
    SELECT subject_id, event_id, label FROM r WHERE label <> 'Background' OR ("end" IS NOT NULL AND r = 1)"""
)
def first_background(spark, sf_dir):
    return W.first_background_only(hourly(spark, sf_dir), "label", F.col("label") == "Background").select("subject_id", "event_id", "label")


@register(
    f"""{HOURLY}, spans AS (SELECT subject_id, idx AS a, coalesce(nxt, 4611686018427387904) AS b FROM (SELECT *, lead(idx) OVER (PARTITION BY subject_id ORDER BY idx) AS nxt FROM hourly WHERE idx < {20 * _SPAN}) WHERE label = 'Background')
    SELECT subject_id, event_id FROM hourly h WHERE EXISTS (SELECT 1 FROM spans s WHERE s.subject_id = h.subject_id AND idx >= a AND idx < b)
        OR (subject_id NOT IN (SELECT subject_id FROM spans) AND idx < {3 * _SPAN})"""
)
def warmup_rows(spark, sf_dir):
    h = hourly(spark, sf_dir)
    events = h.filter(F.col("idx") < 20 * _SPAN).select("subject_id", "idx", F.col("label").alias("description"))
    return J.warmup_rows(h.select("subject_id", "idx", "event_id"), events, ["Background"], _SPAN / 10).select("subject_id", "event_id")


@register(f"{MARKED} SELECT session_id, ts, tag, count(*) OVER (PARTITION BY session_id ORDER BY ts, tag) AS place FROM (SELECT session_id, ts, 0 AS tag FROM samples UNION ALL SELECT session_id, ts, 1 FROM markers)")
def merge_streams(spark, sf_dir):
    merged = tables.replay(S.samples(spark, sf_dir).select("session_id", "ts", "event_id"), S.markers(spark, sf_dir))
    return W.sample_index(merged, ["ts", "tag"], key="session_id", name="place").select("session_id", "ts", "tag", (F.col("place") + 1).cast("long").alias("place"))


@register(f"{MARKED} SELECT code, in_data, in_config FROM (SELECT coalesce(a.code, b.code) AS code, a.code IS NOT NULL AS in_data, b.code IS NOT NULL AS in_config FROM (SELECT DISTINCT code FROM markers) a FULL JOIN (SELECT unnest([1, 2, 3, 7]) AS code) b ON a.code = b.code) WHERE NOT (in_data AND in_config)")
def codes_match_config(spark, sf_dir):
    return J.codes_match_config(S.markers(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,), (7,)], "code int"))


@register("SELECT event_id, to_json({'type': CASE WHEN event_type = 'error' THEN 'error' ELSE 'data' END, 'prediction': CAST(user_id % 2 AS INTEGER)}) AS line FROM events")
def result_envelope(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "error").alias("type"), (F.col("user_id") % 2).cast("int").alias("prediction"))
    return tables.result_envelope(e, ["type", "prediction"]).select("event_id", F.col("value").alias("line"))


@register("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = states.rate_windows(e, "1 hour", keys=["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@register(
    """WITH s AS (SELECT user_id, value, unnest([0, 1, 2]) AS k, time_bucket(INTERVAL '1 hour', ts) AS b FROM events)
    SELECT user_id, b - k * INTERVAL '1 hour' AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL"""
)
def sliding_rate(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = states.rate_windows(e, "3 hours", "1 hour", keys=["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@register(
    """WITH g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) AS INTEGER) AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = states.session_rate(e, "6 hours", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


_VISITS = f"""{MARKED}, v AS (SELECT session_id, ts, CASE code {_STATES} END AS state, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS visit FROM markers WHERE code <> -1)"""


def last_code_machine() -> states.Machine:
    """Every state takes every code and goes to that code's state."""
    moves = {s: {code: to for code, to in S.STATES.items()} for s in ("Start", *S.STATES.values())}
    return states.Machine(start="Start", transitions=moves, labels={"Rest": 0, "Imagery": 1, "Point": 1}, groups={"Rest": "r", "Imagery": "i", "Point": "i"})


@register(f"{_VISITS} SELECT session_id, ts, state, CAST(visit AS INTEGER) AS visit FROM v")
def state_visits(spark, sf_dir):
    return states.state_visits(S.markers(spark, sf_dir), last_code_machine()).filter("problem IS NULL").select("session_id", "ts", "state", "visit")


@register(f"{_VISITS} SELECT session_id, count(*) FILTER (lower(state) <> 'rest') AS different, count(*) AS n FROM v GROUP BY session_id")
def check_states(spark, sf_dir):
    visits = states.state_visits(S.markers(spark, sf_dir), last_code_machine())
    expected = visits.filter("problem IS NULL").select("session_id", (F.col("visit") - 1).alias("pos"), F.lit("REST").alias("state"))
    return states.check_states(visits, expected).select("session_id", "different", "n")


@register(
    f"""{MARKED}, t AS (SELECT session_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS n FROM markers WHERE code = 3)
    SELECT a.session_id, a.ts + 60 AS start, b.ts + 60 AS "end" FROM t a LEFT JOIN t b ON a.session_id = b.session_id AND b.n = a.n + 1 WHERE a.n % 2 = 1"""
)
def action_intervals(spark, sf_dir):
    """Every entry of Imagery toggles an action after a minute."""
    visits = states.state_visits(S.markers(spark, sf_dir), last_code_machine()).filter("problem IS NULL")
    toggles = states.action_toggles(visits, [states.Action("entry:Imagery", "PREDICT", "i", 60.0)])
    return states.action_intervals(toggles).select("session_id", "start", "end")


@register(
    f"""{SEGMENTS}, n AS (SELECT session_id, segment, grp, ts, event_id, row_number() OVER (PARTITION BY session_id, segment ORDER BY idx) - 1 AS p FROM seg WHERE grp IS NOT NULL),
    w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((p - 2) / 2)) AS BIGINT), p // 2 + 1)) AS win FROM n),
    win AS (SELECT session_id, segment, win, max(grp) AS grp, max(ts) AS e FROM w GROUP BY ALL HAVING count(*) = 3),
    t AS (SELECT session_id, ts + 60 AS ts, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS k FROM markers WHERE code = 3),
    act AS (SELECT a.session_id, a.ts AS a, b.ts AS b FROM t a LEFT JOIN t b ON a.session_id = b.session_id AND b.k = a.k + 1 WHERE a.k % 2 = 1),
    firsts AS (SELECT session_id, grp, segment, min(ts) AS f FROM n GROUP BY ALL),
    later AS (SELECT *, lead(f) OVER (PARTITION BY session_id, grp ORDER BY segment) AS nxt FROM firsts)
    SELECT win.session_id, win.segment, win AS "window", min(n.ts) AS emitted FROM win JOIN later ON win.session_id = later.session_id AND win.segment = later.segment
    JOIN n ON n.session_id = win.session_id AND n.ts >= e AND (nxt IS NULL OR n.ts < nxt) JOIN act ON act.session_id = n.session_id AND n.ts >= a AND (b IS NULL OR n.ts < b)
    WHERE win.grp = 'i' GROUP BY ALL"""
)
def windowed_actions(spark, sf_dir):
    """Windows of the group that the action covers, and when each is emitted."""
    rows = stage(_segments(spark, sf_dir).select("session_id", "segment", "grp", "idx", "ts", "at"), "segments")
    windows = stage(W.sliding_windows(rows, 3, 2, ("session_id", "segment", "grp"), at="at"), "windows")
    visits = stage(states.state_visits(S.markers(spark, sf_dir), last_code_machine()).filter("problem IS NULL"), "visits")
    intervals = states.action_intervals(states.action_toggles(visits, [states.Action("entry:Imagery", "PREDICT", "i", 60.0)]))
    return states.windowed_actions(windows, rows, intervals).select("session_id", "segment", "window", "emitted")
