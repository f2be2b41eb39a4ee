"""Filters and live windows on sessions made of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import filters, signal_ops
from sigloom.operators import projections as P
from sigloom.queries import standins as S
from sigloom.queries.signal import SEGMENTS, last_code_machine
from sigloom.sources import tables
from sigloom.sources.staging import shared_dir
from sigloom.streaming import adapt, live
from sigloom.streaming.states import IGNORED, Action

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RATE = 100.0
SIZE = 64
BANDS = {"theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _clean(spark, sf_dir):
    return S.samples(spark, sf_dir).withColumn("x", F.transform("x", lambda v: F.nanvl(v, F.lit(0.0))))


def _chunks(spark, sf_dir, size: int = SIZE):
    return signal_ops.to_chunks(_clean(spark, sf_dir), size)


def _rounded(c: str):
    return F.transform(c, lambda v: P.round_half_away(v, 6) + 0.0).alias(c)


LONG = f"WITH RECURSIVE {S.SAMPLES_SQL}, clean AS (SELECT session_id, idx, unnest([0, 1, 2]) AS ch, unnest([CASE WHEN isnan(v) THEN 0 ELSE v END, k, ref]) AS x FROM samples)"


def filter_sql(bands: dict[str, tuple[float, float]]) -> str:
    """CTEs that end in ``filtered`` (band, session_id, ch, idx, y): every sample through the sections of its band, whose states go from step to step."""
    designs = {band: filters.butter_bandpass(low, high, RATE) for band, (low, high) in bands.items()}
    n = len(next(iter(designs.values())))
    names = [f"{c}{s}" for s in range(n) for c in ("b0_", "b1_", "b2_", "a1_", "a2_")]
    rows = ", ".join("('" + band + "', " + ", ".join(f"{float(v[j])!r}::DOUBLE" for v in d for j in (0, 1, 2, 4, 5)) + ")" for band, d in designs.items())
    steps = [f"b0_{s} * {f'o{s - 1}' if s else 'x'} + z{s}_0 AS o{s}, b1_{s} * {f'o{s - 1}' if s else 'x'} - a1_{s} * o{s} + z{s}_1 AS n{s}_0, b2_{s} * {f'o{s - 1}' if s else 'x'} - a2_{s} * o{s} AS n{s}_1" for s in range(n)]
    state = [f"z{s}_{j}" for s in range(n) for j in (0, 1)]
    return f"""design({', '.join(['band', *names])}) AS (VALUES {rows}),
    walk AS (SELECT band, session_id, ch, CAST(-1 AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS y, {', '.join(f'CAST(0 AS DOUBLE) AS {z}' for z in state)} FROM design CROSS JOIN (SELECT DISTINCT session_id, ch FROM clean)
        UNION ALL SELECT band, session_id, ch, idx, o{n - 1}, {', '.join(z.replace('z', 'n') for z in state)} FROM (SELECT *, {', '.join(steps)} FROM (
            SELECT design.*, clean.session_id, clean.ch, clean.idx, clean.x, {', '.join(f'walk.{z}' for z in state)} FROM walk JOIN clean ON clean.session_id = walk.session_id AND clean.ch = walk.ch AND clean.idx = walk.idx + 1 JOIN design USING (band)))),
    filtered AS (SELECT band, session_id, ch, idx, y FROM walk WHERE idx >= 0)"""


@register(f"{LONG}, {filter_sql({'all': (4, 40)})} SELECT session_id, idx, list(round(y, 6) + 0.0 ORDER BY ch) AS x FROM filtered GROUP BY session_id, idx")
def bandpass(spark, sf_dir):
    out = signal_ops.from_chunks(signal_ops.bandpass(_chunks(spark, sf_dir), 4, 40, RATE), SIZE)
    return out.select("session_id", "idx", _rounded("x"))


_TAPS = "[" + ", ".join(repr(float(t)) for t in filters.decimation_taps(2)) + "]::DOUBLE[]"


@register(
    f"""{LONG}, whole AS (SELECT session_id, ch, list(x ORDER BY idx) AS x, count(*) AS n FROM clean GROUP BY session_id, ch),
    at AS MATERIALIZED (SELECT session_id, ch, x, n, unnest(range(0, n, 2)) AS idx FROM whole),
    y AS (SELECT session_id, ch, idx, list_sum(list_transform(range(0, 41), lambda k: ({_TAPS})[k + 1] * x[greatest(1, least(n, idx + k - 20 + 1))])) AS y FROM at)
    SELECT session_id, idx // {SIZE} AS chunk, 3 AS n_channels, CAST(count(*) // 3 AS INTEGER) AS n_times, list(round(y, 6) + 0.0 ORDER BY ch, idx) AS signal FROM y GROUP BY session_id, idx // {SIZE}""".replace("at AS MAT", "at_ AS MAT").replace("FROM at)", "FROM at_)")
)
def resample(spark, sf_dir):
    return signal_ops.resample(_chunks(spark, sf_dir), 2, SIZE).select("session_id", "chunk", "n_channels", "n_times", _rounded("signal"))


@register(
    f"""{LONG}, {filter_sql(BANDS)} SELECT session_id, idx // {SIZE} AS chunk, 9 AS n_channels, CAST(count(*) // 9 AS INTEGER) AS n_times,
    list(round(y, 6) + 0.0 ORDER BY CASE band {' '.join(f"WHEN '{b}' THEN {k}" for k, b in enumerate(BANDS))} END, ch, idx) AS signal FROM filtered GROUP BY session_id, idx // {SIZE}"""
)
def multi_band(spark, sf_dir):
    out = signal_ops.multi_band(_chunks(spark, sf_dir), S.CHANNELS, BANDS, RATE)[0]
    return out.select("session_id", "chunk", "n_channels", "n_times", _rounded("signal"))


def settings(filtered: bool = True) -> live.Settings:
    return live.Settings(last_code_machine(), [Action("entry:Imagery", "PREDICT", "i", 60.0)], 3, 2, filters.butter_bandpass(4, 40, RATE) if filtered else None)


# Windows of the imagery segments, emitted at the first sample of the segment from their last one on that the action covers.
def _windows_sql(samples: str, extra: str = "") -> str:
    recursive = SEGMENTS.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{recursive}{extra}, xs AS ({samples}),
    n AS MATERIALIZED (SELECT s.session_id, s.segment, s.grp, s.ts, s.idx, s.state, xs.x, row_number() OVER (PARTITION BY s.session_id, s.segment ORDER BY s.idx) - 1 AS p FROM seg s JOIN xs USING (session_id, idx) WHERE s.grp = 'i'),
    spread AS (SELECT *, unnest(range(CAST(greatest(0, ceil((p - 2) / 2)) AS BIGINT), p // 2 + 1)) AS win FROM n),
    win AS (SELECT session_id, segment, win, min(ts) AS a, max(ts) AS e, max(p) AS q, list_transform(range(0, 9), lambda j: list(x ORDER BY p)[j % 3 + 1][j // 3 + 1]) AS sample FROM spread GROUP BY ALL HAVING count(*) = 3),
    t AS (SELECT session_id, ts + 60 AS ts, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS k FROM markers WHERE code = 3),
    act AS (SELECT x.session_id, x.ts AS a, y.ts AS b FROM t x LEFT JOIN t y ON x.session_id = y.session_id AND y.k = x.k + 1 WHERE x.k % 2 = 1),
    out AS (SELECT win.session_id, win.segment, win.win, win.a, win.e, win.sample, min(n.p) AS p FROM win JOIN n ON n.session_id = win.session_id AND n.segment = win.segment AND n.p >= win.q
        JOIN act ON act.session_id = n.session_id AND n.ts >= act.a AND (act.b IS NULL OR n.ts < act.b) GROUP BY ALL)
    SELECT out.session_id, 'window' AS kind, 'PREDICT' AS action, (SELECT CAST(count(*) AS INTEGER) FROM markers m WHERE m.session_id = out.session_id AND m.code <> -1 AND m.ts < n.ts) AS state_visit_id, 1 AS label, out.segment, win AS "window",
        out.a AS start_timestamp, out.e AS end_timestamp, n.ts AS emitted, 3 AS n_channels, 3 AS n_times, list_transform(out.sample, lambda v: round(v, 6) + 0.0) AS sample, CAST(NULL AS VARCHAR) AS message
    FROM out JOIN n ON n.session_id = out.session_id AND n.segment = out.segment AND n.p = out.p"""


RAW = _windows_sql("SELECT session_id, idx, [CASE WHEN isnan(v) THEN 0 ELSE v END, k, ref] AS x FROM samples")
_CLEAN = LONG.split(f"{S.SAMPLES_SQL}, ")[1]


@register(_windows_sql("SELECT session_id, idx, list(y ORDER BY ch) AS x FROM filtered GROUP BY session_id, idx", f", {_CLEAN}, {filter_sql({'all': (4, 40)})}"))
def replayed_windows(spark, sf_dir):
    """Recorded sessions: machine, delayed toggles, filter, windows."""
    out = live.replay_windows(_clean(spark, sf_dir), S.markers(spark, sf_dir), settings())
    return out.select(*[c for c in out.columns if c not in ("sample", "message")], _rounded("sample"), "message")


def _stream(spark, sf_dir) -> DataFrame:
    """The sessions as a stream of files; a marker of another session, far on, lets the watermark pass them all."""
    root = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    markers = S.markers(spark, sf_dir).select("session_id", "ts", "code")
    far = markers.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("session_id"), (F.col("ts") + 60 * 86400).alias("ts"), F.lit(IGNORED).alias("code"))
    _clean(spark, sf_dir).select("session_id", "ts", "x").write.parquet(f"{root}/samples")
    markers.unionByName(far).write.parquet(f"{root}/markers")
    samples = tables.stream_samples(spark, f"{root}/samples", "session_id long, ts double, x array<double>", 10_000)
    return live.live_windows(live.tagged(samples, tables.stream_markers(spark, f"{root}/markers", "session_id long, ts double, code int", 10_000), "30 days"), settings(False))


def _drained(found: DataFrame) -> DataFrame:
    """Run a stream to the end of its files; what it wrote."""
    root = f"{shared_dir(found.sparkSession)}/drained-{uuid.uuid4().hex}"
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{root}/out")


@register(RAW)
def live_windows(spark, sf_dir):
    """The same sessions, unfiltered, through the live operator."""
    out = _drained(_stream(spark, sf_dir))
    return out.select(*[c for c in out.columns if c not in ("sample", "message")], _rounded("sample"), "message")


WEIGHTS, BIAS = (0.4, -0.3, 0.2), 0.05
_CENTRED = ", ".join(f"list_transform(sample[{3 * c + 1}:{3 * c + 3}], lambda v: v - list_avg(sample[{3 * c + 1}:{3 * c + 3}])) AS c{c}" for c in range(3))
_DOT = lambda i, j: f"list_sum(list_transform(list_zip(c{i}, c{j}), lambda p: p[1] * p[2])) / 3"


_FOUND = f"""WITH found AS ({RAW}), centred AS (SELECT session_id, segment, "window", emitted, {_CENTRED} FROM found),
    m AS (SELECT *, {', '.join(f'{_DOT(i, j)} AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM centred),
    s AS (SELECT *, (m00 + m11 + m22) / 3 AS mu, (m00 ** 2 + m11 ** 2 + m22 ** 2 + 2 * (m01 ** 2 + m02 ** 2 + m12 ** 2)) / 9 AS alpha, 4 * (alpha - mu * mu / 3) AS below, CASE WHEN below = 0 THEN 1 ELSE least(1, (alpha + mu * mu) / below) END AS rho FROM m),"""


def _linear_sql(weights: tuple[float, ...], bias: float) -> str:
    return f"1 / (1 + exp(-({' + '.join(f'{w} * ln(greatest((1 - rho) * m{c}{c} + rho * mu, 1e-300::DOUBLE))' for c, w in enumerate(weights))} + {bias})))"


@register(
    f"""{_FOUND}
    p AS (SELECT *, {_linear_sql(WEIGHTS, BIAS)} AS proba FROM s)
    SELECT session_id, segment, "window", emitted, CAST(proba >= 0.5 AS INTEGER) AS prediction, round(greatest(proba, 1 - proba), 6) AS probability FROM p"""
)
def live_predictions(spark, sf_dir):
    """Windows of the stream, predicted as they come."""
    model = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], list(WEIGHTS), BIAS)], "filters array<double>, weights array<double>, bias double")
    out = _drained(live.predict_stream(_stream(spark, sf_dir), 3, model))
    return out.select("session_id", "segment", "window", "emitted", "prediction", F.round("probability", 6).alias("probability"))


LATER, LATER_BIAS = (-0.2, 0.5, 0.1), -0.15
_VERSIONED = f"""{_FOUND.replace('WITH found', f'WITH {S.SAMPLES_SQL}, half AS MATERIALIZED (SELECT (min(ts) + max(ts)) / 2 AS half FROM samples), found')}
    p AS (SELECT *, emitted >= half AS late, CASE WHEN emitted >= half THEN {_linear_sql(LATER, LATER_BIAS)} ELSE {_linear_sql(WEIGHTS, BIAS)} END AS proba FROM s CROSS JOIN half)
    SELECT session_id, segment, "window", emitted, late, CAST(proba >= 0.5 AS INTEGER) AS prediction, round(greatest(proba, 1 - proba), 6) AS probability FROM p"""


def _versions(spark, sf_dir) -> DataFrame:
    """Two versions of each session's model: one from the beginning, one from the middle of the time of all samples."""
    samples = S.samples(spark, sf_dir)
    half = samples.agg(((F.min("ts") + F.max("ts")) / 2).alias("half"))
    model = lambda at, weights, bias: F.struct(at.alias("valid_from"), F.lit(list(weights)).alias("weights"), F.lit(bias).alias("bias"))
    each = samples.select("session_id").distinct().crossJoin(F.broadcast(half)).select("session_id", F.explode(F.array(model(F.lit(adapt.LONG_AGO), WEIGHTS, BIAS), model(F.col("half"), LATER, LATER_BIAS))).alias("m"))
    return each.select("session_id", "m.*", F.lit([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]).alias("filters"))


def _versioned(found: DataFrame) -> DataFrame:
    return found.select("session_id", "segment", "window", "emitted", (F.col("valid_from") > adapt.LONG_AGO).alias("late"), "prediction", F.round("probability", 6).alias("probability"))


@register(_VERSIONED)
def versioned_predictions(spark, sf_dir):
    """Recorded windows, each predicted by the version in force at its time."""
    windows = live.replay_windows(_clean(spark, sf_dir), S.markers(spark, sf_dir), settings(False))
    return _versioned(adapt.predict_versions(windows, 3, _versions(spark, sf_dir)))


@register(_VERSIONED)
def live_versioned_predictions(spark, sf_dir):
    """The same as a stream; its sink reads the versions with every batch."""
    root = f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}"
    _versions(spark, sf_dir).write.parquet(f"{root}/versions")
    sink = adapt.prediction_sink(f"{root}/out", 3, lambda session: session.read.parquet(f"{root}/versions"))
    _stream(spark, sf_dir).writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return _versioned(spark.read.parquet(f"{root}/out"))
