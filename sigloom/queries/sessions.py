"""Sources and sinks: the driver's tables written in the library's layouts and read back, each with the SQL of what must come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import matrix
from sigloom.operators import joins as J
from sigloom.operators import projections as P
from sigloom.operators import windows as W
from sigloom.queries import relational as R
from sigloom.queries import standins as S
from sigloom.queries import two_channels as T
from sigloom.queries.signal import HOURLY, hourly
from sigloom.sources import tables
from sigloom.sources.staging import shared_dir, stage
from sigloom.streaming import adapt, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SAMPLES = f"WITH {S.SAMPLES_SQL}"
MARKED = f"WITH {S.SAMPLES_SQL}, {S.MARKERS_SQL}"
EPOCHS = f"WITH {S.EPOCHS_SQL}"
_ROWS = "CAST(session_id AS VARCHAR) AS session_id, idx, ts, [CASE WHEN isnan(v) THEN 0 ELSE v END, k, ref] AS x"


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _samples(spark, sf_dir) -> DataFrame:
    s = S.samples(spark, sf_dir).withColumn("x", F.transform("x", lambda v: F.nanvl(v, F.lit(0.0))))
    return s.select(F.col("session_id").cast("string").alias("session_id"), "idx", "ts", "x", "event_id")


@register(f"{SAMPLES} SELECT {_ROWS} FROM samples")
def read_samples(spark, sf_dir):
    path = _path(spark, "samples")
    _samples(spark, sf_dir).write.parquet(path)
    return tables.read_samples(spark, path)


@register(f"{SAMPLES} SELECT {_ROWS} FROM samples")
def stream_samples(spark, sf_dir):
    """As a stream of files, a few at a time, to its end."""
    path = _path(spark, "samples")
    _samples(spark, sf_dir).repartition(4).write.parquet(f"{path}/in")
    stream = tables.stream_samples(spark, f"{path}/in")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@register(f"{SAMPLES} SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, unnest([0, 1, 2]) AS pos, unnest(['value', 'k', 'ref']) AS label FROM samples")
def read_channels(spark, sf_dir):
    path = _path(spark, "channels")
    sessions = _samples(spark, sf_dir).select("session_id").distinct()
    sessions.select("session_id", F.posexplode(F.array(*[F.lit(c) for c in S.CHANNELS])).alias("pos", "label")).write.json(path)
    return tables.read_channels(spark, path, "json")


@register(f"{MARKED} SELECT CAST(session_id AS VARCHAR) AS session_id, ts, code FROM markers")
def read_markers(spark, sf_dir):
    """Raw payloads, whose code comes second."""
    path = _path(spark, "markers")
    m = S.markers(spark, sf_dir)
    m.select(F.col("session_id").cast("string").alias("session_id"), "ts", F.array(F.lit(0), F.col("code")).alias("payload")).write.parquet(path)
    return tables.read_markers(spark, path)


@register(f"{SAMPLES} SELECT 'name=' || session_id AS session_id, CAST(idx AS INTEGER) AS pos, event_type AS sample_type FROM samples")
def read_task_json(spark, sf_dir):
    """A script per session, in the session's folder."""
    path = _path(spark, "tasks")
    s = S.samples(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "event_type"))), lambda v: F.struct(v["event_type"].alias("sample_type")))
    scripts = s.groupBy(F.col("session_id").alias("name")).agg(F.to_json(F.struct(ordered.alias("samples"))).alias("value"))
    scripts.write.partitionBy("name").text(path)
    return tables.read_task_json(spark, f"{path}/*")


@register(f"{SAMPLES} SELECT 'session=' || session_id AS session_id, count(*) FILTER (event_type = 'error') > 0 AS complete FROM samples GROUP BY session_id")
def discover_sessions(spark, sf_dir):
    """Folders with samples, and with errors too where a session has some.

    A session's files are one task's, and there are as many tasks as shuffles have: files are few bytes and much work, so their sizes must not bring the tasks together.
    """
    path = f"{_path(spark, 'sessions')}/root"
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("samples"), F.lit("errors"))).otherwise(F.array(F.lit("samples")))
    rows = S.samples(spark, sf_dir).select(F.col("session_id").alias("session"), F.explode(kinds).alias("kind"), "ts")
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session").write.partitionBy("session", "kind").csv(path)
    return tables.discover_sessions(spark, path, ("kind=samples", "kind=errors"))


@register(f"{EPOCHS} SELECT vec_id, subject_id, label, 4 AS n_channels, 16 AS n_times, sample FROM epochs")
def epochs_round_trip(spark, sf_dir):
    path = _path(spark, "epochs")
    tables.write_epochs(S.epochs(spark, sf_dir), path)
    back = tables.read_epochs(spark, path, ["label"])
    return back.select("vec_id", F.col("subject_id").cast("long").alias("subject_id"), "label", "n_channels", "n_times", "sample")


@register(f"{EPOCHS} SELECT vec_id, label FROM epochs WHERE NOT is_background")
def calibrated_cache(spark, sf_dir):
    """Saved by one run, used by the next whatever its own rows are."""
    path, rows = _path(spark, "cache"), P.drop_background(S.epochs(spark, sf_dir)).select("vec_id", "label")
    tables.calibrated_cache(rows, path, use=True, save=True)
    return tables.calibrated_cache(rows.limit(0), path, use=True, save=True)


@register(f"{R.METRICS} SELECT * FROM metrics")
def metrics_csv(spark, sf_dir):
    path = _path(spark, "metrics")
    tables.write_metrics_csv(R.rounded(R.subject_metrics(spark, sf_dir), *R.RATE_NAMES), path)
    return tables.read_metrics_csv(spark, path, "subject_id long, num_samples long, accuracy double, precision double, recall double, f1 double")


@register(f"{T.POOLED} SELECT subject_id, CAST(n AS DOUBLE) AS n, {T.cut_sql('wia', 'wib', 'wib', 'wid')} AS whitening FROM pooled")
def model_round_trip(spark, sf_dir):
    """A fitted step's tables, saved and loaded."""
    path = _path(spark, "model")
    tables.save_model({"whitening": matrix.pooled_covariance(S.epochs(spark, sf_dir, 2).filter("is_background"), ["subject_id"], 2)}, path)
    model = tables.load_model(spark, path, {"whitening": ["subject_id", "whitening", "n"]})["whitening"]
    return model.select("subject_id", "n", T.cut("whitening").alias("whitening"))


CONFIG = {
    "initial_state": "Rest",
    "states": {
        "Rest": {"label": 0, "group": "r", "transitions": {3: "Imagery"}, "exit_actions": [{"action": "COLLECT_FOR_TRAIN"}]},
        "Imagery": {"label": 1, "group": "i", "transitions": {2: "Rest", 4: "Point"}, "entry_actions": [{"action": "PREDICT", "delay_seconds": 1}], "transition_actions": {"Point": [{"action": "FIT", "group": "r"}]}},
        "Point": {"label": 1, "group": "i", "transitions": {2: "Rest"}},
    },
    "windowing": [{"window_size": 3, "action": "PREDICT", "window_step": 1}],
}


@register(
    f"""{MARKED}, transitions(state, code, next) AS (VALUES ('Rest', 3, 'Imagery'), ('Imagery', 2, 'Rest'), ('Imagery', 4, 'Point'), ('Point', 2, 'Rest')),
    states(state, class_label, grp) AS (VALUES ('Rest', 0, 'r'), ('Imagery', 1, 'i'), ('Point', 1, 'i')),
    actions(trigger, action, grp, delay) AS (VALUES ('exit:Rest', 'COLLECT_FOR_TRAIN', 'r', 0.0), ('entry:Imagery', 'PREDICT', 'i', 1.0), ('transition:Imagery:Point', 'FIT', 'r', 0.0)),
    seen AS (SELECT t.*, count(*) AS n FROM transitions t JOIN markers m USING (code) GROUP BY ALL)
    SELECT state, code, next, class_label, states.grp AS grp, n, action, actions.grp AS action_grp, CAST(delay AS DOUBLE) AS delay FROM seen JOIN states USING (state)
    LEFT JOIN actions ON trigger IN ('exit:' || state, 'entry:' || next, 'transition:' || state || ':' || next)"""
)
def state_machine_tables(spark, sf_dir):
    """A configuration as tables, met with the markers: how often each transition's code comes, and what it sets off; actions fall back to their state's group."""
    machine, actions, windowing = tables.parse_state_machine(CONFIG)
    dims = tables.dimension_tables(spark, machine, actions, windowing)
    seen = S.markers(spark, sf_dir).join(F.broadcast(dims["transitions"]), "code").groupBy("state", "code", "next").agg(F.count("*").alias("n"))
    fired = seen.join(dims["states"], "state").withColumn("trigger", F.explode(F.array(F.concat(F.lit("exit:"), "state"), F.concat(F.lit("entry:"), "next"), F.concat_ws(":", F.lit("transition"), "state", "next"))))
    named = dims["actions"].withColumnRenamed("grp", "action_grp")
    joined = fired.join(named, "trigger", "left")
    some = joined.filter("action IS NOT NULL")
    none = seen.join(dims["states"], "state").join(some.select("state", "code").distinct(), ["state", "code"], "left_anti")
    out = some.drop("trigger").unionByName(none, allowMissingColumns=True)
    return out.select("state", "code", "next", "class_label", "grp", "n", "action", "action_grp", "delay")


@register(f"{T.POOLED} SELECT vec_id, epochs.subject_id, CAST(n AS DOUBLE) AS n FROM epochs JOIN pooled USING (subject_id)")
def lookup_subject_matrix(spark, sf_dir):
    epochs = S.epochs(spark, sf_dir, 2)
    fitted = matrix.pooled_covariance(epochs.filter("is_background"), ["subject_id"], 2)
    return J.lookup_subject_matrix(epochs, fitted, least=32).select("vec_id", "subject_id", "n")


@register(f"{SAMPLES} SELECT session_id, event_id, CAST(trunc(((ts - min(ts) OVER (PARTITION BY session_id)) * 250)) AS BIGINT) AS sample FROM samples")
def seconds_to_samples(spark, sf_dir):
    s = S.samples(spark, sf_dir)
    first = s.groupBy("session_id").agg(F.min("ts").alias("first"))
    return s.join(first, "session_id").select("session_id", "event_id", P.seconds_to_samples(F.col("ts") - F.col("first"), 250.0).alias("sample"))


_SPAN = 100_000_000


@register(
    f"""{HOURLY}, x AS (SELECT h.subject_id, h.idx, s.k AS a, s.ref AS b FROM hourly h JOIN samples s ON s.session_id = h.subject_id AND s.event_id = h.event_id),
    w AS (SELECT subject_id, event_id AS of_event, label, unnest(range(idx, "end" - {_SPAN} + 1, {_SPAN})) AS start FROM ended WHERE "end" - {_SPAN} >= idx)
    SELECT w.subject_id, of_event, label, start, start + {_SPAN} AS "end", 2 AS n_channels, CAST(count(*) AS INTEGER) AS n_times, list_concat(list(a ORDER BY x.idx), list(b ORDER BY x.idx)) AS sample
    FROM w JOIN x ON x.subject_id = w.subject_id AND x.idx >= start AND x.idx < start + {_SPAN} GROUP BY ALL"""
)
def epochs_from_events(spark, sf_dir):
    h = hourly(spark, sf_dir)
    s = S.samples(spark, sf_dir).select(F.col("session_id").alias("subject_id"), "event_id", F.slice("x", 2, 2).alias("x"))
    windows = W.event_windows(h, "label", 1, 0, _SPAN, _SPAN).select("subject_id", F.col("event_id").alias("of_event"), "label", "start", "end")
    return W.epochs_from_events(h.select("subject_id", "event_id", "idx").join(s, ["subject_id", "event_id"]).select("subject_id", "idx", "x"), windows)


def _adapted(spark, sf_dir, general) -> tuple[DataFrame, str]:
    """Accepted rows of a stream of covariances that come in three files, out of order; a last file moves the watermark past all."""
    rows = T.staged2(spark, sf_dir).select(F.col("subject_id").alias("session_id"), (F.col("i") + 1).cast("double").alias("ts"), "cov")
    path = _path(spark, "covariances")
    for k in (2, 0, 1):
        rows.filter(F.col("ts") % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows.limit(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(30 * 86400.0).alias("ts"), "cov").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("session_id long, ts double, cov array<double>").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return adapt.adapt_means_stream(stream, np.reshape(general["mean"], (2, 2)), 1.0, float(general["cap"]), delay="1 day", idle=365 * 86400.0).filter("session_id >= 0"), path


@register(T.ORACLE_SQL["adapt_means_2ch"])
def adapt_means_live_2ch(spark, sf_dir):
    """The adaptation as a stream of covariances: the state of every session after its last accepted row."""
    general = matrix.general_mean(stage(matrix.subject_means(T.staged2(spark, sf_dir)), "means")).first()
    adapted, path = _adapted(spark, sf_dir, general)
    adapted.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(adapted.schema).parquet(f"{path}/out").groupBy(F.col("session_id").alias("subject_id")).agg(F.max_by(F.struct("mean", "n"), "n").alias("m"))
    return out.select("subject_id", T.cut("m.mean", 6).alias("mean"), "m.n")


# Rows that sessions accept, one after another by time and session, move the general mean, which begins as that of all rows.
@register(
    f"""{T.GENERAL}, cap AS (SELECT floor(avg(n)) AS cap FROM mean), seen AS MATERIALIZED (SELECT subject_id, i, s00, s01, s11, row_number() OVER (ORDER BY i, subject_id) - 1 AS place FROM cov CROSS JOIN cap WHERE i + 2 <= cap.cap),
    walk AS (SELECT CAST(-1 AS BIGINT) AS subject_id, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS place, a, b, d, CAST(n AS DOUBLE) AS n FROM general
        UNION ALL SELECT subject_id_1, i_1, place_1, z00, z01, z11, n + 1 FROM ({T.geodesic_sql('SELECT walk.*, seen.subject_id AS subject_id_1, seen.i AS i_1, seen.place AS place_1, s00, s01, s11 FROM walk JOIN seen ON seen.place = walk.place + 1', 'p', '(1 / (n + 1))', ('a', 'b', 'd'), 'z')}))
    SELECT subject_id, CAST(i + 1 AS DOUBLE) AS ts, {T.cut_sql('a', 'b', 'b', 'd', digits=5)} AS general, n AS total FROM walk WHERE place >= 0"""
)
def general_mean_live_2ch(spark, sf_dir):
    """The general mean after each row that a session of the stream accepts."""
    general = matrix.general_mean(stage(matrix.subject_means(T.staged2(spark, sf_dir)), "means")).first()
    adapted, path = _adapted(spark, sf_dir, general)
    sink = adapt.GeneralMean(f"{path}/general", np.reshape(general["mean"], (2, 2)), float(general["n"]))
    adapted.writeStream.foreachBatch(sink.take).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.rows(spark).select(F.col("session_id").alias("subject_id"), "ts", T.cut("general", 5).alias("general"), "total")
