"""What a live session learns: means that move with each accepted matrix, the general mean of all sessions, and models in versions."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.functions import linalg, matrix
from sigloom.operators.joins import asof_state
from sigloom.plans.evaluate import adapt_trajectory, logistic_fit
from sigloom.sources.staging import remove, stage

LONG_AGO = -1e15


@dataclass
class Moving:
    """A session's mean, the weight that it is of, and rows that the watermark has not passed yet."""

    mean: np.ndarray
    n: float
    waiting: list = field(default_factory=list)


def adapt_means_stream(covariances: DataFrame, start: np.ndarray, n: float, cap: float, weight: float = 1.0, delay: str = "10 seconds", idle: float = 86400.0) -> DataFrame:
    """(session_id, ts, cov, ``mean``, ``n``) of every accepted row of a stream of (session_id, ts in seconds, cov), in append mode: the state after it.

    A row is accepted while it does not lift ``n`` above ``cap``, and moves the mean by its share of the weight. Rows wait until the watermark passes them and are then
    taken in order, so their order of arrival within ``delay`` does not matter; older ones, and any at or before the epoch, are dropped. A session that gets nothing for ``idle``
    seconds of event time is forgotten and would start anew.
    """
    key, p = covariances.schema["session_id"].dataType.simpleString(), len(start)
    timed = covariances.select("session_id", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("at"), "ts", "cov").withWatermark("at", delay)

    def run(names, batches, state: GroupState):
        now = pickle.loads(state.get[0]) if state.exists else Moving(start, n)
        mark, out = state.getCurrentWatermarkMs() / 1000, []
        if not state.hasTimedOut:
            for rows in batches:
                now.waiting += [(ts, np.asarray(c, float)) for ts, c in zip(rows.ts, rows["cov"], strict=True) if ts >= mark]
        ready = sorted((r for r in now.waiting if r[0] <= mark or state.hasTimedOut), key=lambda r: (r[0], r[1].tolist()))
        held = bool(now.waiting)
        now.waiting = [r for r in now.waiting if not (r[0] <= mark or state.hasTimedOut)]
        for ts, c in ready:
            if now.n + weight <= cap:
                now.mean = linalg.geodesic(now.mean, c.reshape(p, p), weight / (now.n + weight))
                now.n += weight
                out.append((names[0], ts, c, now.mean.ravel(), now.n))
        if state.hasTimedOut and not held:
            state.remove()
        else:
            state.update((pickle.dumps(now),))
            last = max((r[0] for r in now.waiting), default=None)
            state.setTimeoutTimestamp(int(max(mark, last or mark) * 1000) + (1 if now.waiting else int(idle * 1000) + 1))
        yield pd.DataFrame(out, columns=["session_id", "ts", "cov", "mean", "n"])

    schema = f"session_id {key}, ts double, cov array<double>, mean array<double>, n double"
    return timed.groupBy("session_id").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass
class GeneralMean:
    """A sink that folds the accepted rows of all sessions into one general mean, each once.

    ``take(batch, number)`` is for ``foreachBatch``: it starts from what the batch before left and writes ``rows/batch=<number>`` (session_id, ts,
    ``general``, ``total`` after each row, by time) and its own state by the number, over what an earlier try has written. The fold is one ordered
    pass, as each step needs the one before: accepted rows of a batch stream through one task that holds two matrices.
    """

    path: str
    general: np.ndarray
    total: float
    weight: float = 1.0

    def _before(self, spark: SparkSession, number: int) -> tuple[np.ndarray, float]:
        if number == 0:
            return self.general, self.total
        held = spark.read.parquet(f"{self.path}/state/{number - 1}").first()
        return np.reshape(held["general"], self.general.shape), held["total"]

    def take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        general, total, weight = *self._before(spark, number), self.weight
        kind = batch.schema["session_id"].dataType.simpleString()

        def run(batches):
            mean, n = general, total
            for b in batches:
                means, totals = [], []
                for c in matrix.square(matrix.batch(b.column(2))) if b.num_rows else []:
                    mean = linalg.geodesic(mean, c, weight / (n + weight))
                    n += weight
                    means.append(mean.ravel())
                    totals.append(n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(means, pa.list_(pa.float64())), pa.array(totals, pa.float64())], ["session_id", "ts", "general", "total"])

        ordered = batch.select("session_id", "ts", "cov").repartition(1).sortWithinPartitions("ts", "session_id", "cov")
        ordered.mapInArrow(run, f"session_id {kind}, ts double, general array<double>, total double").write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        last = spark.read.parquet(f"{self.path}/rows/batch={number}").agg(F.max_by(F.struct("general", "total"), "total").alias("m")).first()["m"]
        after = (last["general"], last["total"]) if last else (general.ravel().tolist(), total)
        spark.createDataFrame([after], "general array<double>, total double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        if number > 1:
            remove(spark, f"{self.path}/state/{number - 2}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").select("session_id", "ts", "general", "total")


def predict_versions(windows: DataFrame, n_channels: int, versions: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Add ``prediction``, ``probability`` and ``valid_from`` to PREDICT windows, each by the model in force at its time; without one they are null.

    ``versions``: session_id, ``valid_from`` (seconds), ``filters`` (flat), ``weights``, ``bias``; of those of a session the last that is valid from the window's ``emitted`` or
    before is in force. ``states``: session_id, ``ts``, ``mean``, ``general``: the covariance moves by the last of these first. Both are as-of joins by session.
    """
    models = versions.select("session_id", F.col("valid_from").alias("ts"), F.struct("valid_from", "filters", "weights", "bias").alias("model"))
    asked = windows.filter("kind = 'window' AND action = 'PREDICT'").withColumn("ts", F.col("emitted"))
    met = asof_state(asked, models, "model", at_once=True).withColumn("__cov", matrix.covariance("sample", n_channels))
    if states is not None:
        met = asof_state(met, states.select("session_id", "ts", F.struct("mean", "general").alias("moved")), "moved", at_once=True)
        met = met.withColumn("__cov", F.when(F.col("moved.mean").isNull(), F.col("__cov")).otherwise(matrix.congruence(matrix.transport_matrix("moved.mean", "moved.general"), "__cov"))).drop("moved")
    features = matrix.filtered("model.filters", "__cov")
    score = F.aggregate(F.zip_with(features, "model.weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("model.bias")
    scored = met.withColumn("__p", 1 / (1 + F.exp(-score))).withColumn("valid_from", F.col("model.valid_from"))
    return scored.withColumns({"prediction": (F.col("__p") >= 0.5).cast("int"), "probability": F.greatest("__p", 1 - F.col("__p"))}).drop("__p", "__cov", "model", "ts")


def prediction_sink(path: str, n_channels: int, versions: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``predict_versions`` of each batch by the versions there are when it runs, written to ``path/batch=<number>`` over what an earlier try has written."""

    def take(batch: DataFrame, number: int) -> None:
        out = predict_versions(batch, n_channels, versions(batch.sparkSession))
        out.drop("sample").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


@dataclass
class Learner:
    """A sink for the windows of ``live_windows`` that learns from them and predicts, as ``foreachBatch(learner.take)`` or once over recorded windows.

    COLLECT_FOR_TRAIN windows are kept by session. A FIT window makes a version of its session's model, valid from its time: spatial filters and a logistic
    regression over the session's windows collected until then. A PARTIAL_FIT window moves its session's mean and that session's copy of the general mean. A
    PREDICT window gets the version and the means in force at its time, which include what other windows of that time have taught.

    Each batch writes its tables by its number over what an earlier try has written, and reads those of earlier numbers, so a batch that is run again changes nothing.
    Windows of a session must come in order of time from batch to batch, as ``live_windows`` gives them. Tables below ``path``: ``collected``,
    ``versions``, ``states``, ``predictions``.
    """

    path: str
    n_channels: int
    general: np.ndarray
    total: float = 1.0
    cap: float = float("inf")
    filters: int = 2
    weight: float = 1.0

    def _read(self, spark: SparkSession, table: str, before: int, schema: str) -> DataFrame:
        parts = [f"{self.path}/{table}/batch={k}" for k in range(before)]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        path = f"{self.path}/{table}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = batch.schema["session_id"].dataType.simpleString()
        # A batch is worked out once, whatever reads it.
        windows = stage(batch.filter("kind = 'window'"), "batch")
        own = windows.withColumn("cov", matrix.covariance("sample", self.n_channels))
        states = self._states(own, key, number)
        new = self._write(own.filter("action = 'COLLECT_FOR_TRAIN' AND label IS NOT NULL").select("session_id", "emitted", F.col("label").cast("int").alias("label"), "cov"), "collected", number)
        collected = self._read(spark, "collected", number, f"session_id {key}, emitted double, label int, cov array<double>").unionByName(new)
        fits = stage(own.filter("action = 'FIT'").select("session_id", F.col("emitted").alias("valid_from")).distinct(), "fits")
        schema = f"session_id {key}, valid_from double, filters array<double>, weights array<double>, bias double"
        made = self._fitted(fits, collected, states) if not fits.isEmpty() else spark.createDataFrame([], schema)
        versions = self._read(spark, "versions", number, schema).unionByName(self._write(made, "versions", number))
        told = predict_versions(windows, self.n_channels, versions, states)
        self._write(told.select("session_id", "segment", "window", "emitted", "label", "prediction", "probability", "valid_from"), "predictions", number)

    def _states(self, own: DataFrame, key: str, number: int) -> DataFrame:
        """(session_id, ts, mean, general, n, total): the states that this batch starts from, and those after each of its PARTIAL_FIT windows."""
        spark = own.sparkSession
        schema = f"session_id {key}, ts double, mean array<double>, general array<double>, n double, total double"
        last = self._read(spark, "last-states", number, schema) if number == 0 else spark.read.schema(schema).parquet(f"{self.path}/last-states/batch={number - 1}")
        rows = stage(own.filter("action = 'PARTIAL_FIT'").select("session_id", F.struct(F.col("emitted").alias("ts"), "segment", "window").alias("at"), "cov"), "partial-fit")
        flat = self.general.ravel().tolist()
        known = last.select(F.col("session_id").alias("__s"), "mean", "general", "n", "total")
        first = rows.select("session_id").distinct().join(known, F.col("session_id") == F.col("__s"), "left")
        starts = first.select(
            "session_id", F.coalesce("general", F.lit(flat)).alias("general"), F.coalesce("total", F.lit(self.total)).alias("total"), F.lit(self.cap).alias("cap"), "mean", "n"
        )
        after = adapt_trajectory(rows, stage(starts, "starts"), key="session_id", order="at", weight=self.weight).filter("mean IS NOT NULL")
        after = stage(after.groupBy("session_id", F.col("at.ts").alias("ts")).agg(F.max_by(F.struct("mean", "general", "n", "total"), "at").alias("m")).select("session_id", "ts", "m.mean", "m.general", "m.n", "m.total"), "states")
        every = last.unionByName(after)
        newest = every.groupBy("session_id").agg(F.max_by(F.struct("ts", "mean", "general", "n", "total"), "ts").alias("m")).select("session_id", "m.*")
        self._write(newest, "last-states", number)
        self._write(after, "states", number)
        return every.select("session_id", "ts", "mean", "general")

    def _fitted(self, fits: DataFrame, collected: DataFrame, states: DataFrame) -> DataFrame:
        """A version per fit, over its session's windows until then, moved by the means of that time."""
        placed = asof_state(fits.withColumn("ts", F.col("valid_from")), states.select("session_id", "ts", F.struct("mean", "general").alias("moved")), "moved", at_once=True)
        placed = placed.select(F.col("session_id").alias("__s"), "valid_from", "moved", F.concat_ws("@", F.col("session_id").cast("string"), F.col("valid_from").cast("string")).alias("fit"))
        rows = collected.join(placed, (F.col("session_id") == F.col("__s")) & (F.col("emitted") <= F.col("valid_from")))
        cov = F.when(F.col("moved.mean").isNull(), F.col("cov")).otherwise(matrix.congruence(matrix.transport_matrix("moved.mean", "moved.general"), "cov"))
        rows = stage(rows.select("fit", "label", cov.alias("cov")), "train")
        found = stage(matrix.csp_fit(rows, ["fit"], self.filters).select(F.col("fit").alias("__fit"), "filters"), "csp")
        featured = stage(rows.join(found, F.col("fit") == F.col("__fit")).select("fit", "label", matrix.filtered("filters", "cov").alias("x")), "features")
        size = self.filters
        betas = logistic_fit(featured, "fit", "x", "label", size).select(F.col("fit").alias("__b"), "beta")
        met = placed.join(found, F.col("fit") == F.col("__fit")).join(betas, F.col("fit") == F.col("__b"))
        return met.select(F.col("__s").alias("session_id"), "valid_from", "filters", F.slice("beta", 1, size).alias("weights"), F.element_at("beta", size + 1).alias("bias"))

    def predictions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/predictions").drop("batch")

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/versions").drop("batch")
