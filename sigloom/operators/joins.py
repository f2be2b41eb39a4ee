"""Joins: as-of, intervals, pairs, comparisons. Range work is turned into equi-joins on buckets or into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.aggregates import correlation


def asof_state(samples: DataFrame, states: DataFrame, value: str = "state", key: str = "session_id", ts: str = "ts", bucket: float = 3600.0, at_once: bool = False) -> DataFrame:
    """Each sample takes the last state set strictly before its time, or ``at_once`` then too (null before the first).

    Sessions are cut into stretches of ``bucket`` seconds, so that a long one is sorted by many tasks; what
    a stretch starts with comes from the states alone, which are few.
    """
    slot = lambda c: F.floor(F.col(c) / bucket).cast("long")
    marks = states.select(F.col(key), F.col(ts), F.col(value)).withColumn("__slot", slot(ts))
    last = marks.groupBy(key, "__slot").agg(F.max(F.struct(ts, value)).alias("__end"))
    stretches = samples.select(key, slot(ts).alias("__slot")).distinct()
    order = Window.partitionBy(key).orderBy("__slot", "__tag")
    ends = last.select(key, (F.col("__slot") + 1).alias("__slot"), F.lit(0).alias("__tag"), "__end").unionByName(stretches.select(key, "__slot", F.lit(1).alias("__tag"), F.lit(None).cast(last.schema["__end"].dataType).alias("__end")))
    opening = ends.withColumn("__open", F.last("__end", ignorenulls=True).over(order)).filter("__tag = 1").select(key, "__slot", F.col(f"__open.{value}").alias("__first"))
    tagged = samples.withColumns({"__slot": slot(ts), "__tag": F.lit(2 if at_once else 0), "__set": F.lit(None).cast(states.schema[value].dataType)})
    marked = marks.withColumn("__tag", F.lit(1)).withColumnRenamed(value, "__set")
    within = Window.partitionBy(key, "__slot").orderBy(ts, "__tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = tagged.unionByName(marked, allowMissingColumns=True).withColumn("__now", F.last("__set", ignorenulls=True).over(within)).filter("__tag <> 1")
    return merged.join(opening, [key, "__slot"]).withColumn(value, F.coalesce("__now", "__first")).select(*samples.columns, value)


def interval_join(samples: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket: int | None = None) -> DataFrame:
    """Samples inside [start, end) of an interval of their key: an equi-join on buckets of ``at``, then the exact test.

    A ``bucket`` is the intervals' mean length unless given, so that all together they are in at most three times as many buckets as there are intervals.
    """
    if bucket is None:
        mean = intervals.filter(F.col(end) > F.col(start)).agg(F.ceil(F.avg(F.col(end) - F.col(start)))).first()[0]
        bucket = max(1, int(mean or 1))
    spread = intervals.filter(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    keyed = samples.withColumn("__b", F.floor(F.col(at) / bucket))
    return keyed.join(spread, [key, "__b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def next_different(df: DataFrame, label: str, key: str = "subject_id", order: str = "idx") -> DataFrame:
    """Add ``end``: where the next event with another label starts; null if there is none."""
    w = Window.partitionBy(key).orderBy(order)
    runs = df.withColumn("__new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    starts = runs.filter("__new = 1").select(F.col(key), (F.col("__run") - 1).alias("__run"), F.col(order).alias("end"))
    return runs.join(starts, [key, "__run"], "left").drop("__new", "__run")


def merge_predictions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("subject_id", "sample_index")) -> DataFrame:
    """Rows that both models have; columns of the second that clash get ``_b``."""
    renamed = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in keys and c in a.columns})
    return a.join(renamed, list(keys), "inner")


def attach_metric(df: DataFrame, metrics: DataFrame, metric: str = "f1", key: str = "subject_id") -> DataFrame:
    """Left join of a metric; ``missing`` is true where there is none."""
    return df.join(metrics.select(key, metric), key, "left").withColumn("missing", F.col(metric).isNull())


def lookup_subject_matrix(df: DataFrame, matrices: DataFrame, key: str = "subject_id", least: int = 1, count: str = "n", kept: str | None = None) -> DataFrame:
    """Join each row's matrix; a subject without one, or fitted on fewer than ``least`` rows, fails the job. ``kept``: a column of
    ``matrices`` that later work reads (else ``count``): the check is part of it, or it would be pruned away."""
    found = df.join(matrices, key, "left")
    n = F.coalesce(F.col(count).cast("double"), F.lit(0.0))
    checked = F.assert_true(n >= least, F.concat(F.lit("no fitted matrix for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    name = kept or count
    return found.withColumn(name, F.when(checked.isNull(), F.col(name)))


def pairs_within(df: DataFrame, value: str, key: str = "subject_id", index: str = "i") -> DataFrame:
    """All pairs i < j within a subject, in square blocks of 256 rows, so a large subject is many join keys."""
    rows = df.select(key, F.col(index).alias("i"), F.col(value).alias("a")).withColumn("__p", F.floor(F.col("i") / 256))
    blocks = rows.groupBy(key).agg(F.max("__p").alias("__most"))
    dealt = rows.join(blocks, key)
    left = dealt.withColumn("__q", F.explode(F.sequence(F.col("__p"), F.col("__most")))).drop("__most")
    right = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__p")))).select(F.col(key), F.col("__o").alias("__p"), F.col("__p").alias("__q"), F.col("i").alias("j"), F.col("a").alias("b"))
    return left.join(right, [key, "__p", "__q"]).filter("i < j").select(key, "i", "j", "a", "b")


def neighbor_candidates(pairs: DataFrame, rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, test, candidate, d) of a distance table (i < j): other events only; a row without such takes all but itself.

    ``rows`` has key, ``i``, ``event_id``, ``label``.
    """
    both = pairs.select(key, F.col("i").alias("test"), F.col("j").alias("candidate"), "d").unionByName(pairs.select(key, F.col("j").alias("test"), F.col("i").alias("candidate"), "d"))
    of = lambda name, event, label: rows.select(key, F.col("i").alias(name), F.col("event_id").alias(event), F.col("label").alias(label))
    joined = both.join(of("test", "e1", "true_label"), [key, "test"]).join(of("candidate", "e2", "label"), [key, "candidate"])
    other = joined.withColumn("__other", F.max((F.col("e1") != F.col("e2")).cast("int")).over(Window.partitionBy(key, "test")))
    return other.filter((F.col("e1") != F.col("e2")) | (F.col("__other") == 0)).drop("__other", "e1", "e2")


def top_subject_filter(df: DataFrame, metrics: DataFrame, metric: str = "f1", n: int = 10, key: str = "subject_id") -> DataFrame:
    top = metrics.orderBy(F.desc(metric), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def compare_sequences(expected: DataFrame, actual: DataFrame, value: str = "state", key: str = "session_id") -> DataFrame:
    """Position by position, ignoring case; ``<no state>`` where one sequence has ended."""
    a, b = expected.select(key, "pos", F.col(value).alias("expected")), actual.select(key, "pos", F.col(value).alias("actual"))
    both = a.join(b, [key, "pos"], "full_outer")
    filled = both.select(key, "pos", *[F.coalesce(c, F.lit("<no state>")).alias(c) for c in ("expected", "actual")])
    return filled.withColumn("same", F.lower("expected") == F.lower("actual"))


def codes_match_config(markers: DataFrame, config: DataFrame, code: str = "code") -> DataFrame:
    """(code, ``in_data``, ``in_config``) of every code that only one side has; none means the sets are equal."""
    seen = markers.select(code).distinct().withColumn("in_data", F.lit(True))
    known = config.select(code).distinct().withColumn("in_config", F.lit(True))
    both = seen.join(known, code, "full_outer").fillna(False, ["in_data", "in_config"])
    return both.filter("NOT in_data OR NOT in_config")


def channel_power_precision(power: DataFrame, metrics: DataFrame, k: int, metric: str = "precision", key: str = "subject_id") -> DataFrame:
    """Attach a subject's metric at the chosen ``k``, else at its smallest other k; subjects without one go."""
    w = Window.partitionBy(key).orderBy((F.col("k") != k).cast("int"), "k")
    chosen = metrics.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(key, metric)
    return power.join(chosen, key, "inner")


def compare_preprocessing(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("subject_id", "channel", "idx"), value: str = "x") -> DataFrame:
    """Per subject and channel: correlation of two versions of a signal, their means and population deviations."""
    joined = a.join(b.withColumnRenamed(value, "__b"), list(keys))
    moments = [f(c).alias(f"{n}_{s}") for s, c in (("a", value), ("b", "__b")) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return joined.groupBy(*keys[:-1]).agg(F.count("*").alias("n"), correlation(value, "__b").alias("correlation"), *moments)


def warmup_rows(samples: DataFrame, annotations: DataFrame, warmup: list[str], rate: float, key: str = "subject_id", seconds: float = 30.0, bucket: int | None = None) -> DataFrame:
    """Samples from a warm-up event to the next event; for keys without such an event the first ``seconds``.

    Spans and samples meet by (key, stretch of ``bucket`` of the order, the samples of ``seconds`` unless given), so a key with many rows is many join keys. A last
    span ends where its key's samples do. Spans of a key do not overlap, so no sample comes twice.
    """
    w = Window.partitionBy(key).orderBy("idx")
    last = samples.groupBy(key).agg((F.max("idx") + 1).alias("__last"))
    spans = annotations.select(key, "idx", "description", F.lead("idx").over(w).alias("__next")).filter(F.col("description").isin(warmup))
    spans = spans.join(last, key).select(key, F.col("idx").alias("__start"), F.coalesce("__next", "__last").alias("__end"))
    marked = interval_join(samples, spans, key, "idx", "__start", "__end", bucket or max(1, int(seconds * rate))).select(*samples.columns)
    warm = annotations.filter(F.col("description").isin(warmup)).select(key).distinct()
    first = samples.join(warm, key, "left_anti").filter(F.col("idx") < int(seconds * rate))
    return marked.unionByName(first)
