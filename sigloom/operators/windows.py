"""Segments, count-based windows, runs, splits by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.aggregates import ratio
from sigloom.operators.joins import interval_join, next_different
from sigloom.operators.stretches import row_numbers, running_sums, runs_along
from sigloom.sources.staging import stage


def segments(df: DataFrame, group: str = "grp", key: str = "session_id", order: str = "idx", at: str | None = None) -> DataFrame:
    """Rows with a group, and ``segment`` (from 1): a new one whenever the row before has another group or none; ``at``: a name for the row's number (from 0) in its segment.

    A session is cut into stretches of ``order`` (numeric), so a long one is many tasks.
    """
    place = at or "__segment_at"
    told = runs_along(df, [key], order, F.col(group), "segment", place).filter(F.col(group).isNotNull())
    return told if at else told.drop(place)


def sliding_windows(
    df: DataFrame, size: int, step: int, by: tuple[str, ...] = ("session_id", "segment"), order: str = "idx", ts: str = "ts", collect: dict[str, str] | None = None, at: str | None = None
) -> DataFrame:
    """Complete windows of ``size`` rows, every ``step`` rows from the start of each segment.

    One row per window: keys, ``window`` (from 0), ``start_timestamp``, ``end_timestamp`` and, per entry of
    ``collect``, an array of that column in order. ``at``: a column that has the row's number in its segment already (see ``segments``); without it
    rows are numbered in stretches of ``order`` (numeric). A window is its own group, so segments of any length are spread; each row is copied size / step times.
    """
    numbered = df.withColumn("__at", F.col(at)) if at else row_numbers(df, list(by), order, "__at")
    numbered = numbered.select(*dict.fromkeys([*by, ts, *(collect or {}).values()]), "__at")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__at") - size + 1) / step))
    last = F.floor(F.col("__at") / step)
    spread = numbered.filter(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    kept = [F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(c).alias("v")))), lambda s: s["v"]).alias(name) for name, c in (collect or {}).items()]
    out = spread.groupBy(*by, "window").agg(F.count("*").alias("__n"), F.min(ts).alias("start_timestamp"), F.max(ts).alias("end_timestamp"), *kept)
    return out.filter(F.col("__n") == size).drop("__n")


def event_windows(annotations: DataFrame, label: str, rate: float = 1.0, delay: float = 1, size: float = 3, step: float = 3, key: str = "subject_id") -> DataFrame:
    """Windows [``start``, ``end``) from ``delay`` after an event to the next event with another label; events without one give none.

    Consecutive events with the same label each reach to the same end, so their windows may overlap.
    """
    ends = next_different(annotations, label, key).filter("end IS NOT NULL")
    d, s, t = (int(x * rate) for x in (delay, size, step))
    room = ends.filter(F.col("end") - s >= F.col("idx") + d)
    starts = room.withColumn("start", F.explode(F.sequence(F.col("idx") + d, F.col("end") - s, F.lit(t).cast("long"))))
    return starts.withColumn("end", F.col("start") + s)


def event_subwindows(annotations: DataFrame, rate: float, delay: float = 1, size: float = 1, step: float = 0.8, key: str = "subject_id") -> DataFrame:
    """Windows from ``delay`` after an event to the next event of any kind."""
    d, s, t = (int(x * rate) for x in (delay, size, step))
    ends = annotations.withColumn("__next", F.lead("idx").over(Window.partitionBy(key).orderBy("idx")))
    room = ends.filter(F.col("__next") - s >= F.col("idx") + d)
    return room.withColumn("start", F.explode(F.sequence(F.col("idx") + d, F.col("__next") - s, F.lit(t).cast("long")))).withColumn("end", F.col("start") + s).drop("__next")


def epochs_from_events(samples: DataFrame, windows: DataFrame, key: str = "subject_id", x: str = "x") -> DataFrame:
    """One row per event window: its samples as a flat channels x times matrix."""
    names = [c for c in windows.columns if c not in (key, "start", "end")]
    rows = interval_join(samples, windows, key, "idx" if "idx" not in names else "at", "start", "end")
    at = "idx" if "idx" not in names else "at"
    per = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(x).alias("x"))))
    grouped = rows.groupBy(key, "start", "end", *names).agg(per.alias("__s"))
    channels = F.size(F.col("__s")[0]["x"])
    flat = F.flatten(F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.transform("__s", lambda s: s["x"][c])))
    return grouped.withColumns({"n_channels": channels, "n_times": F.size("__s"), "sample": flat}).drop("__s")


def first_background_only(annotations: DataFrame, label: str, background: Column, key: str = "subject_id") -> DataFrame:
    """All other events, and of the background events with a following different event the first."""
    ends = next_different(annotations, label, key)
    usable = background & F.col("end").isNotNull()
    rank = F.row_number().over(Window.partitionBy(key, usable.cast("int")).orderBy("idx"))
    return ends.withColumns({"__u": usable, "__r": rank, "__b": background}).filter("NOT __b OR (__u AND __r = 1)").drop("__u", "__r", "__b")


def missing_flag(x: str = "x") -> Column:
    return F.exists(x, lambda v: v.isNull() | F.isnan(v))


def runs(df: DataFrame, flag: Column, key: str = "session_id", order: str = "idx") -> DataFrame:
    """Maximal runs of equal ``flag``: key, ``run``, ``flag``, ``start``, ``end`` (inclusive), ``rows``; a key is cut into stretches of ``order``."""
    flagged = df.select(key, order, flag.alias("flag"))
    return runs_along(flagged, [key], order, F.col("flag"), "run", "__run_at").groupBy(key, "run", "flag").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("rows"))


def valid_runs(df: DataFrame, **names) -> DataFrame:
    return runs(df, missing_flag(), **names).filter("NOT flag").drop("flag")


def missing_runs(df: DataFrame, **names) -> DataFrame:
    return runs(df, missing_flag(), **names).filter("flag").drop("flag")


def longest_run(df: DataFrame, key: str = "session_id", **names) -> DataFrame:
    """Each key's longest run without missing values; the first of equals."""
    w = Window.partitionBy(key).orderBy(F.desc("rows"), "start")
    return valid_runs(df, key=key, **names).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def crop_to_longest_run(df: DataFrame, key: str = "session_id", order: str = "idx") -> DataFrame:
    kept = longest_run(df, key, order=order).select(key, "start", "end")
    return df.join(kept, key).filter(F.col(order).between(F.col("start"), F.col("end"))).drop("start", "end")


def pair_consecutive(df: DataFrame, value: str, score: str, key: str = "subject_id", order: str = "i") -> DataFrame:
    """Rows 2p and 2p + 1 as one: ``first``, ``second`` and the second's ``score``; an odd row at the end goes."""
    numbered = df.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    half = numbered.withColumns({"pair_index": F.floor(F.col("__at") / 2), "__odd": F.col("__at") % 2 == 1})
    pick = lambda c, odd: F.max(F.when(F.col("__odd") == odd, F.struct(c))).getField(c)
    return half.groupBy(key, "pair_index").agg(F.count("*").alias("__n"), pick(value, False).alias("first"), pick(value, True).alias("second"), pick(score, True).alias("score")).filter("__n = 2").drop("__n")


def sample_index(df: DataFrame, order: list[str], key: str = "subject_id", name: str = "sample_index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def calibration_split(df: DataFrame, fraction: float = 0.1, key: str = "subject_id", label: str = "true_label", order: str = "sample_index") -> DataFrame:
    """Add ``calibration``: true for the first max(1, floor(fraction * n)) rows of each label and subject."""
    rank = F.row_number().over(Window.partitionBy(key, label).orderBy(order))
    sizes = df.groupBy(key, label).agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * fraction)).alias("__take"))
    return df.withColumn("__r", rank).join(sizes, [key, label]).withColumn("calibration", F.col("__r") <= F.col("__take")).drop("__r", "__take")


def calibrate_threshold(df: DataFrame, by: list[str], target: float = 0.9, stat: str = "specificity", score: str = "proba", true: str = "true_label") -> DataFrame:
    """The observed score at which the statistic of ``score >= threshold`` is nearest to ``target``; the lowest wins ties, 0.5 without rows.

    Scores are counted, and running sums over the distinct ones give every threshold's cells in one sort.
    """
    tallies = df.groupBy(*by, score).agg(F.count_if(F.col(true) == 1).alias("__p"), F.count_if(F.col(true) != 1).alias("__n"))
    below, every = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    fn, tn = (F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("__p", "__n"))
    cells = tallies.select(*by, score, fn.alias("fn"), tn.alias("tn"), F.sum("__p").over(every).alias("pos"), F.sum("__n").over(every).alias("neg"))
    tp = F.col("pos") - F.col("fn")
    value = ratio(F.col("tn"), F.col("neg")) if stat == "specificity" else ratio(2 * tp, 2 * tp + F.col("neg") - F.col("tn") + F.col("fn"))
    chosen = cells.withColumn(stat, value).groupBy(*by).agg(F.min_by(F.struct(score, stat), F.struct(F.abs(F.col(stat) - target), F.col(score))).alias("m"))
    return chosen.select(*by, F.coalesce(f"m.{score}", F.lit(0.5)).alias("threshold"), F.col(f"m.{stat}").alias(stat))


def evaluation_minus_calibration(df: DataFrame, calibration: DataFrame, keys: tuple[str, ...] = ("subject_id", "sample_index")) -> DataFrame:
    return df.join(calibration.select(*keys), list(keys), "left_anti")


def time_fraction(df: DataFrame, key: str = "subject_id", order: str = "i") -> DataFrame:
    """Add ``fraction`` (0..1 by order) and ``weight`` (0.2..1)."""
    return df.withColumn("fraction", F.percent_rank().over(Window.partitionBy(key).orderBy(order))).withColumn("weight", 0.2 + 0.8 * F.col("fraction"))


def temporal_distance_fused(pairs: DataFrame, alpha: float = 0.5, key: str = "subject_id") -> DataFrame:
    """Add ``fused``: alpha times the distance and the rest times |i - j|, laid over the distances' range."""
    gap = F.abs(F.col("j") - F.col("i")).cast("double")
    # Staged, so that the join knows how few they are and no pair moves for it.
    ends = stage(pairs.groupBy(key).agg(F.min("d").alias("__a"), F.max("d").alias("__b"), F.min(gap).alias("__c"), F.max(gap).alias("__d")), "pair-ends")
    moved = F.col("__a") + ratio(gap - F.col("__c"), F.col("__d") - F.col("__c")) * (F.col("__b") - F.col("__a"))
    return pairs.join(ends, key).withColumn("fused", alpha * F.col("d") + (1 - alpha) * moved).drop("__a", "__b", "__c", "__d")


def hybrid_sweep(df: DataFrame, index: str = "sample_index", a: str = "predicted_label", b: str = "predicted_b", true: str = "true_label") -> DataFrame:
    """For every N: model A for the first N rows of each subject, B for the rest; support-weighted f1 over all rows.

    Rows are counted by index; prefix sums over the indexes, stretch by stretch, give the cells of every N.
    """
    t, one = F.col(true), F.lit(1)
    cell = lambda c, k, p: F.sum(((t == k) & (F.col(c) == p)).cast("long"))
    # One row an index: what is read several times from here on is that table, not the input.
    per = stage(df.groupBy(index).agg(*[cell(c, k, p).alias(f"{n}{k}{p}") for n, c in (("a", a), ("b", b)) for k in (0, 1) for p in (0, 1)]), "sweep")
    names = [c for c in per.columns if c != index]
    start = per.agg(F.lit(-1).cast("long").alias(index), *[F.lit(0).cast("long").alias(c) for c in names], F.count("*").alias("__n")).filter("__n > 0").drop("__n")
    rows = per.withColumn(index, F.col(index).cast("long")).unionByName(start)
    upto = running_sums(rows, [], index, {f"__{c}": F.col(c) for c in names})
    every = per.agg(*[F.sum(c).alias(f"__all_{c}") for c in names if c[0] == "b"])
    mixed = upto.crossJoin(F.broadcast(every)).select((F.col(index) + one).alias("n"), *[(F.col(f"__a{k}{p}") + F.col(f"__all_b{k}{p}") - F.col(f"__b{k}{p}")).alias(f"c{k}{p}") for k in (0, 1) for p in (0, 1)])
    c = lambda k, p: F.col(f"c{k}{p}")
    f1 = lambda k: ratio(2 * c(k, k), 2 * c(k, k) + c(k, 1 - k) + c(1 - k, k))
    support = lambda k: c(k, 0) + c(k, 1)
    total = support(0) + support(1)
    return mixed.select("n", ((c(0, 0) + c(1, 1)) / total).alias("accuracy"), ((support(0) * f1(0) + support(1) * f1(1)) / total).alias("f1"))


def hybrid_predictions(df: DataFrame, n: int, index: str = "sample_index", a: str = "predicted_label", b: str = "predicted_b") -> DataFrame:
    return df.withColumn("hybrid_label", F.when(F.col(index) < n, F.col(a)).otherwise(F.col(b)))


def best_n(sweep: DataFrame) -> DataFrame:
    """The N with the largest f1; the smallest of equals."""
    return sweep.orderBy(F.desc("f1"), "n").limit(1)


def top_subjects(metrics: DataFrame, metric: str = "f1", n: int = 10, key: str = "subject_id") -> DataFrame:
    return metrics.orderBy(F.desc(metric), key).limit(n)


def top_channel_filters(df: DataFrame, n: int = 10, value: str = "correlation") -> DataFrame:
    return df.orderBy(F.desc(F.abs(F.col(value))), "channel", "filter").limit(n)


def rank_subjects(metrics: DataFrame, metric: str = "f1", key: str = "subject_id") -> DataFrame:
    """Subjects in order of a metric, with ``position`` (equal values share one); a row per subject only."""
    return metrics.withColumn("position", F.dense_rank().over(Window.orderBy(F.desc(metric)))).orderBy(F.desc(metric), key)


def nearest_k(candidates: DataFrame, k: int, by: tuple[str, ...] = ("subject_id", "test")) -> DataFrame:
    """The ``k`` nearest candidates of each test row (all, if fewer); ties to the smaller candidate."""
    w = Window.partitionBy(*by).orderBy("d", "candidate")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_vote(neighbours: DataFrame, weighted: bool = False, by: tuple[str, ...] = ("subject_id", "test")) -> DataFrame:
    """Majority label of each test row, or the largest sum of inverse distances; ties to the smallest label."""
    score = F.sum(F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(F.lit(1e300))) if weighted else F.count("*").cast("double")
    votes = neighbours.groupBy(*by, "true_label", "label").agg(score.alias("__v"))
    best = votes.groupBy(*by, "true_label").agg(F.max(F.struct("__v", (-F.col("label")).alias("m"))).alias("b"))
    return best.select(*by, "true_label", (-F.col("b.m")).alias("predicted_label"))


def merge_streams(samples: DataFrame, markers: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """One time-ordered stream per session; at the same time samples come before markers (``tag`` 0 and 1)."""
    both = samples.withColumn("tag", F.lit(0)).unionByName(markers.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return both.repartition(key).sortWithinPartitions(key, ts, "tag")


def event_vocabulary(*events: DataFrame, name: str = "event") -> DataFrame:
    """Distinct names of all sets."""
    out = events[0].select(name)
    for more in events[1:]:
        out = out.union(more.select(name))
    return out.distinct()
