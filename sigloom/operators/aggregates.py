"""Metrics and statistics by group. Counts and moments combine before they shuffle; ranks are windows within a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.sources.staging import stage


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def counts(true: str = "true_label", predicted: str = "predicted_label") -> dict[str, Column]:
    t, p = F.col(true) == 1, F.col(predicted) == 1
    return {"tn": F.count_if(~t & ~p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "tp": F.count_if(t & p)}


def confusion(df: DataFrame, by: list[str], **columns) -> DataFrame:
    """``tn``, ``fp``, ``fn``, ``tp`` and specificity."""
    table = df.groupBy(*by).agg(*[c.alias(n) for n, c in counts(**columns).items()])
    return table.withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def rates(table: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, f1 of counted cells."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    named = {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    return table.withColumns(named)


def binary_metrics(df: DataFrame, by: list[str], **columns) -> DataFrame:
    cells = rates(confusion(df, by, **columns))
    return cells.withColumn("num_samples", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).select(*by, "num_samples", "accuracy", "precision", "recall", "f1")


def weighted_class_metrics(df: DataFrame, by: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall and f1 of every class, weighted by how many rows have it."""
    pairs = df.groupBy(*by, true, predicted).agg(F.count("*").alias("__n"))
    hits = F.when(F.col(true) == F.col(predicted), F.col("__n")).otherwise(0)
    rows = pairs.groupBy(*by, F.col(true).alias("__c")).agg(F.sum("__n").alias("support"), F.sum(hits).alias("__hit"), F.lit(0).cast("long").alias("__said"))
    said = pairs.groupBy(*by, F.col(predicted).alias("__c")).agg(F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("__hit"), F.sum("__n").alias("__said"))
    classes = rows.unionByName(said).groupBy(*by, "__c").agg(*[F.sum(c).alias(c) for c in ("support", "__hit", "__said")])
    s, h, d = F.col("support"), F.col("__hit"), F.col("__said")
    weighted = lambda v: F.sum(s * v) / F.sum(s)
    return classes.groupBy(*by).agg(F.sum(s).alias("num_samples"), (F.sum(h) / F.sum(s)).alias("accuracy"), weighted(ratio(h, d)).alias("precision"), weighted(ratio(h, s)).alias("recall"), weighted(ratio(2 * h, s + d)).alias("f1"))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Add the average rank (from 1) of ``value`` in its group; equal values share theirs.

    Values are counted first, so a group's window has a row for each distinct value only.
    """
    tallies = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = tallies.withColumn(name, F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, by: list[str], score: str = "proba", true: str = "true_label") -> DataFrame:
    """Area under the ROC curve from rank sums; null with one class only or with missing scores."""
    bad = df.groupBy(*by).agg(F.max((F.col(score).isNull() | F.isnan(score)).cast("int")).alias("__bad"))
    tallies = df.groupBy(*by, score).agg(F.count("*").alias("__n"), F.count_if(F.col(true) == 1).alias("__p"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = tallies.withColumn("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum(F.col("__n") - F.col("__p")).alias("n_neg"), F.sum(F.col("__r") * F.col("__p")).alias("__s"))
    p, n = F.col("n_pos"), F.col("n_neg")
    value = F.when((p > 0) & (n > 0) & (F.col("__bad") == 0), (F.col("__s") - p * (p + 1) / 2) / (p * n))
    return sums.join(bad, by).select(*by, "n_pos", "n_neg", value.alias("auc"))


def weighted_mean_std(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Plain mean, weighted mean and weighted population deviation."""
    x, w = F.col(value), F.col(weight)
    sums = df.groupBy(*(by or [])).agg(F.avg(x).alias("mean"), (F.sum(w * x) / F.sum(w)).alias("weighted_mean"), (F.sum(w * x * x) / F.sum(w)).alias("__s"))
    return sums.select(*(by or []), "mean", "weighted_mean", F.sqrt(F.greatest(F.lit(0.0), F.col("__s") - F.col("weighted_mean") ** 2)).alias("weighted_std"))


def score_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Extremes, exact quartiles, mean and population deviation."""
    quartiles = {n: F.percentile(value, q) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return df.groupBy(*(by or [])).agg(F.min(value).alias("min"), F.max(value).alias("max"), *[c.alias(n) for n, c in quartiles.items()], F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def describe_by(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles."""
    quartiles = {n: F.percentile(value, q) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *[c.alias(n) for n, c in quartiles.items()], F.max(value).alias("max"))


def melt_metrics(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    return df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in measures], "measure", "value")


def pivot_correlations(df: DataFrame, filters: list, rows: str = "channel", columns: str = "filter", value: str = "correlation") -> DataFrame:
    """A row per channel, a column ``f<filter>`` per filter, and the mean absolute correlation to sort by."""
    wide = df.groupBy(rows).pivot(columns, filters).agg(F.first(value, ignorenulls=True)).withColumnsRenamed({str(f): f"f{f}" for f in filters})
    strength = df.groupBy(rows).agg(F.avg(F.abs(value)).alias("mean_abs"))
    return wide.join(strength, rows)


def event_vote(df: DataFrame, by: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """One row per event: 1 where half of its rows or more say 1, for truth and prediction."""
    said = lambda c: F.when(F.avg(c) >= 0.5, 1).otherwise(0)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), said(true).alias("true_label"), said(predicted).alias("predicted_label"))


def window_truth(labels: Column) -> Column:
    """Mean of an array of labels, rounded half to even; null for an empty array."""
    total = F.aggregate(labels, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(labels) > 0, F.bround(total / F.size(labels), 0).cast("int"))


def dataset_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, subjects, events, background rows and rows of each label, in one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("rows"), distinct("subject_id").alias("subjects"), distinct("event_id").alias("events"), F.count_if("is_background").alias("background"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"))


def session_rollup(df: DataFrame, key: str = "subject_id", **columns) -> DataFrame:
    """Metrics of every session and of all together (``total``, null key)."""
    cells = df.rollup(key).agg(F.grouping(key).cast("int").alias("total"), *[c.alias(n) for n, c in counts(**columns).items()])
    return rates(cells).select(key, "total", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


def regression_metrics(df: DataFrame, by: list[str], true: str, predicted: str) -> DataFrame:
    """Mean absolute error and R squared; R squared is null where the truth is constant."""
    t, p = F.col(true), F.col(predicted)
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.sum((t - p) ** 2).alias("__e"), (F.var_pop(t) * F.count("*")).alias("__v"))
    return sums.select(*by, "n", "mae", F.when(F.col("__v") > 0, 1 - F.col("__e") / F.col("__v")).alias("r2"))


def pearson_by(df: DataFrame, by: list[str], x: str, y: str, more_than: int = 5) -> DataFrame:
    """Correlation of groups with more than ``more_than`` rows, its p-value by Student's t; null where one side is constant."""
    from sigloom.functions.stats import correlation_p

    found = df.groupBy(*by).agg(F.count("*").alias("n"), correlation(x, y).alias("r")).filter(F.col("n") > more_than)
    return found.withColumn("p", correlation_p("r", "n"))


def spearman_by(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with its p-value; null for constant columns or a single row."""
    from sigloom.functions.stats import correlation_p

    ranked = mid_ranks(mid_ranks(df.select(*by, x, y), x, by, "__rx"), y, by, "__ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("__rx", "__ry").alias("rho")).withColumn("p", correlation_p("rho", "n"))


def minmax_scale(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """Add ``value`` scaled to 0..1 in its group; 0 in a constant one. Extremes are aggregated and joined back."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(ends, by).withColumn(name, ratio(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def distance_agreement(df: DataFrame, by: list[str], reference: str, others: list[str]) -> DataFrame:
    """Mean absolute error and R squared of scaled distances against the scaled reference distance, per group and metric.

    ``df`` is read twice: once for all extremes, which are staged so that the join knows how few they are, and once for all sums. No row of it moves.
    """
    lo, hi = "__lo_{}".format, "__hi_{}".format
    columns = [reference, *others]
    ends = stage(df.groupBy(*by).agg(*[F.min(c).alias(lo(c)) for c in columns], *[F.max(c).alias(hi(c)) for c in columns]), "extremes")
    scaled = df.join(ends, by).select(*by, *[ratio(F.col(c) - F.col(lo(c)), F.col(hi(c)) - F.col(lo(c))).alias(c) for c in columns])
    t, n = F.col(reference), F.count("*")
    of = lambda p: F.struct(F.avg(F.abs(t - p)).alias("mae"), F.sum((t - p) ** 2).alias("e"))
    sums = scaled.groupBy(*by).agg(n.alias("n"), (F.var_pop(t) * n).alias("__v"), *[of(F.col(c)).alias(f"__of_{c}") for c in others])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"__of_{c}.mae").alias("mae"), F.col(f"__of_{c}.e").alias("e")) for c in others]))
    return sums.withColumn("__m", each).select(*by, "n", F.col("__m.mae").alias("mae"), F.when(F.col("__v") > 0, 1 - F.col("__m.e") / F.col("__v")).alias("r2"), F.col("__m.metric").alias("metric"))


def signal_profile(df: DataFrame, rate: float, by: list[str], value: str = "x") -> DataFrame:
    """Duration in seconds, share of missing values, mean and population deviation of the others."""
    x = F.nanvl(F.col(value), F.lit(None).cast("double"))
    missing = (F.col(value).isNull() | F.isnan(value)).cast("double")
    return df.groupBy(*by).agg((F.count("*") / rate).alias("seconds"), F.avg(missing).alias("nan_fraction"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def linear_fit_by(df: DataFrame, by: list[str], y: str, x: str, least: int = 5) -> DataFrame:
    """Slope and intercept of ``y`` on ``x`` for groups of ``least`` complete rows or more; null where ``x`` is constant."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(y, x), F.var_pop(x)).alias("slope"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    return fit.filter(F.col("n") >= least).withColumn("intercept", F.col("__y") - F.col("slope") * F.col("__x")).drop("__x", "__y")
