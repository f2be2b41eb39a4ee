"""Row-wise operators: channels, labels, scores, filters. All narrow, all built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event names of the annotations, with their labels [imagery, background, right hand, point]. Fixed values.
EVENT_LABELS = {
    "Background@@": (0, 1, 0, 0),
    "Rest@@right/hand": (0, 0, 1, 0),
    "Rest@@left/hand": (0, 0, 0, 0),
    "Image@@right/hand": (1, 0, 1, 0),
    "Image@@left/hand": (1, 0, 0, 0),
    "Point@@right/hand": (1, 0, 1, 1),
    "Point@@left/hand": (1, 0, 0, 1),
}


def position(channels: list[str], name: str) -> int:
    if name not in channels:
        raise ValueError(f"no channel {name}")
    return channels.index(name)


def rereference(df: DataFrame, channels: list[str], reference: str, x: str = "x") -> DataFrame:
    """Subtract the reference channel from every channel."""
    at = position(channels, reference)
    return df.withColumn(x, F.transform(x, lambda v: v - F.col(x)[at]))


def scale(df: DataFrame, unit: float = 1e6, x: str = "x") -> DataFrame:
    """Divide every channel by ``unit``."""
    return df.withColumn(x, F.transform(x, lambda v: v / unit))


def select_channels(df: DataFrame, channels: list[str], keep: list[str], x: str = "x") -> DataFrame:
    """Keep the named channels, in stream order."""
    for name in keep:
        position(channels, name)
    return df.withColumn(x, F.array(*[F.col(x)[i] for i, c in enumerate(channels) if c in keep]))


def rename_drop_channels(channels: DataFrame, renames: dict[str, str], drops: list[str], label: str = "label") -> DataFrame:
    """Channel table without ``drops`` and with new names."""
    kept = channels.filter(~F.col(label).isin(drops)) if drops else channels
    named = reduce(lambda c, r: c.when(F.col(label) == r[0], r[1]), renames.items(), F.when(F.lit(False), ""))
    return kept.withColumn(label, named.otherwise(F.col(label)))


def exclude_label(df: DataFrame, label: int = 2) -> DataFrame:
    """Rows of other labels; -1 keeps all."""
    return df if label == -1 else df.filter(F.col("label") != label)


def drop_background(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_background"))


def select_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(subjects.select(key).distinct(), key, "left_semi")


def exclude_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def require_group_size(df: DataFrame, n: int, mode: str = "at_least", key: str = "subject_id", label: str | None = None) -> DataFrame:
    """Rows of groups with ``n`` rows (``exactly``) or more (``at_least``); with ``label``, of two labels at least.

    Groups are counted first and joined back, so a large group need not fit in a task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__n"), *([F.countDistinct(label).alias("__labels")] if label else []))
    fits = F.col("__n") == n if mode == "exactly" else F.col("__n") >= n
    return df.join(counts.filter(fits & (F.col("__labels") > 1) if label else fits).select(key), key, "left_semi")


def decode_event_label(df: DataFrame, description: str = "description") -> DataFrame:
    """Add ``event`` (the text before #) and ``labels`` (four numbers, null for unknown events)."""
    event = F.split_part(F.col(description), F.lit("#"), F.lit(1))
    table = F.create_map(*[x for k, v in EVENT_LABELS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return df.withColumn("event", event).withColumn("labels", F.try_element_at(table, F.col("event")))


def parse_score(description: Column) -> Column:
    """The number after ``VAS=``, in hundredths; 1 without one."""
    return F.when(F.contains(description, F.lit("VAS=")), F.try_divide(F.split_part(description, F.lit("VAS="), F.lit(2)).try_cast("double"), F.lit(100.0))).otherwise(1.0)


def condition_class(df: DataFrame, fine: bool = False) -> DataFrame:
    """Add ``condition``: 0 background, 1 rest, 2 right hand, 3 left hand; ``fine`` also parts points from images; -1 if none."""
    background, right, point, imagery = F.col("is_background"), F.col("is_right_hand"), F.col("is_point"), F.col("label") == 1
    known = F.when(background, 0).when(F.col("label") == 0, 1)
    if fine:
        out = known.when(imagery & right & ~point, 2).when(imagery & ~right & ~point, 3).when(imagery & point, 4)
    else:
        out = known.when(imagery & right, 2).when(imagery & ~right, 3)
    return df.withColumn("condition", out.otherwise(-1))


def replace_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def pick_fields(df: DataFrame, names: list[str], **constants) -> DataFrame:
    """Named columns and constant ones."""
    return df.select(*names, *[F.lit(v).alias(k) for k, v in constants.items()])


def eog_channels(df: DataFrame, channels: list[str], x: str = "x") -> DataFrame:
    """Add ``veog`` (mean of Fp1 and Fp2) and ``heog`` (F8 less F7)."""
    at = {c: F.col(x)[position(channels, c)] for c in ("Fp1", "Fp2", "F7", "F8")}
    return df.withColumns({"veog": (at["Fp1"] + at["Fp2"]) / 2, "heog": at["F8"] - at["F7"]})


def trial_filter(df: DataFrame, kinds: list[str], block: str, trials: list[str]) -> DataFrame:
    """Events of some kinds in one type of block and some types of trial."""
    return df.filter(F.col("event").isin(kinds) & (F.col("block_type") == block) & F.col("trial_type").isin(trials))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def valid_predictions(df: DataFrame, label: str = "predicted_label", score: str = "predicted_proba") -> DataFrame:
    """Without skipped folds (label -99) and missing probabilities."""
    return df.filter((F.col(label) != -99) & F.col(score).isNotNull() & ~F.isnan(score))


def seconds_to_samples(seconds: Column, rate: float) -> Column:
    """Whole samples, cut towards zero."""
    return (seconds * rate).cast("long")


def flatten_upper(matrix: Column, n: int, diagonal: int = 0) -> Column:
    """Upper triangle of a flat n x n matrix, row by row, with (0) or without (1) the diagonal."""
    return F.array(*[matrix[i * n + j] for i in range(n) for j in range(i + diagonal, n)])


def vector_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """``euclidean``, ``cityblock`` or ``cosine`` distance of two arrays."""
    total = lambda of: F.aggregate(F.zip_with(a, b, of), F.lit(0.0), lambda s, v: s + v)
    if metric == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "cityblock":
        return total(lambda x, y: F.abs(x - y))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return 1 - total(lambda x, y: x * y) / (norm(a) * norm(b))


def round_half_away(v: Column, digits: int) -> Column:
    """``v`` times a power of ten, to the nearest whole number with halves away from zero, over that power: as in C and SQL engines built on it. A zero keeps its value's sign."""
    scaled = F.abs(v) * 10.0**digits
    whole = F.floor(scaled).cast("double")
    rounded = F.signum(v) * ((whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits)
    return F.when(scaled < 2.0**52, rounded).otherwise(v)


def difference_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: y - x)


def correlation_distance(correlation: Column) -> Column:
    """sqrt(2 (1 - c)) of every entry."""
    return F.transform(correlation, lambda c: F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - c))))


def split_window(df: DataFrame, n: int = 3, sample: str = "sample") -> DataFrame:
    """Cut each window's times into ``n`` equal parts; one row a part, ``part`` from 0; what is left over goes."""
    each = F.floor(F.col("n_times") / n).cast("int")
    cut = lambda part: F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.slice(sample, c * F.col("n_times") + part * each + 1, each)))
    parts = df.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(n)])))
    return parts.withColumn(sample, cut(F.col("part"))).withColumn("n_times", each)


def lag_embed(df: DataFrame, order: int = 4, lag: int = 8, sample: str = "sample") -> DataFrame:
    """Stack ``order`` copies of the channels, each ``lag`` times further on; times that not all copies have go."""
    left = F.col("n_times") - order * lag if order > 1 else F.col("n_times")

    def copy(k: int) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.slice(sample, c * F.col("n_times") + k * lag + 1, left)))

    copies = [copy(k) for k in range(order)]
    return df.withColumn(sample, F.flatten(F.array(*copies))).withColumns({"n_channels": F.col("n_channels") * order, "n_times": left})


def group_folds(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """One row per fold (``fold``, ``test_rows``, ``train_rows``): each key is held out once."""
    counts = df.groupBy(F.col(key).alias("fold")).agg(F.count("*").alias("test_rows"))
    return counts.withColumn("train_rows", F.sum("test_rows").over(Window.partitionBy(F.lit(0))) - F.col("test_rows"))
