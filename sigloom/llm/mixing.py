"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.staging import chunk_count, stage, wrapped

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources take ``weights`` in turn by code point, null last. Filling sources in the order of their limit over
    their weight gives what resharing the excess over and over ends in. One row a source is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(w) for w in weights])
    weighted = sizes.withColumn("__w", turns[((F.row_number().over(order) - 1) % len(weights)).cast("int")].cast("double"))
    limited = weighted.withColumn("__limit", most * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("__limit") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(by_limit), F.lit(0.0))
    weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(by_limit), F.lit(0.0))
    levels = limited.withColumn("__level", left / weight)
    fits = F.when(F.col("__level") <= F.col("__limit") / F.col("__w"), F.col("__level"))
    # Levels fall from the first source that keeps below its limit on, so the first is the largest that fits.
    first = F.max(fits).over(every)
    return levels.withColumn("__first", first).select(
        "source", "source_size", F.when(F.col("__first").isNull(), F.col("__limit")).otherwise(F.least("__limit", F.col("__first") * F.col("__w"))).alias("target")
    )


def mix(
    df: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, offset: float = 0.381966
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (0 or more) to every row of ``df``.

    ``size``: a column of ``df``'s columns, a long that is never null. Every document of a source is expected ``target /
    source_size`` times; these expectations are summed along the source, from ``offset`` on, and a document
    is taken once per integer that its span crosses. The order is by size (quarter octaves), then by the
    id's MD5, so that each stretch of the sum holds documents of all sizes and the words taken come near the
    target. ``offset`` in [0, 1) stands for the one random number; runs with the same one agree.
    A source of size 0 (only empty texts) and its documents are expected 0 times. Null source: a source of its own, last. Null
    ids sort first; rows equal in id and size are interchangeable. Columns of the input named like an added one are replaced.
    Ranks come from counts by (source, band, chunk of the MD5): a source with a third of all rows is never in one task.
    """
    chunks = chunk_count(df.sparkSession)
    kept = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bits = F.bin(F.col("__size"))
    rows = df.withColumns({"__size": size.cast("long"), "__source": F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")), "__md5": digest, "__id": F.col(id_col)}).select(*[F.col(c) for c in kept], "__size", "__source", "__md5", "__id")
    # Never null, which Spark must see: else it tests the keys before the join and works out the sizes again for that.
    sure = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rows = rows.withColumn("__band", sure(F.length(bits) * 8 + F.conv(F.substring(bits, 1, 3), 2, 10).cast("int")))
    rows = rows.withColumn("__chunk", sure(F.floor(F.conv(F.substring("__md5", 1, 8), 16, 10).cast("long") * chunks / F.lit(1 << 32))))
    counts = stage(rows.groupBy("__source", "__band", "__chunk").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words")), "mix-counts")
    named = F.when(F.col("__source") != "", F.substring("__source", 2, 2**31 - 1))
    sizes = counts.groupBy(named.alias("source")).agg(F.sum("__words").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, most), "mix-targets")
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__ts"), "source_size", "target")
    before = Window.partitionBy("__source").orderBy("__band", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.join(targets, F.col("__source") == F.col("__ts"))
    offsets = offsets.select(F.col("__source").alias("__os"), F.col("__band").alias("__ob"), F.col("__chunk").alias("__oc"), "__before", "source_size", "target")
    within = Window.partitionBy("__source", "__band", "__chunk").orderBy("__md5", "__id", "__size")
    local = rows.withColumn("__local", F.row_number().over(within) - 1)
    # Keys without nulls join by plain equality, on the partitioning that the ranks have already.
    joined = local.join(offsets, (F.col("__source") == F.col("__os")) & (F.col("__band") == F.col("__ob")) & (F.col("__chunk") == F.col("__oc")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumns({"__at": F.col("__before") + F.col("__local"), "__step": step})
    crossed = F.floor((F.col("__at") + 1) * F.col("__step") + offset) - F.floor(F.col("__at") * F.col("__step") + offset)
    return joined.select(*kept, F.col("__size").alias("size"), "source_size", "target", crossed.cast("long").alias("copies"))


def mix_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, all columns as they are whatever their names, each as often as ``mix`` takes it by its words."""
    rows = wrapped(df)
    own = rows.select("row", F.col("row")[id_col].alias("mix_id"), F.col("row")[source_col].alias("mix_source"), word_count(F.col("row")[text_col]).alias("words"))
    return emit_copies(mix(own, F.col("words"), "mix_id", "mix_source", **options), ["row"]).select("row.*")


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).select(*columns)
