"""Ranks and running sums over all rows without one task seeing them all."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.sources.staging import remove, shared_dir, small_batches, stage

PARTITION_BYTES = 10_000_000

__all__ = ["chunk_count", "enough_partitions", "null_safe", "rank_within", "running_total", "shared_dir", "shuffle_files_dropped", "small_batches", "stage", "unstage", "wrapped"]


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within, shuffle files go as soon as the job that made them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def enough_partitions(df: DataFrame, each: int = PARTITION_BYTES):
    """Within, a shuffle has a partition for every ``each`` bytes of the files that ``df`` reads, or as many as are set if that is more, and small ones are put together to twice that at most.

    A task sorts, groups and joins a partition in its share of an executor's memory, so partitions must not grow with the input.
    """
    spark = df.sparkSession
    number, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {name: spark.conf.get(name) for name in (number, size)}
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    # A table that is not in files has no size, which Spark takes for the largest there is.
    asked = sum(x for x in sizes if x < 1 << 60) // each + 1
    spark.conf.set(number, str(max(int(before[number]), asked)))
    spark.conf.set(size, str(min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[size]), 2 * each)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def wrapped(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct, ``row``: an operator's own columns beside it cannot clash with them. ``select("row.*")`` gives them back."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"))


def unstage(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``, which must not be read after that."""
    remove(df.sparkSession, df.inputFiles()[0].rpartition("/")[0])


def chunk_count(spark: SparkSession) -> int:
    """Chunks into which a key's rows are cut: more than there are shuffle partitions."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe(left: DataFrame, right: DataFrame, names: dict[str, str]):
    """Join condition: left column equals right column, null equal to null."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in names.items()])


def running_total(df: DataFrame, keys: list[str], order: list[str], value, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` (long) over the rows of the same keys before this one.

    The order is that of hashed chunks and, within one, of ``order``, which must tell
    all rows apart that are to be told apart. Chunks are summed first, so that no task sorts
    a whole key, however many rows it has. ``df`` is read twice: it must be staged or
    cheap, and give the same rows each time. Keys must not be null.
    """
    spark = df.sparkSession
    chunked = df.withColumns({"__v": value.cast("long"), "__chunk": F.pmod(F.xxhash64(*order), F.lit(chunk_count(spark)))})
    sums = chunked.groupBy(*keys, "__chunk").agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__chunk").alias("__k"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("__local", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k_{k}") for k in keys], F.col("__chunk") == F.col("__k"))
    joined = local.join(offsets, same)
    return joined.withColumn(name, F.col("__before") + F.col("__local")).drop("__v", "__chunk", "__k", "__before", "__local", *[f"__k_{k}" for k in keys])


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within the keys (see ``running_total``)."""
    return running_total(df, keys, order, F.lit(1), name)
