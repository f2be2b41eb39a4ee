"""Exact duplicates by two passes over a blocked Bloom filter; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.staging import null_safe, stage, wrapped

BLOCK_BITS = 512
PROBES = 3


def filter_room(spark: SparkSession, share: int = 16, most: int = 1 << 30) -> int:
    """Bytes that a broadcast filter may take: a 16th of an executor's or the driver's heap, whichever is smaller, and 1 GB at most."""
    heaps = [spark.conf.get(f"spark.{x}.memory", "1g") for x in ("executor", "driver")]
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    sizes = [int(n) << units[unit[0]] if unit else int(n) << 20 for n, unit in (re.fullmatch(r"(\d+)([kmgt]?)b?", h.lower()).groups() for h in heaps)]
    return min(most, min(sizes) // share)


def _blocks(rows: int, bits_per_row: int, max_filter_bytes: int) -> int:
    wanted, most = max(1, rows * bits_per_row // BLOCK_BITS), max(1, max_filter_bytes * 8 // BLOCK_BITS)
    return min(1 << (wanted - 1).bit_length(), most)


def _hashed(text: Column, blocks: int) -> dict[str, Column]:
    """A row's block and its distinct bit positions there, from one 64-bit hash of the whole text."""
    h = F.xxhash64(text)
    mixed = F.xxhash64(h)
    places = [F.shiftrightunsigned(mixed, 9 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(PROBES)]
    return {"__block": F.pmod(h, F.lit(blocks)), "__places": F.array_distinct(F.array(*places))}


def repeated_filter(hashed: DataFrame) -> DataFrame:
    """First pass: the bits that two rows or more have set, as eight 64-bit words a block."""
    slots = hashed.select("__block", F.explode("__places").alias("__place"))
    twice = slots.groupBy("__block", "__place").agg(F.count("*").alias("__n")).filter("__n > 1")
    word = lambda i: F.bit_or(F.expr(f"CASE WHEN __place DIV 64 = {i} THEN shiftleft(1L, __place % 64) ELSE 0L END"))
    words = twice.groupBy("__block").agg(*[word(i).alias(f"__w{i}") for i in range(BLOCK_BITS // 64)])
    return words.select(F.col("__block").alias("__b"), F.array(*[f"__w{i}" for i in range(BLOCK_BITS // 64)]).alias("__words"))


def mark_possible(df: DataFrame, text_col: str, bits_per_row: int = 16, max_filter_bytes: int | None = None) -> DataFrame:
    """Add ``__sha`` (of the text; null as empty) and ``__possible``: false if no other row can have the text.

    Both passes scan the input and shuffle filter slots only. The filter's greatest size follows the heaps (see ``filter_room``), which
    bounds the broadcast; past its capacity more rows count as possibly repeated, and results stay exact.
    """
    max_filter_bytes = max_filter_bytes or filter_room(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = _blocks(df.count(), bits_per_row, max_filter_bytes)
    words = stage(repeated_filter(df.select(text.alias("__text")).withColumns(_hashed(F.col("__text"), blocks))), "bloom")
    probed = df.withColumns({**_hashed(text, blocks), "__sha": F.sha2(text, 256)}).join(F.broadcast(words), F.col("__block") == F.col("__b"), "left")
    hit = F.expr("__words IS NOT NULL AND forall(__places, p -> getbit(__words[p DIV 64], p % 64) = 1)")
    return probed.withColumn("__possible", hit).drop("__block", "__places", "__b", "__words")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest id stays; null ids are smaller than any other, and if all are null ``keep_id`` is null and
    one row stays. Of rows with the same id and text one stays. Other columns of the
    input are not read, so their names cannot clash. An empty table gives no rows. Rows that the filter clears
    never shuffle. A group of any size is pre-aggregated to its size and last row, and Spark splits its rows' join with them.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    marked = stage(mark_possible(rows, "__t", **filter_options).select("__id", "__sha", "__possible", F.monotonically_increasing_id().alias("__row")), "marked")
    alone = marked.filter("NOT __possible").select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256")
    )
    possible = marked.filter("__possible")
    last = F.max(F.struct("__id", (-F.col("__row")).alias("__first"))).alias("__last")
    groups = stage(possible.groupBy(F.col("__sha").alias("__s")).agg(last, F.count("*").alias("group_size")), "groups")
    stays = F.col("__row") == -F.col("__last.__first")
    shared = possible.join(groups, F.col("__sha") == F.col("__s")).select(
        F.col("__id").alias(id_col), F.col("__last.__id").alias("keep_id"), "group_size", stays.alias("kept"), F.col("__sha").alias("text_sha256")
    )
    return alone.unionByName(shared)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """The rows of ``df``, all columns as they are whatever their names, that ``exact_groups`` keeps.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays, null being smaller than any; of rows with the same id and text
    any one stays. An empty table gives no rows. Rows that the filter clears pass straight through. The others meet their group's largest
    id by (text, id), a key that no group of copies can make hot.
    """
    rows = wrapped(df).withColumns({"__id": F.col("row")[id_col], "__t": F.col("row")[text_col]})
    marked = mark_possible(rows, "__t", **filter_options)
    possible = marked.filter("__possible")
    keepers = stage(possible.groupBy("__sha").agg(F.max("__id").alias("__keep")), "keepers").withColumnRenamed("__sha", "__s")
    # An inner join (keepers are unique): Spark would push a semi join below the filter's join, and all rows would shuffle.
    stays = possible.join(keepers, null_safe(possible, keepers, {"__sha": "__s", "__id": "__keep"})).select(*marked.columns)
    return marked.filter("NOT __possible").unionByName(stays.dropDuplicates(["__sha", "__id"])).select("row.*")
