"""URL filter: a blocked Bloom filter of listed URLs, then an exact join of what it lets through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.staging import stage

WORDS = 8


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z in lower case; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and m., path without a last slash, query without tracking fields, no scheme or fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.|:(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


def rule_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Every host suffix at a dot, of ``labels`` labels at most, with every prefix of the path as long as some rule's path."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    paths = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths], F.lit(None).cast("string")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(F.lit("rule "), h, p))))


def build_filter(keys: DataFrame, bits_per_key: int, max_bytes: int) -> np.ndarray:
    """The filter of ``keys`` (``key``): blocks of eight 64-bit words, one bit set in each word for a key.

    Bits are combined in Spark; the driver gets the blocks, ``max_bytes`` at most. With more keys than that holds
    the filter lets more through, and the join still decides.
    """
    n, largest = keys.count(), max(1, max_bytes // (8 * WORDS))
    blocks = min(largest, 1 << max(0, (n * bits_per_key // (64 * WORDS)).bit_length()))
    h = keys.select(F.xxhash64("key").alias("h")).select(F.pmod("h", F.lit(blocks)).alias("block"), F.xxhash64("h").alias("g"))
    set_bits = [F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(g, {6 * i}) & 63))")).alias(f"w{i}") for i in range(WORDS)]
    table = np.zeros((blocks, WORDS), np.int64)
    for batch in h.groupBy("block").agg(*set_bits).toArrow().to_batches():
        rows = batch.column(0).to_numpy()
        for i in range(WORDS):
            table[rows, i] = batch.column(1 + i).to_numpy()
    return table


def probe(df: DataFrame, table: np.ndarray) -> Column:
    """A function of two arrays of hashes (of the key, and of that hash): the places that may be listed."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<int>")
    def places(h: pa.Array, g: pa.Array) -> pa.Array:
        bits, of = shared.value, h.flatten().to_numpy(zero_copy_only=False)
        mixed = g.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        block = of % len(bits)
        maybe = np.ones(len(of), bool)
        for i in range(WORDS):
            maybe &= (bits[block, i].view(np.uint64) >> ((mixed >> np.uint64(6 * i)) & np.uint64(63)) & np.uint64(1)).astype(bool)
        ends = np.concatenate([[0], np.cumsum(h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        at = np.flatnonzero(maybe)
        row = np.searchsorted(ends, at, side="right") - 1
        offsets = np.searchsorted(row, np.arange(len(ends)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at - ends[row], pa.int32()))

    return places


def judge_urls(
    df: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 16, max_filter_bytes: int = 16 << 20, broadcast_bytes: int = 8 << 20
) -> DataFrame:
    """One row per row of ``df``: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules``: (verdict, host, path). One fits its host and all subdomains if the path starts with its path; the
    longest wins, of equal ones that with the longer host. Without a rule a URL is blocked if its canonical form is in
    ``listed`` (``url``, canonical; nulls and repeats are ignored), else allowed. Both kinds of entry are keys of one list behind one
    filter: URLs of which no key may be listed are allowed at once, and only the others are joined with the list. A list of
    ``broadcast_bytes`` at most is broadcast, a longer one shuffles, and Spark splits a key's rows there. Every row is a row of its own,
    so repeated pages come out as often as they came. A null URL or one without :// has an empty host and path, fits no rule and is not
    listed. Of a host only as many last labels are looked up as the longest rule's host has, so very long URLs cost what their length
    does. Null ids are kept. Other columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    fixed = spark.createDataFrame([(f"rule {h}{p}", f"{h}{p}", v, len(h)) for v, h, p in rules], "key string, rule string, verdict string, host_chars int")
    urls = listed.filter("url IS NOT NULL").select(F.concat(F.lit("url "), "url").alias("key")).distinct()
    keys = stage(fixed.unionByName(urls.selectExpr("key", "CAST(NULL AS STRING) AS rule", "'block' AS verdict", "0 AS host_chars")), "listed")
    lengths, labels = sorted({len(p) for _, _, p in rules}), max((h.count(".") + 1 for _, h, _ in rules), default=1)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    both = F.concat(rule_keys(F.col("host"), F.col("path"), lengths, labels), F.array(F.concat(F.lit("url "), canonical(F.col("url")))))
    pages = pages.withColumn("keys", F.when(F.col("host") != "", both).otherwise(F.array().cast("array<string>")))
    pages = pages.withColumn("h", F.transform("keys", lambda k: F.xxhash64(k)))
    places = probe(df, build_filter(keys, bits_per_key, max_filter_bytes))
    probed = pages.withColumn("at", places("h", F.transform("h", lambda x: F.xxhash64(x)))).select("id", "host", "path", F.expr("transform(at, i -> keys[i])").alias("keys"))
    probed = stage(probed.withColumn("row", F.monotonically_increasing_id()), "probed")
    entries = keys.select(F.col("key").alias("__key"), "rule", "verdict", "host_chars")
    if (keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= broadcast_bytes:
        entries = F.broadcast(entries)
    exact = probed.filter(F.size("keys") > 0).select("row", F.explode("keys").alias("key")).join(entries, F.col("key") == F.col("__key"))
    best = F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("chars"), F.coalesce("host_chars", F.lit(-1)).alias("host_chars"), "rule", "verdict"))
    judged = exact.groupBy(F.col("row").alias("__row")).agg(best.alias("best"))
    hits = probed.filter(F.size("keys") > 0).join(judged, F.col("row") == F.col("__row"), "left")
    found = hits.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    clear = probed.filter(F.size("keys") == 0).select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return clear.unionByName(found)
