"""Shortest-pack-first packing over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.staging import rank_within, small_batches, stage
from sigloom.llm.tokens import encoder

KEPT_WORDS = 200_000
PIECE = "start long, length long, crc32 long"


def cut_pieces(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's full pieces and its rest."""
    return [(at, min(room, n - at)) for at in range(0, n, room)]


def encode_pieces(df: DataFrame, tokenizer_path: str, room: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id, ``doc_tokens``, ``pieces``) of every row: whole text's ids and ``end_id``, cut to pieces of ``room``; null text is empty."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T._parse_datatype_string(f"array<struct<{PIECE.replace(' ', ':')}>>".replace(",:", ",")))])

    def run(batches):
        encode, end = encoder(tokenizer_path, KEPT_WORDS).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            counts, ends, starts, lengths, sums = [], [0], [], [], []
            for text in batch.column(1):
                ids = encode((text.as_py() or b"").decode("utf-8", "replace")) + end
                view, n = memoryview(ids), len(ids) // 4
                counts.append(n)
                for s, k in cut_pieces(n, room):
                    starts.append(s)
                    lengths.append(k)
                    sums.append(zlib.crc32(view[4 * s : 4 * (s + k)]))
                ends.append(len(starts))
            pieces = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, sums)], ["start", "length", "crc32"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)], ["id", "doc_tokens", "pieces"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], room: int) -> dict[tuple[int, ...], int]:
    """Packing patterns (piece lengths, longest first) and how many sequences each has.

    Lengths are placed longest first. All pieces of a length go, as many at once as there are, to the
    shortest packs; if even those have no room, to new packs. Packs of one pattern are kept as a count, so the
    work depends on the number of lengths, not of pieces.
    """
    by_length: dict[int, Counter] = defaultdict(Counter)
    heap: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        by_length[sum(pattern)][pattern] += n
        heapq.heappush(heap, sum(pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not by_length[heap[0]]:
                heapq.heappop(heap)
            if heap and heap[0] + length <= room:
                packs = by_length[heap[0]]
                pattern, n = next(iter(packs.items()))
                n = min(left, n)
                packs[pattern] -= n
                if not packs[pattern]:
                    del packs[pattern]
                put((*pattern, length), n)
                left -= n
            else:
                # New packs: the one just opened is the shortest, until no piece of this length fits.
                each = room // length
                for copies, n in ((each, left // each), (left % each, 1)):
                    if copies and n:
                        put((length,) * copies, n)
                left = 0
    return {pattern: n for packs in by_length.values() for pattern, n in packs.items()}


def place(pieces: DataFrame, room: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces with columns ``length`` and ``__key`` (unique).

    The histogram, of ``room`` rows at most, is all that reaches the driver; the patterns go back as ranges of
    ranks within a length. A sequence's pieces lie gapless from 0, longest first; sequence ids are gapless.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, used, first = [], Counter(), 0
    for pattern, n in shortest_pack_first(histogram, room).items():
        at = 0
        for length in pattern:
            ranges.append((length, used[length], used[length] + n, first - used[length], at))
            used[length] += n
            at += length
        first += n
    table = pieces.sparkSession.createDataFrame(ranges, "__length int, __from long, __to long, __shift long, offset long")
    ranked = rank_within(pieces, ["length"], ["__key"], "__rank")
    fits = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    return ranked.join(F.broadcast(table), fits).withColumn("sequence_id", F.col("__rank") + F.col("__shift")).drop("__length", "__from", "__to", "__shift", "__rank")


def pack_documents(df: DataFrame, tokenizer_path: str, room: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every document is its text's ids and ``end_id``; full pieces of ``room`` ids fill a sequence each and the rests are
    packed. Null and empty texts are one piece of one id. Repeated rows are packed as often as they come; null ids
    are kept. Other columns are not read, so names cannot clash. An empty table gives no rows. ``room`` is a bounded
    setting: the patterns' table has some rows for each length up to it.
    """
    encoded = encode_pieces(df, tokenizer_path, room, id_col, text_col, end_id)
    pieces = encoded.select("id", "doc_tokens", F.explode("pieces").alias("p")).select("id", "doc_tokens", F.col("p.start").alias("start"), F.col("p.length").cast("int").alias("length"), F.col("p.crc32").alias("ids_crc32"))
    with small_batches(df.sparkSession):
        staged = stage(pieces.withColumn("__key", F.monotonically_increasing_id()), "pieces")
    placed = place(staged, room)
    return placed.select(F.col("id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
