"""Training-order materialisation: a keyed permutation gives every sequence its slot in fixed-stride shards."""

from __future__ import annotations

import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigloom.llm.staging import shared_dir, shuffle_files_dropped, small_batches, stage
from sigloom.llm.tokens import encoder

ROUNDS, WALKS = 6, 64
END = b"\n"
MOST_TASKS = 10_000
KEPT_WORDS = 250_000


def feistel(df: DataFrame, number: str, size: int, key: int, name: str) -> DataFrame:
    """Add ``name``: a keyed permutation of 0..size-1, by a Feistel network over pairs of digits to the base ``ceil(sqrt(size))``.

    The pairs number at most ``2 * sqrt(size)`` more than ``size``, so few numbers land outside; those walk on along their cycle until they
    are inside. A walk of over ``WALKS`` steps would need as many pairs from outside in a row; it stops the job.
    """
    base = math.isqrt(max(size - 1, 0)) + 1
    pair = f"(s, k) -> named_struct('a', s.b, 'b', pmod(s.a + pmod(xxhash64(s.b, k, {key}L), {base}L), {base}L))"
    step = lambda x: f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {x} DIV {base}L, 'b', {x} % {base}L), {pair}, s -> s.a * {base}L + s.b)"
    walk = f"aggregate(sequence(1, {WALKS}), __step, (x, i) -> CASE WHEN x < {size}L THEN x ELSE {step('x')} END)"
    walked = df.withColumn("__step", F.expr(step(number))).withColumn("__step", F.expr(f"CASE WHEN __step < {size}L THEN __step ELSE {walk} END"))
    return walked.withColumn(name, F.expr(f"CASE WHEN __step < {size}L THEN __step ELSE raise_error('a walk of the permutation is too long') END").cast("long")).drop("__step")


class _Sequences:
    """Finished sequences and their pieces, gathered as columns of an Arrow batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.piece = schema, schema.field(1).type.value_type
        self.clear()

    def clear(self) -> None:
        self.ids, self.ends, self.columns = [], [0], tuple([] for _ in range(5))

    def add(self, ids: bytes, pieces: list[tuple]) -> None:
        self.ids.append(ids)
        for column, values in zip(self.columns, zip(*pieces, strict=True), strict=True):
            column.extend(values)
        self.ends.append(len(self.columns[0]))

    def batch(self) -> pa.RecordBatch:
        fields = [pa.array(c, f.type) for c, f in zip(self.columns, self.piece, strict=True)]
        held = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(self.piece)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.binary()), held.cast(self.schema.field(1).type)], schema=self.schema)


def encode_sequences(df: DataFrame, tokenizer_path: str, room: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(``ids``, ``pieces``): texts' ids, each text's with ``end_id`` after them, end to end in sequences of ``room`` ids of two bytes.

    Only the last sequence of an input partition is shorter. ``pieces``: what a sequence holds, as (id, start in the
    document, length, offset in the sequence, crc32 of the bytes).
    """
    kind = df.schema[id_col].dataType
    fields = [("id", kind), ("start", T.LongType()), ("length", T.LongType()), ("offset", T.LongType()), ("crc32", T.LongType())]
    schema = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields])))])

    def run(batches):
        encode, end, full = encoder(tokenizer_path, KEPT_WORDS, 2).encode, end_id.to_bytes(2, "little"), 2 * room
        out, open_, pieces = _Sequences(to_arrow_schema(schema)), bytearray(), []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode((text.as_py() or b"").decode("utf-8", "replace")) + end
                at = 0
                while at < len(ids):
                    part = ids[at : at + full - len(open_)]
                    pieces.append((doc, at // 2, len(part) // 2, len(open_) // 2, zlib.crc32(part)))
                    open_ += part
                    at += len(part)
                    if len(open_) == full:
                        out.add(bytes(open_), pieces)
                        open_, pieces = bytearray(), []
                        if len(out.ids) == 512:
                            yield out.batch()
                            out.clear()
        if open_:
            out.add(bytes(open_), pieces)
        if out.ids:
            yield out.batch()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def number_rows(staged: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Add gapless numbers to a table of files by file and row within the file; only counts by file are summed."""
    at = staged.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    counts = stage(at.groupBy("__file").agg(F.count("*").alias("__n")), "file-counts")
    before = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__file").alias("__f"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # One row a written file, which a task made: as many as the driver knows tasks.
    return at.join(F.broadcast(offsets), F.col("__file") == F.col("__f")).withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__f", "__before"), total


def materialise(
    df: DataFrame, path: str, tokenizer_path: str, key: int, room: int = 1024, per_shard: int = 8192, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Write shards below ``path`` in training order; give the index, one row per piece of a document.

    Sequences are ``room`` ids as little-endian 16-bit integers (see ``encode_sequences``; a short one is padded with zeros). Slot ``s`` of the
    permutation is record ``s % per_shard`` of the folder ``shard=<s // per_shard>``, a single file of records of ``2 * room + 1`` bytes (a line
    feed ends each), so a reader seeks to any slot and resumes there. Every shard but the last is full. Index: id, ``start`` and ``length`` in the
    document's ids, ``slot``, ``shard``, ``record``, ``offset`` in the sequence, ``ids_crc32`` (of the 16-bit ids). Null and empty texts are the end id
    alone; repeated rows are written as often as they come; null ids are kept. Other columns are not read. An empty table gives an empty index and
    no shard. Tokens are written once to the shared folder before they are numbered, as the permutation's size is then known;
    shards are written in ``rounds`` by ranges of slots, so that only that share of the tokens is in shuffle files at a time.
    """
    spark = df.sparkSession
    with small_batches(spark):
        tokens = stage(encode_sequences(df, tokenizer_path, room, id_col, text_col, end_id), "tokens")
    numbered, total = number_rows(tokens, "number")

    ordered = feistel(numbered, "number", total, key, "slot").withColumn("shard", F.expr(f"slot DIV {per_shard}L"))
    shards = -(-total // per_shard)
    record = F.concat("ids", F.expr(f"repeat(X'00', {2 * room} - octet_length(ids))").cast("binary"))
    with shuffle_files_dropped(spark):
        for k in range(rounds):
            first, last = k * shards // rounds, (k + 1) * shards // rounds
            if first == last:
                continue
            own = ordered.filter((F.col("shard") >= first) & (F.col("shard") < last)).select("shard", "slot", "ids")
            # Ranges of shards with known bounds: no sampling pass.
            tasks = min(last - first, MOST_TASKS)
            dealt = own.repartitionById(tasks, F.expr(f"CAST((shard - {first}) * {tasks} DIV {last - first} AS INT)")).sortWithinPartitions("shard", "slot")
            dealt.select("shard", record.cast("string").alias("value")).write.mode("append").partitionBy("shard").option("lineSep", END.decode()).option("compression", "none").text(path)
    held = ordered.select("slot", "shard", F.explode("pieces").alias("p"))
    return held.select(F.col("p.id").alias(id_col), "p.start", "p.length", "slot", "shard", (F.col("slot") % per_shard).alias("record"), "p.offset", F.col("p.crc32").alias("ids_crc32"))


def read_shards(spark: SparkSession, path: str, room: int = 1024, first_slot: int = 0, per_shard: int = 8192) -> DataFrame:
    """(``slot``, ``ids`` as stored, padded) from ``first_slot`` on: whole shards before it are never opened."""
    stride = 2 * room + len(END)
    files = spark.read.format("binaryFile").load(path).filter(F.col("shard") >= first_slot // per_shard)

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = content.as_buffer()
                n = len(view) // stride
                for k in range(0, n, 1024):
                    upto = min(n, k + 1024)
                    yield pa.RecordBatch.from_arrays([pa.array(range(shard * per_shard + k, shard * per_shard + upto), pa.int64()), pa.array([view.slice(i * stride, 2 * room).to_pybytes() for i in range(k, upto)], pa.binary())], ["slot", "ids"])

    return files.select(F.col("shard").cast("long"), "content").mapInArrow(run, "slot long, ids binary").filter(F.col("slot") >= first_slot)


def token_output(df: DataFrame, tokenizer_path: str, key: int = 20240607, **options) -> DataFrame:
    """Shards in a new folder of the shared directory; the index of ``materialise``."""
    return materialise(df, f"{shared_dir(df.sparkSession)}/shards-{uuid.uuid4().hex}", tokenizer_path, key, **options)
