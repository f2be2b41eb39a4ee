"""Exact top-k inner products over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.staging import small_batches, stage

PER_BLOCK = 1024
PER_CHUNK = 256
PER_TASK = 100_000
#: How many blocks of a query's order each round ends at; the last visits all others that can hold a result.
ROUNDS = (2, 8, 40, None)
BLOCK = "block int, keys binary, ids binary, vectors binary, width int"
FOUND = "query_key long, vec_id long, score long"


def as_integers(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(``key``, ``id``, ``v`` array<long>): floor(scale * x); rows with a null id or vector, or a null or non-finite component, go.

    ``key`` tells rows apart, whatever their ids; it is only stable once written.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(fine)
    return rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.transform(x, lambda y: F.floor(scale * y)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, shorter ones filled with zeros (which leave inner products alone)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def choose_pivots(vectors: DataFrame, width: int, pivots: int, sample: int) -> np.ndarray:
    """``pivots`` centres: a few rounds of k-means on the ``sample`` vectors with the smallest id hashes."""
    table = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow()
    points = np.concatenate([_matrix(x, width) for x in table.column(0).chunks] or [np.zeros((0, width))]).astype(np.float64)
    centres = points[: max(1, min(pivots, len(points)))]
    for _ in range(8):
        nearest = (np.square(centres).sum(1) - 2 * points @ centres.T).argmin(1) if len(points) else np.zeros(0, int)
        for k in range(len(centres)):
            if (own := points[nearest == k]).size:
                centres[k] = own.mean(0)
    return centres if len(centres) else np.zeros((1, width))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.square(x).sum(1)[:, None] + np.square(pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def build_index(vectors: DataFrame, pivots: np.ndarray, width: int) -> tuple[DataFrame, pd.DataFrame]:
    """Blocks of at most about ``PER_BLOCK`` vectors of one pivot and annulus, and a table of the annuli: pivot, distance range, greatest norm, first block, blocks, vectors.

    Every vector is keyed by its nearest pivot and distance. An annulus spans a 64th of the pivot's greatest distance, so there are 65 a
    pivot at most, whatever the number of vectors; one with more vectors than a block is dealt to several by the key's hash, so equal vectors do not meet in one task.
    """
    session = vectors.sparkSession
    shared = session.sparkContext.broadcast(pivots)

    def place(batches):
        for b in batches:
            x = _matrix(b.column(2), width).astype(np.float64)
            d = distances(x, shared.value) if b.num_rows else np.zeros((0, 1))
            norm = np.sqrt(np.square(x).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1) if len(d) else [], pa.float64()), pa.array(norm)], ["key", "id", "v", "pivot", "r", "norm"])

    keyed = stage(vectors.mapInArrow(place, "key long, id long, v array<long>, pivot int, r double, norm double"), "keyed")
    shared.destroy()
    reach = keyed.groupBy(F.col("pivot").alias("__p")).agg(F.max("r").alias("most"))
    # One row per pivot, and per pivot and annulus: both bounded by the settings.
    ringed = keyed.join(F.broadcast(reach), F.col("pivot") == F.col("__p")).withColumn("ring", F.when(F.col("most") > 0, F.floor(64 * F.col("r") / F.col("most"))).otherwise(0).cast("int"))
    sums = ringed.groupBy("pivot", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("n"))
    rings = sums.orderBy("pivot", "ring").toPandas()
    rings["deals"] = -(-rings.n // PER_BLOCK)
    rings["first"] = rings.deals.cumsum() - rings.deals
    table = session.createDataFrame([tuple(map(int, r)) for r in rings[["pivot", "ring", "first", "deals"]].itertuples(index=False)], "__q int, __r int, first int, deals int")
    dealt = ringed.join(F.broadcast(table), (F.col("pivot") == F.col("__q")) & (F.col("ring") == F.col("__r")))
    dealt = dealt.select("key", "id", "v", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("deals"))).cast("int").alias("block"))
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-int(rings.n.sum()) // PER_TASK))

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        keys, ids, block = (table.column(c).to_numpy() for c in ("key", "id", "block"))
        x = _matrix(table.column("v").chunk(0), width)
        order = np.lexsort((keys, ids, block))
        keys, ids, block, x = (c[order] for c in (keys, ids, block, x))
        new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        rows = []
        for lo, hi in zip(new, [*new[1:], len(ids)], strict=True):
            own = x[lo:hi]
            small = np.int16 if np.abs(own.astype(np.float64)).max(initial=0) < 2**15 else np.int64
            rows.append((int(block[lo]), keys[lo:hi].astype("<i8").tobytes(), ids[lo:hi].astype("<i8").tobytes(), own.astype(small).tobytes(), np.dtype(small).itemsize))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCK.split(", ")]).astype({"block": "int32", "width": "int32"}), preserve_index=False)

    return stage(dealt.repartition(parts, "block").mapInArrow(pack, BLOCK), "blocks"), rings


def upper_bounds(q: np.ndarray, to_pivot: np.ndarray, lo: np.ndarray | float, hi: np.ndarray | float, norm: np.ndarray | float) -> np.ndarray:
    """Greatest inner product that a vector of an annulus can have with each query.

    By the triangle inequality it is no nearer to the query than the gap between the query's distance to the pivot and
    the annulus, and 2qx = |q|^2 + |x|^2 - |q - x|^2. The last term allows for rounding.
    """
    gap = np.maximum(0, np.maximum(to_pivot - hi, lo - to_pivot))
    squares = np.square(q).sum(1)
    return np.minimum((squares + norm**2 - gap**2) / 2, np.sqrt(squares) * norm) * (1 + 1e-9) + 1e-6 * (squares + norm**2) + 1


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats while every partial sum is below 2^53, else by 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(x.astype(np.float64)).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _asks(pivots: np.ndarray, rings: pd.DataFrame, width: int, since: int, until: int | None):
    """Runs on (key, v, floor): the blocks from place ``since`` to ``until`` of each query's order, best bounds first, as far as they can reach its floor."""
    lo, hi, norm, deals, first = (rings[c].to_numpy() for c in ("lo", "hi", "norm", "deals", "first"))
    pivot = rings["pivot"].to_numpy()

    def run(batches):
        for b in batches:
            keys, blocks = [], []
            q = _matrix(b.column(1), width).astype(np.float64)
            away = distances(q, pivots) if len(q) else np.zeros((0, len(pivots)))
            for k, (key, floor) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                bound = upper_bounds(q[k : k + 1], away[k, pivot], lo, hi, norm)
                order = np.argsort(-bound, kind="stable")
                ends = deals[order].cumsum()
                begins = ends - deals[order]
                met = (ends > since) & (begins < (until if until is not None else np.inf)) & ((bound[order] >= floor) if floor is not None else True)
                for at, begin in zip(order[met].tolist(), begins[met].tolist(), strict=True):
                    some = range(max(0, since - begin), int(deals[at]) if until is None else min(int(deals[at]), until - begin))
                    blocks += [int(first[at]) + d for d in some]
                    keys += [key] * len(some)
                if len(keys) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.int32())], ["key", "block"])
                    keys, blocks = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.int32())], ["key", "block"])

    return run


def _scores(k: int, width: int):
    """Runs on (asked, keys, ids, vectors, width): of each block the ``k`` best candidates of each query that asks it, none below the query's floor."""

    def run(batches):
        for b in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            for asked, own, names, vectors, size in zip(b.column(0), *(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                rows = asked.values
                keys = rows.field("key").to_numpy()
                floors = rows.field("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
                q = _matrix(rows.field("v"), width).astype(np.float64)
                own, names = np.frombuffer(own, "<i8"), np.frombuffer(names, "<i8")
                x = np.frombuffer(vectors, np.int16 if size == 2 else np.int64).reshape(len(names), -1)
                score = _products(q, x)
                row, col = np.nonzero((own[None, :] != keys[:, None]) & (score >= floors[:, None]))
                order = np.lexsort((names[col], ~score[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, col = row[place < k], col[place < k]
                for held, more in zip(found, (keys[row], names[col], score[row, col]), strict=True):
                    held.append(more)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found], ["query_key", "vec_id", "score"])

    return run


def top_k(df: DataFrame, query_ids, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64, sample: int = 4096, rounds: tuple[int | None, ...] = ROUNDS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every query its ``k`` largest integer inner products.

    Components become floor(1024 * x). ``query_ids``: a condition on ``id``. Candidates are all rows but the query's own; with
    fewer than ``k`` all are returned; ties go to the smaller id. Rows with a null id, a null vector, or null or non-finite
    components take no part. Rows of the same id are rows of their own, as candidates and as queries, each with its own ranks. Vectors of unequal
    length are compared as if filled with zeros. Scores are exact while they fit in a long. Pivots are fitted on ``sample`` vectors; all are
    indexed. Other columns are not read. An empty table gives no rows.

    Annuli are a bounded table, from which each query has its own order of blocks, best bound first. It expands them in rounds: the first two, then as many as
    ``rounds`` says, and at last all, each time only those whose bound reaches its k-th score so far. Queries meet blocks in a join, by up to ``PER_CHUNK`` a row,
    and what is below a query's score never leaves the worker, so that the rows found are a few more than ``k`` a query, however many blocks there are.
    """
    spark = df.sparkSession
    vectors = stage(as_integers(df, id_col, vector_col), "vectors")
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    centres = choose_pivots(vectors, width, pivots, sample)
    index, rings = build_index(vectors, centres, width)
    asked = vectors.filter(query_ids).select("key", "id", "v")
    best = spark.createDataFrame([], FOUND)
    since = 0
    for until in rounds:
        kth = _ranked(best, k).filter(F.col("rank") == k).select(F.col("query_key").alias("__k"), F.col("score").alias("floor"))
        now = stage(asked.join(kth, F.col("key") == F.col("__k"), "left").select("key", "v", "floor"), "asking")
        asks = stage(now.mapInArrow(_asks(centres, rings, width, since, until), "key long, block int"), "asks")
        if asks.isEmpty():
            break
        found = _met(now, asks, index, k, width)
        best = stage(_ranked(best.unionByName(found), k).drop("rank"), "best")
        since = until
    names = asked.select(F.col("key").alias("__key"), F.col("id").alias("query_id"))
    out = _ranked(best, k).join(names, F.col("query_key") == F.col("__key"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(now: DataFrame, asks: DataFrame, index: DataFrame, k: int, width: int) -> DataFrame:
    """Blocks with the queries that ask them, in chunks: a block that all ask is many rows, and no row holds more than a block and a chunk."""
    counts = asks.groupBy(F.col("block").alias("__b")).agg(F.ceil(F.count("*") / PER_CHUNK).alias("chunks"))
    dealt = asks.join(counts, F.col("block") == F.col("__b")).select(F.col("key").alias("__key"), F.col("block").alias("__block"), F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"))
    rows = dealt.join(now, F.col("__key") == F.col("key"))
    chunks = rows.groupBy("__block", "chunk").agg(F.collect_list(F.struct("key", "floor", "v")).alias("asked"))
    with small_batches(now.sparkSession, 16):
        return stage(chunks.join(index, F.col("__block") == F.col("block")).select("asked", "keys", "ids", "vectors", "width").mapInArrow(_scores(k, width), FOUND), "scored")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query."""
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
