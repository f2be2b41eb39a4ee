"""All pairs within a subject: blocks of rows meet in NumPy, and no pair is shuffled or carries its rows' values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions import linalg
from sigloom.functions.matrix import SIDE, batch, square
from sigloom.sources.staging import stage

#: Rows of a block, and pairs measured at once.
BLOCK, AT_ONCE = 1024, 1 << 14
#: Tiles of a key's rows that pairs come from, while a tile has no more rows than that.
TILES, MOST_ROWS = 8, 1 << 15

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _summed(a: np.ndarray, b: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Entry by entry in their order, as the column forms and SQL add them."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += of(x[:, None], y)
    return total


def _square_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    d *= d
    return d


def _size_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.abs(d, out=d)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_summed(a, b, _square_of))


def cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, _size_of)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda v: np.sqrt(_summed(v, np.zeros((1, v.shape[1])), _square_of)[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - _summed(a, b, np.multiply) / (norm(a)[:, None] * norm(b))


def riemann(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return linalg.riemann_distances(square(a), square(b))


def weighted_reference(reference: np.ndarray) -> Measure:
    """Distance of upper triangles weighted by a reference matrix."""
    return lambda a, b: linalg.weighted_reference_distances(a, b, reference)


def measured_pairs(df: DataFrame, measures: dict[str, tuple[str, Measure]], key: str = "subject_id", index: str = "i", block: int = BLOCK) -> DataFrame:
    """(key, i, j, a double per measure) of all pairs i < j of a key, indexes being whole numbers from 0.

    A measure is a column of lists and a function of two arrays, of which every row of one meets every row of the other. A key's rows are cut in ``TILES`` tiles of ``block`` rows at
    least, and a row goes to as many pairs of tiles as there are tiles, once each; pairs leave the tasks measured, batch by batch. Work grows with the pairs, what shuffles
    with the rows alone (beyond ``TILES * MOST_ROWS`` rows of a key, with rows times tiles). A task holds two tiles and a batch of pairs. A pair with a missing list or entry, or with lists of unlike lengths, has null
    measures; rows without a key or an index have no pairs.
    """
    columns = list(dict.fromkeys(c for c, _ in measures.values()))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("i", df.schema[index].dataType), T.StructField("j", df.schema[index].dataType), *[T.StructField(name, T.DoubleType()) for name in measures]])
    rows = _pair_rows(df, columns, key, index)
    n = F.max("__i") + 1
    sizes = rows.groupBy(F.col("__k").alias("__of")).agg(F.max("__i").alias("__most"), F.greatest(F.lit(block), F.least(F.lit(MOST_ROWS), F.ceil(n / TILES))).cast("long").alias("__rows"))
    tile = lambda c: F.floor(F.col(c) / F.col("__rows")).cast("long")
    placed = rows.join(sizes, F.col("__k") == F.col("__of")).withColumns({"__p": tile("__i"), "__last": tile("__most")})
    met = placed.select("__k", "__p", F.explode(F.sequence(F.lit(0).cast("long"), "__last")).alias("__o"), "__i", *columns)
    dealt = met.select("__k", F.least("__p", "__o").alias("__a"), F.greatest("__p", "__o").alias("__b"), "__p", "__i", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        one = both.filter(pc.equal(both["__p"], both["__a"]))
        two = one if both["__a"][0] == both["__b"][0] else both.filter(pc.equal(both["__p"], both["__b"]))
        for arrays in _met(one, two, measures, columns):
            yield pa.RecordBatch.from_arrays(arrays, [key, "i", "j", *measures])

    # As many tasks as shuffles have: tiles are few bytes and much work, so their sizes must not bring them together.
    tasks, by = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["__k", "__a", "__b"]
    return dealt.repartition(tasks, *by).groupBy(*by).applyInArrow(run, schema)


def measured_blocks(df: DataFrame, value: str, measure: Measure, key: str = "subject_id", index: str = "i", block: int = BLOCK) -> DataFrame:
    """(g, p, q, n, lo, hi, block): the distances of all pairs of a key, of which there are ``n`` rows, as doubles in blocks.

    Indexes are gapless from 0. ``block`` has the rows of chunk p of ``SIDE`` indexes beside those of chunk q, p <= q, as bytes; one of p = q is whole, with zeros along the
    middle. ``lo`` and ``hi`` are the ends of its distances of pairs, null without any. Distances are those of ``measured_pairs``; missing ones are NaN. Keys of one row have no block.
    """
    kind = T.StructField("g", df.schema[key].dataType)
    schema = T.StructType([kind, *[T.StructField(c, T.LongType()) for c in ("p", "q", "n")], T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("block", T.BinaryType())])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if one.num_rows and two.num_rows and one["__n"][0].as_py() > 1:
            two = two.rename_columns([c for c in one.column_names if c != "__n"])
            first = [int(one["__p"][0].as_py()) * block, int(two["__q"][0].as_py()) * block]
            d = np.full((one.num_rows, two.num_rows), np.nan)
            for size, i, a in _alike(one, [value]):
                for other, j, b in _alike(two, [value]):
                    if size == other and size[0] >= 0:
                        at_i, at_j, step = i.to_numpy() - first[0], j.to_numpy() - first[1], max(1, AT_ONCE // len(j))
                        for k in range(0, len(at_i), step):
                            d[np.ix_(at_i[k : k + step], at_j)] = measure(a[value][k : k + step], b[value])
            for k in range(0, d.shape[0], SIDE):
                for m in range(k if first[0] == first[1] else 0, d.shape[1], SIDE):
                    p, q, own = (first[0] + k) // SIDE, (first[1] + m) // SIDE, d[k : k + SIDE, m : m + SIDE]
                    known = own
                    if p == q:
                        known, own = own[np.triu_indices(len(own), 1)], np.triu(own, 1)
                        own = own + own.T
                    known = known[~np.isnan(known)]
                    for column, x in zip(out, (p, q, one["__n"][0].as_py(), known.min() if known.size else None, known.max() if known.size else None, own.tobytes()), strict=True):
                        column.append(x)
        types = [*[pa.int64()] * 3, *[pa.float64()] * 2, pa.binary()]
        key_column = pa.repeat(one["__k"][0], len(out[0])) if out[0] else pa.array([], one.schema.field("__k").type)
        return pa.Table.from_arrays([key_column, *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], [f.name for f in schema])

    return _block_pairs(df, [value], key, index, block, run, schema, counted=True)


def _pair_rows(df: DataFrame, columns: list[str], key: str, index: str) -> DataFrame:
    return stage(df.select(F.col(key).alias("__k"), F.col(index).alias("__i"), *columns).filter("__k IS NOT NULL AND __i IS NOT NULL"), "pair-rows")


def _block_pairs(df: DataFrame, columns: list[str], key: str, index: str, block: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, counted: bool = False) -> DataFrame:
    """``run`` of every two blocks of a key's rows, the earlier first; ``counted``: the first's rows have the key's number of indexes."""
    spark = df.sparkSession
    rows = _pair_rows(df, columns, key, index).withColumn("__p", F.floor(F.col("__i") / block))
    most = rows.groupBy(F.col("__k").alias("__of")).agg(F.max("__p").alias("__most"), (F.max("__i") + 1).cast("long").alias("__n"))
    left = rows.join(most, F.col("__k") == F.col("__of")).select("__k", F.col("__p"), F.explode(F.sequence("__p", "__most")).alias("__q"), "__i", *columns, *["__n"] * counted)
    right = rows.select("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__p"))).alias("__o"), "__p", "__i", *columns)
    right = right.select(*[F.col(c).alias(f"{c}_2") for c in right.columns])

    # As many tasks as shuffles have: blocks are few bytes and much work, so their sizes must not bring them together.
    tasks, by, of = int(spark.conf.get("spark.sql.shuffle.partitions")), ["__k", "__p", "__q"], ["__k_2", "__o_2", "__p_2"]
    return left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *of).groupBy(*of)).applyInArrow(run, schema)


def _alike(table: pa.Table, columns: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Array, dict[str, np.ndarray]]]:
    """Rows by the lengths of their lists, -1 for a missing one or one with a missing entry: lengths, indexes, values of the whole ones."""
    lengths = []
    for c in columns:
        column = table[c].combine_chunks()
        size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if column.flatten().null_count:
            size[[v is not None and None in v for v in column.to_pylist()]] = -1
        lengths.append(size)
    lengths = np.stack(lengths, 1)
    for of in np.unique(lengths, axis=0):
        some = table.take(pa.array(np.flatnonzero((lengths == of).all(1))))
        yield tuple(of), some["__i"].combine_chunks(), {c: batch(some[c]) for c, n in zip(columns, of, strict=True) if n >= 0}


def _met(one: pa.Table, two: pa.Table, measures: dict[str, tuple[str, Measure]], columns: list[str]) -> Iterator[list[pa.Array]]:
    if not one.num_rows or not two.num_rows:
        return
    one, two = one.sort_by("__i"), two.sort_by("__i")
    subject, others = one["__k"][0], list(_alike(two, columns))
    for size, i, a in _alike(one, columns):
        for other, j, b in others:
            same = {c for c, m, n in zip(columns, size, other, strict=True) if m == n >= 0}
            at_i, at_j, k = i.to_numpy(), j.to_numpy(), 0
            while k < len(i):
                # Of the other rows only those after the first of these.
                after = int(np.searchsorted(at_j, at_i[k], "right"))
                if after == len(at_j):
                    break
                some = slice(k, k + max(1, AT_ONCE // (len(at_j) - after)))
                values = [f(a[c][some], b[c][after:]).ravel() if c in same else None for c, f in measures.values()]
                left, right = np.repeat(at_i[some], len(at_j) - after), np.tile(at_j[after:], len(at_i[some]))
                if at_i[some][-1] >= at_j[after]:
                    keep = left < right
                    left, right, values = left[keep], right[keep], [v if v is None else v[keep] for v in values]
                yield [pa.repeat(subject, len(left)), pa.array(left, i.type), pa.array(right, j.type), *[pa.nulls(len(left), pa.float64()) if v is None else pa.array(v, pa.float64()) for v in values]]
                k = some.stop
