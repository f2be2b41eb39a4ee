"""Matrix operators on DataFrames: Arrow batches of flat matrices go to NumPy, batch by batch."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import linalg
from sigloom.operators.joins import lookup_subject_matrix

MATRIX = "array<double>"
#: Points of a block's side, see ``sigloom.functions.pairs``; blocks of an Arrow batch; points, of two numbers each, that may be sent to all tasks.
SIDE, _BLOCKS_AT_ONCE, _SENT_POINTS = 256, 16, 1_000_000


def batch(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column with equal lengths as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows.reshape(len(rows), -1), float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def square(rows: np.ndarray) -> np.ndarray:
    p = round(np.sqrt(rows.shape[1])) if rows.size else 0
    return rows.reshape(len(rows), p, p)


def shaped(f: Callable[..., np.ndarray], *columns: Column | str) -> Column:
    """``f`` of arrays (one per column) to an array of rows. Rows are grouped by their sizes first, so one batch may hold many shapes."""

    @F.arrow_udf(MATRIX)
    def run(*args: pa.Array) -> pa.Array:
        sizes = np.stack([a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for a in args], 1)
        out: list = [None] * len(sizes)
        for size in np.unique(sizes, axis=0) if len(sizes) else []:
            if (size < 0).any():
                continue
            at = np.flatnonzero((sizes == size).all(1))
            rows = f(*[batch(a.take(pa.array(at))) for a in args])
            for i, row in zip(at, rows.reshape(len(at), -1), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return run(*columns)


def covariance(sample: Column | str, n_channels: int, shrink: bool = True) -> Column:
    """Covariance of a flat channels x times matrix, with OAS shrinkage or plain."""
    of = linalg.oas if shrink else linalg.covariances
    return shaped(lambda x: of(x.reshape(len(x), n_channels, -1)), sample)


def riemann_distance(a: Column | str, b: Column | str) -> Column:
    return shaped(lambda x, y: linalg.riemann_distance(square(x), square(y)), a, b)[0]


def matrix_function(c: Column | str, name: str) -> Column:
    """``sqrtm``, ``invsqrtm``, ``logm``, ``expm`` or ``inv`` of a flat symmetric matrix."""
    f = np.linalg.inv if name == "inv" else getattr(linalg, name)
    return shaped(lambda x: f(square(x)), c)


def congruence(e: Column | str, c: Column | str) -> Column:
    """E C E'."""
    return shaped(lambda x, y: square(x) @ square(y) @ square(x).swapaxes(1, 2), e, c)


def transport_matrix(mean: Column | str, general: Column | str) -> Column:
    return shaped(lambda m, g: np.stack([linalg.transport_matrix(x, y) for x, y in zip(square(m), square(g), strict=True)]), mean, general)


def tangent_vector(c: Column | str, reference: Column | str) -> Column:
    """Upper triangle of the log map at the reference, one per row; equal references are worked out together."""

    def run(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(r, axis=0, return_inverse=True)
        out = None
        for k, reference in enumerate(square(kinds)):
            rows = linalg.tangent(square(x[which.ravel() == k]), reference)
            out = np.zeros((len(x), rows.shape[1])) if out is None else out
            out[which.ravel() == k] = rows
        return out

    return shaped(run, c, reference)


def weighted_reference_distance(x: Column | str, y: Column | str, reference: Column | str) -> Column:
    return shaped(lambda a, b, r: linalg.weighted_reference_distance(a, b, square(r)), x, y, reference)[0]


def third_moments(sample: Column | str, n_channels: int) -> Column:
    return shaped(lambda x: linalg.third_moments(x.reshape(len(x), n_channels, -1)), sample)


def apply_matrix(w: Column | str, sample: Column | str) -> Column:
    """W X of a flat square matrix and a flat channels x times one."""
    return shaped(lambda a, x: square(a) @ x.reshape(len(x), square(a).shape[1], -1), w, sample)


def filtered(w: Column | str, c: Column | str, log: bool = True) -> Column:
    """Log variances of a covariance through filters (flat filters x channels), or the filtered matrix."""

    def run(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = square(x)
        f = a.reshape(len(a), -1, s.shape[1])
        out = f @ s @ f.swapaxes(1, 2)
        return np.log(np.maximum(np.einsum("nii->ni", out), 1e-300)) if log else out

    return shaped(run, w, c)


def group_sums(df: DataFrame, by: list[str], columns: list[str], f: Callable[..., np.ndarray], name: str = "sums") -> DataFrame:
    """(by, ``name``): the sum over each group of vectors of one length; ``f`` turns a group's rows of a batch to such a vector.

    ``f`` gets an Arrow array per column. A batch gives one vector a group that it meets, Spark adds their entries, so no task holds a
    group and what shuffles is not rows but partial sums.
    """
    keys = [_arrow_type(df, b) for b in by]
    target = pa.schema([*[(b, t) for b, t in zip(by, keys, strict=True)], ("at", pa.int32()), ("v", pa.float64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            groups = table.select(by).to_pandas().groupby(by, dropna=False, sort=False).indices.values() if by else [np.arange(len(table))]
            for at in groups:
                own = table.take(pa.array(at))
                flat = np.asarray(f(*[own.column(c).combine_chunks() for c in columns]), float).ravel()
                given = [pa.repeat(own.column(k)[0], len(flat)) for k in by]
                yield pa.RecordBatch.from_arrays([*given, pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], schema=target)

    kinds = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
    partial = df.select(*by, *columns).mapInArrow(run, ", ".join([*kinds, "at int", "v double"]))
    entries = partial.groupBy(*by, "at").agg(F.sum("v").alias("v"))
    return entries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(name))


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(name).schema).field(0).type


def riemann_means(df: DataFrame, by: list[str], cov: str = "cov", weight: str | None = None, tolerance: float = 1e-8, most: int = 50) -> DataFrame:
    """(by, ``mean``, ``n``): the weighted mean matrix of every group.

    One round of Spark per step, for all groups at once: the current means are joined to the rows, each batch adds up its
    rows' logarithms by group, and the sums combine (see ``group_sums``). It stops when the largest step is below ``tolerance``, and
    warns if it is not after ``most`` rounds. ``df`` is read once a round: stage what is dear. The largest step is all that the driver gets.
    """
    from sigloom.sources.staging import stage

    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col(cov).alias("__c"), w.cast("double").alias("__w"))
    names = [F.col(b).alias(f"__by_{b}") for b in by]
    meet = lambda left, right: left.join(right, [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]) if by else left.crossJoin(F.broadcast(right))

    def plain(c: pa.Array, v: pa.Array) -> np.ndarray:
        weights = v.to_numpy(zero_copy_only=False)
        return np.concatenate([[weights.sum()], weights @ batch(c)])

    def logs(c: pa.Array, v: pa.Array, m: pa.Array) -> np.ndarray:
        inverse, weights = linalg.invsqrtm(square(batch(m.slice(0, 1)))[0]), v.to_numpy(zero_copy_only=False)
        return np.concatenate([[weights.sum()], weights @ linalg.logm(inverse @ square(batch(c)) @ inverse).reshape(len(weights), -1)])

    def step_of(s: np.ndarray) -> np.ndarray:
        return s[:, 1:] / s[:, :1]

    means = stage(group_sums(rows, by, ["__c", "__w"], plain).select(*by, shaped(step_of, "sums").alias("mean"), F.col("sums")[0].alias("n")), "means")
    for _ in range(most):
        steps = group_sums(meet(rows, means.select(*names, F.col("mean").alias("__mean"))), by, ["__c", "__w", "__mean"], logs, "__sums").select(*names, shaped(step_of, "__sums").alias("__step"))
        move = shaped(lambda m, s: _moved(square(m), square(s)), "mean", "__step")
        size = F.sqrt(F.aggregate("__step", F.lit(0.0), lambda a, v: a + v * v))
        means = stage(meet(means, steps).select(*by, move.alias("mean"), "n", size.alias("__size")), "means")
        largest = means.agg(F.max("__size")).first()[0] or 0.0
        if largest < tolerance:
            break
    else:
        warnings.warn(f"means moved by {largest:.1e} in the last of {most} rounds", stacklevel=2)
    return means.select(*by, "mean", "n")


def _moved(mean: np.ndarray, step: np.ndarray) -> np.ndarray:
    root = linalg.sqrtm(mean)
    out = root @ linalg.expm((step + step.swapaxes(1, 2)) / 2) @ root
    return (out + out.swapaxes(1, 2)) / 2


def subject_means(df: DataFrame, cov: str = "cov", key: str = "subject_id") -> DataFrame:
    return riemann_means(df, [key], cov)


def general_mean(means: DataFrame) -> DataFrame:
    """One row: count-weighted mean of the subjects' means, its inverse, and the mean count cut to whole rows (``cap``)."""
    general = riemann_means(means.withColumnRenamed("n", "__count"), [], "mean", "__count")
    cap = means.agg(F.floor(F.avg("n")).alias("cap"))
    return general.withColumn("inverse", matrix_function("mean", "inv")).crossJoin(cap)


def general_mean_excluding(means: DataFrame, key: str = "subject_id") -> DataFrame:
    """(fold, mean, n): for every subject the general mean of the others; subjects' means are not fitted anew.

    One row per pair of subjects; a table of means has a row per subject.
    """
    folds = means.select(F.col(key).alias("fold")).distinct()
    others = folds.join(means, folds["fold"] != means[key]).withColumnRenamed("n", "__count")
    return riemann_means(others, ["fold"], "mean", "__count")


def parallel_transport(df: DataFrame, means: DataFrame, general: DataFrame, cov: str = "cov", key: str = "subject_id") -> DataFrame:
    """Move every subject's matrices so that its mean becomes the general mean; a subject without a mean fails the job."""
    e = means.crossJoin(F.broadcast(general.select(F.col("mean").alias("__g")))).select(key, transport_matrix("mean", "__g").alias("__e"), F.col("n").alias("__n"))
    return lookup_subject_matrix(df, e, key, count="__n", kept="__e").withColumn(cov, congruence("__e", cov)).drop("__e", "__n")


def pooled_moments(df: DataFrame, by: list[str], n_channels: int, sample: str = "sample", finite: bool = False) -> DataFrame:
    """(by, n, ``moments``): sums and products of the channels over all samples of all windows of a group; ``finite``: only over times without a gap."""

    def add(samples: pa.Array) -> np.ndarray:
        x = _times(samples, n_channels, finite)
        return np.concatenate([[x.shape[1]], x.sum(1), (x @ x.T).ravel()])

    sums = group_sums(df, by, [sample], add)
    return sums.select(*by, F.col("sums")[0].alias("n"), F.slice("sums", 2, F.size("sums")).alias("moments"))


def _pooled(n: np.ndarray, m: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of pooled moments."""
    mean = m[:, :p] / n[:, :1]
    return mean, m[:, p:].reshape(len(m), p, p) / n[:, :1, None] - mean[:, :, None] * mean[:, None, :]


def _times(samples: pa.Array, n_channels: int, finite: bool = False) -> np.ndarray:
    """Windows of any lengths side by side, channels x times."""
    x = np.concatenate([np.asarray(v, float).reshape(n_channels, -1) for v in samples.to_pylist() if v is not None] or [np.zeros((n_channels, 0))], 1)
    return x[:, np.isfinite(x).all(0)] if finite else x


def pooled_covariance(df: DataFrame, by: list[str], n_channels: int, sample: str = "sample") -> DataFrame:
    """(by, n, ``cov``, ``whitening``): OAS covariance of all samples of a group and its inverse root."""

    def finish(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return linalg.shrink_oas(_pooled(n, m, n_channels)[1], n[:, 0])

    pooled = pooled_moments(df, by, n_channels, sample).withColumn("cov", shaped(finish, F.array("n"), "moments"))
    return pooled.withColumn("whitening", matrix_function("cov", "invsqrtm")).drop("moments")


def apply_whitening(df: DataFrame, whitening: DataFrame, key: str = "subject_id", sample: str = "sample") -> DataFrame:
    """W X per subject; a subject without a matrix fails the job."""
    w = whitening.select(key, F.col("whitening").alias("__w"), F.col("n").alias("__n"))
    return lookup_subject_matrix(df, w, key, count="__n", kept="__w").withColumn(sample, apply_matrix("__w", sample)).drop("__w", "__n")


def csp_of_means(means: DataFrame, by: list[str], filters: int, label: str = "label") -> DataFrame:
    """(by, ``filters``, ``patterns``): flat filters x channels of the means (``mean``) of classes 0 and 1 of every group; groups of one class go."""
    pick = lambda k: F.max(F.when(F.col(label) == k, F.struct("mean"))).getField("mean").alias(f"c{k}")
    both = means.groupBy(*by).agg(pick(0), pick(1)).filter("c0 IS NOT NULL AND c1 IS NOT NULL")
    fit = lambda at: shaped(lambda a, b: np.stack([linalg.csp(x, y, filters)[at] for x, y in zip(square(a), square(b), strict=True)]), "c0", "c1")
    return both.withColumns({"filters": fit(0), "patterns": fit(1)}).drop("c0", "c1")


def csp_fit(df: DataFrame, by: list[str], filters: int, cov: str = "cov", label: str = "label") -> DataFrame:
    """``csp_of_means`` with the means of the rows of every group and class."""
    return csp_of_means(riemann_means(df, [*by, label], cov), by, filters, label)


def mds_embed(distances: DataFrame, by: str = "subject_id", d: str = "d", largest: int = 6000, rounds: int = 300, tolerance: float = 1e-7) -> DataFrame:
    """Points (by, i, x, y) whose distances fit those of a table of all pairs i < j, or of blocks (see ``measured_blocks``; ``i`` counts from 0): a ``landmark_start``, then stress majorisation.

    Every group takes the same steps from the same start to the same end, block by block. Where they are worked out depends on its size: the blocks of a group of at most ``largest`` points,
    of bounded size, stream to one task; of larger ones each step is a Spark round (see ``mds_rounds``). It warns if the stress of any still falls after
    ``rounds``. Points are centred, turned to their principal axes and made positive at the farthest point of each axis.
    """
    from sigloom.sources.staging import small_batches, stage

    spark = distances.sparkSession
    with small_batches(spark, _BLOCKS_AT_ONCE):
        if "block" in distances.columns:
            blocks = stage(distances.filter("g IS NOT NULL"), "mds-blocks")
            ids = blocks.filter("p = 0 AND q = 0").select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("r")).withColumn("i", F.col("r"))
        else:
            pairs = stage(distances.select(F.col(by).alias("g"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(d).cast("double").alias("d")).filter("g IS NOT NULL"), "mds-pairs")
            ends = pairs.select("g", "i").unionByName(pairs.select("g", F.col("j").alias("i"))).distinct()
            own = Window.partitionBy("g")
            ids = stage(ends.select("g", "i", F.count("*").over(own).alias("n"), (F.row_number().over(own.orderBy("i")) - 1).cast("long").alias("r")), "mds-ids")
            blocks = stage(_blocks_of_pairs(pairs, ids), "mds-blocks")
        start = stage(landmark_start(blocks, ids), "mds-start")
        kind = blocks.schema["g"].dataType.simpleString()
        # Many more tasks than groups, so that few tasks have to work out two.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, 8 * blocks.filter(f"p = 0 AND q = 0 AND n <= {largest}").count()))
        small = _with_points(blocks.filter(F.col("n") <= largest), start).repartition(tasks, "g").sortWithinPartitions("g", "p", "q")
        points = stage(small.mapInArrow(_embedded(rounds, tolerance), f"g {kind}, p long, x array<double>, y array<double>, open boolean"), "mds-points")
        if not points.filter("open").isEmpty():
            warnings.warn(f"the stress of some groups still falls after {rounds} rounds", stacklevel=2)
        points = points.drop("open")
        large = blocks.filter(F.col("n") > largest)
        if not large.isEmpty():
            groups = large.filter("p = 0 AND q = 0").select(F.col("g").alias("__g"))
            points = points.unionByName(mds_rounds(large, start.join(groups, F.col("g") == F.col("__g"), "left_semi"), rounds, tolerance))
    each = points.select("g", "p", F.posexplode(F.arrays_zip("x", "y")).alias("at", "v")).select(F.col("g").alias("__g"), (F.col("p") * SIDE + F.col("at")).alias("__r"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    named = each.join(ids.select("g", "r", "i"), (F.col("g") == F.col("__g")) & (F.col("r") == F.col("__r"))).select("g", "i", "x", "y")
    return _to_axes(stage(named, "mds-points")).withColumnRenamed("g", by)


def _blocks_of_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(g, p, q, n, lo, hi, block) of (g, i, j, d), all pairs of a group once, and the ranks of ``ids`` (g, i, n, r)."""
    of = lambda c: ids.select(F.col("g").alias(f"__g{c}"), F.col("i").alias(f"__i{c}"), F.col("r").alias(f"__r{c}"), F.col("n").alias(f"__n{c}"))
    met = pairs.join(of(1), (F.col("g") == F.col("__g1")) & (F.col("i") == F.col("__i1"))).join(of(2), (F.col("g") == F.col("__g2")) & (F.col("j") == F.col("__i2")))
    ranked = met.select("g", F.col("__n1").alias("n"), F.least("__r1", "__r2").alias("r"), F.greatest("__r1", "__r2").alias("s"), "d").withColumns({"p": F.floor(F.col("r") / SIDE), "q": F.floor(F.col("s") / SIDE)})
    # The block of a last chunk of one point has no pair.
    alone = ids.filter((F.col("r") == F.col("n") - 1) & (F.col("r") % SIDE == 0)).select("g", "n", "r", F.col("r").alias("s"), F.lit(0.0).alias("d"), F.floor(F.col("r") / SIDE).alias("p"), F.floor(F.col("r") / SIDE).alias("q"))
    kind = pairs.schema["g"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        p, q, n = (rows[c][0].as_py() for c in ("p", "q", "n"))
        out = np.full((min(SIDE, n - p * SIDE), min(SIDE, n - q * SIDE)), np.nan)
        if p == q:
            np.fill_diagonal(out, 0)
        at, other, d = rows["r"].to_numpy() - p * SIDE, rows["s"].to_numpy() - q * SIDE, rows["d"].to_numpy()
        out[at, other] = d
        if p == q:
            out[other, at] = d
        return pa.table([rows["g"].slice(0, 1), *[pa.array([x], pa.int64()) for x in (p, q, n)], *[pa.nulls(1, pa.float64())] * 2, pa.array([out.tobytes()], pa.binary())], ["g", "p", "q", "n", "lo", "hi", "block"])

    return ranked.unionByName(alone).groupBy("g", "p", "q").applyInArrow(run, f"g {kind}, p long, q long, n long, lo double, hi double, block binary")


def _matrix(row: dict, p: int, q: int) -> np.ndarray:
    sizes = [min(SIDE, row["n"] - k * SIDE) for k in (p, q)]
    return np.frombuffer(row["block"], float).reshape(sizes)


def _rows(batches, columns: list[str]):
    """Rows of batches, one at a time; arrays of doubles as NumPy's, bytes where they lie."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for c in columns:
                v = batch.column(c)[k]
                row[c] = v.values.to_numpy(zero_copy_only=False) if pa.types.is_list(v.type) else v.as_buffer() if pa.types.is_binary(v.type) else v.as_py()
            yield row


def _with_points(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``blocks`` with the points of their two chunks: two numbers a point are sent to all while they are few, so that no block moves."""
    few = chunks.agg(F.sum(F.size("x"))).first()[0] or 0
    sent = F.broadcast if few <= _SENT_POINTS else lambda t: t
    of = lambda c: sent(chunks.select(F.col("g").alias(f"__g{c}"), F.col("p").alias(f"__p{c}"), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")))
    met = blocks.join(of(1), (F.col("g") == F.col("__g1")) & (F.col("p") == F.col("__p1"))).join(of(2), (F.col("g") == F.col("__g2")) & (F.col("q") == F.col("__p2")))
    return met.select("g", "p", "q", "n", "block", "x1", "y1", "x2", "y2")


def _embedded(rounds: int, tolerance: float) -> Callable:
    """Whole groups in the order of their blocks: (g, p, x, y, open)."""

    def run(batches):
        group, blocks, points, kind = None, [], {}, None

        def ended():
            x, done = linalg.majorise_blocks(blocks, points, rounds, tolerance)
            pair = [pa.array([list(v[:, k]) for v in x.values()], pa.list_(pa.float64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([group] * len(x), kind), pa.array(list(x), pa.int64()), *pair, pa.array([not done] * len(x))], ["g", "p", "x", "y", "open"])

        for batch in batches:
            kind = batch.schema.field("g").type
            for row in _rows([batch], ["g", "p", "q", "n", "block", "x1", "y1", "x2", "y2"]):
                if blocks and row["g"] != group:
                    yield ended()
                    blocks, points = [], {}
                group = row["g"]
                # A copy of its own: what is kept of a batch keeps all of it.
                blocks.append((row["p"], row["q"], _matrix(row, row["p"], row["q"]).copy()))
                points |= {row[c]: np.column_stack([row[f"x{k}"], row[f"y{k}"]]) for c, k in (("p", 1), ("q", 2)) if row[c] not in points}
        if blocks:
            yield ended()

    return run


def landmark_start(blocks: DataFrame, ids: DataFrame, landmarks: int = 200) -> DataFrame:
    """(g, p, x, y), the points of each chunk: classical scaling of about ``landmarks`` points of each group, chosen by hash, and the others by their distances to those."""
    kind = blocks.schema["g"].dataType.simpleString()
    chosen = F.pmod(F.xxhash64("g", "i"), F.lit(1 << 30)) / float(1 << 30) < F.greatest(F.lit(8.0), F.lit(float(landmarks))) / F.col("n")
    marks = ids.select("g", F.floor(F.col("r") / SIDE).alias("p"), F.struct("r", chosen.cast("double").alias("m")).alias("s")).groupBy("g", "p").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["m"]).alias("x"))

    def near(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for row in _rows([batch], ["g", "p", "q", "n", "block", "x1", "x2"]):
                d, one, two = _matrix(row, row["p"], row["q"]), row["x1"] > 0, row["x2"] > 0
                for c, o, m, rows_, columns in [(row["p"], row["q"], d, one, two), (row["q"], row["p"], d.T, two, one)][: 1 + (row["p"] != row["q"])]:
                    part = np.square(m[:, columns])
                    for column, v in zip(out, (row["g"], c, o, len(m), part.tobytes(), part[rows_].tobytes()), strict=True):
                        column.append(v)
            types = [batch.schema.field("g").type, *[pa.int64()] * 3, *[pa.binary()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["g", "c", "o", "m", "part", "own"])

    from sigloom.sources.staging import stage

    seen = stage(_with_points(blocks, marks.withColumn("y", F.array())).mapInArrow(near, f"g {kind}, c long, o long, m long, part binary, own binary"), "mds-near")

    def fit(rows: pa.Table) -> pa.Table:
        flat = {(r["c"], r["o"]): np.frombuffer(r["own"], float) for r in rows.select(["c", "o", "own"]).to_pylist()}
        chunks = sorted({c for c, _ in flat})
        # A chunk's landmarks beside themselves are a square.
        size = {c: round(np.sqrt(len(flat[c, c]))) for c in chunks}
        square_ = np.block([[flat[c, o].reshape(size[c], size[o]) for o in chunks] for c in chunks])
        centre = np.eye(len(square_)) - 1 / len(square_)
        values, vectors = np.linalg.eigh(-centre @ square_ @ centre / 2)
        top = np.maximum(values[::-1][:2], 1e-12)
        axes = linalg.fix_signs(vectors[:, ::-1][:, :2].T) / np.sqrt(top)[:, None]
        return pa.table([rows["g"].slice(0, 1), lists(axes[None]), lists(square_.mean(0)[None])], ["g", "axes", "middle"])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("o")
        m, axes, middle = rows["m"][0].as_py(), *(rows[c][0].values.to_numpy(zero_copy_only=False) for c in ("axes", "middle"))
        squares = np.concatenate([np.frombuffer(p.as_buffer(), float).reshape(m, -1) for p in rows["part"]], 1)
        at = -0.5 * (squares - middle) @ axes.reshape(2, -1).T
        return pa.table([rows["g"].slice(0, 1), rows["c"].slice(0, 1), lists(at[None, :, 0]), lists(at[None, :, 1])], ["g", "p", "x", "y"])

    model = seen.select("g", "c", "o", "own").groupBy("g").applyInArrow(fit, f"g {kind}, axes array<double>, middle array<double>").withColumnRenamed("g", "__g")
    return seen.drop("own").join(stage(model, "mds-model"), F.col("g") == F.col("__g")).drop("__g").groupBy("g", "c").applyInArrow(place, f"g {kind}, p long, x array<double>, y array<double>")


def mds_rounds(blocks: DataFrame, start: DataFrame, rounds: int = 300, tolerance: float = 1e-7) -> DataFrame:
    """(g, p, x, y) of groups of any size, from blocks of their distances: stress majorisation with unit weights from ``start`` (g, p, x, y).

    In a round every block meets the points of its two chunks and gives the sums of their pulls, a point's new place is the mean of its pulls, and
    no task holds a group. A group ends where its stress falls by ``tolerance`` of itself or less; the driver only sees whether any goes on. It warns if one
    still does after ``rounds``.
    """
    from sigloom.sources.staging import stage

    kind = blocks.schema["g"].dataType.simpleString()
    schema = f"g {kind}, p long, n long, mx array<double>, my array<double>, s double, dd double"

    def pulls(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for row in _rows([batch], ["g", "p", "q", "n", "block", "x1", "y1", "x2", "y2"]):
                d, one, two = _matrix(row, row["p"], row["q"]), np.column_stack([row["x1"], row["y1"]]), np.column_stack([row["x2"], row["y2"]])
                s, at_p, at_q = linalg.block_pull(d, one, two)
                both = row["p"] != row["q"]
                for c, m, share in [(row["p"], at_p, 1.0), (row["q"], at_q, 0.0)][: 1 + both]:
                    for column, v in zip(out, (row["g"], c, row["n"], m[:, 0], m[:, 1], share * (s if both else s / 2), share * (1 + both) * float(np.vdot(d, d))), strict=True):
                        column.append(v)
            types = [batch.schema.field("g").type, pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["g", "p", "n", "mx", "my", "s", "dd"])

    def add(rows: pa.Table) -> pa.Table:
        total = [lists(batch(rows[c]).sum(0)[None]) for c in ("mx", "my")]
        return pa.table([*[rows[c].slice(0, 1) for c in ("g", "p", "n")], *total, *[pa.array([rows[c].to_numpy().sum()]) for c in ("s", "dd")]], rows.column_names)

    points = stage(start.withColumns({"stress": F.lit(float("inf")), "open": F.lit(True)}), "points")
    for _ in range(rounds):
        met = _with_points(blocks, points.filter("open"))
        moved = stage(met.mapInArrow(pulls, schema).groupBy("g", "p").applyInArrow(add, schema), "mds-moves").select(F.col("g").alias("__g"), F.col("p").alias("__p"), "n", "mx", "my", "s", "dd")
        totals = moved.groupBy(F.col("__g").alias("__h")).agg(F.sum("s").alias("__now"), (1e-15 * F.sum("dd")).alias("__nothing"))
        joined = points.join(moved, (F.col("g") == F.col("__g")) & (F.col("p") == F.col("__p")), "left").join(totals, F.col("g") == F.col("__h"), "left")
        falls = F.coalesce(F.col("open") & (F.col("__now") > F.col("__nothing")) & (F.col("stress") - F.col("__now") > tolerance * F.col("__now")), F.lit(False))
        take = lambda new, old: F.when(falls, F.transform(new, lambda v: v / F.col("n"))).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        points = stage(joined.select("g", "p", take("mx", "x"), take("my", "y"), F.coalesce("__now", "stress").alias("stress"), falls.alias("open")), "points")
        if points.filter("open").isEmpty():
            break
    else:
        warnings.warn(f"the stress of some groups still falls after {rounds} rounds", stacklevel=2)
    return points.select("g", "p", "x", "y")


def _to_axes(points: DataFrame) -> DataFrame:
    """Points of each group about their centre, turned so that x has most of the spread, with the farthest point of each axis positive."""
    centres = points.groupBy("g").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c")).withColumnRenamed("g", "__g")
    angle = F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    turned = points.join(centres, F.col("g") == F.col("__g")).select("g", "i", (x * F.cos(angle) + y * F.sin(angle)).alias("x"), (y * F.cos(angle) - x * F.sin(angle)).alias("y"))
    far = lambda c: F.signum(F.max_by(c, F.struct(F.abs(F.round(c, 9)), -F.col("i"))))
    signs = turned.groupBy(F.col("g").alias("__g")).agg(far("x").alias("sx"), far("y").alias("sy"))
    flip = lambda c, s: (F.col(c) * F.when(F.col(s) < 0, -1.0).otherwise(1.0)).alias(c)
    return turned.join(signs, F.col("g") == F.col("__g")).select("g", "i", flip("x", "sx"), flip("y", "sy"))


def fused_blocks(blocks: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``temporal_distance_fused`` of blocks of distances (see ``measured_blocks``): the gaps of n points go from 1 to n - 1."""
    ends = blocks.groupBy(F.col("g").alias("__g")).agg(F.min("lo").alias("__a"), F.max("hi").alias("__b"))
    met = blocks.join(ends, F.col("g") == F.col("__g"))

    def run(batches):
        for batch in batches:
            out = []
            for row in _rows([batch], ["p", "q", "n", "block", "__a", "__b"]):
                d, low = _matrix(row, row["p"], row["q"]), np.nan if row["__a"] is None else row["__a"]
                gap = np.abs(np.arange(row["q"] * SIDE, row["q"] * SIDE + d.shape[1]) - np.arange(row["p"] * SIDE, row["p"] * SIDE + d.shape[0])[:, None]).astype(float)
                width = np.nan if row["__b"] is None else row["__b"] - low
                m = alpha * d + (1 - alpha) * (low + ((gap - 1) / (row["n"] - 2) if row["n"] > 2 else 0 * gap) * width)
                if row["p"] == row["q"]:
                    np.fill_diagonal(m, 0)
                out.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("g", "p", "q", "n")], pa.array(out, pa.binary())], ["g", "p", "q", "n", "block"])

    return met.mapInArrow(run, f"g {blocks.schema['g'].dataType.simpleString()}, p long, q long, n long, block binary")


def mds_two_stage(distances: DataFrame, by: str = "subject_id", alpha: float = 0.5) -> DataFrame:
    """Embedding of distances mixed with order gaps, with each point's order fraction and weight. ``distances``: a table of pairs, or of blocks."""
    from sigloom.operators.windows import temporal_distance_fused, time_fraction
    from sigloom.sources.staging import small_batches, stage

    if "block" in distances.columns:
        with small_batches(distances.sparkSession, _BLOCKS_AT_ONCE):
            fused = stage(fused_blocks(distances, alpha), "fused-blocks")
    else:
        fused = temporal_distance_fused(distances, alpha, by)
    return time_fraction(mds_embed(fused, by, "fused"), by)


def eye_removal_fit(df: DataFrame, n_channels: int, veog: tuple[int, int], heog: tuple[int, int], by: str = "subject_id", sample: str = "sample", largest: int = 200_000, seed: int = 42, most: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(by, n, ``cleaning``): one matrix per group that takes out the independent components most correlated with the eyes.

    All times of a group's warm-up rows without a gap count. Symmetric fixed-point iteration with tanh (FastICA): the whitening comes from the pooled
    moments. A group of at most ``largest`` times, which is of bounded size, iterates in one task; of larger ones each step is a Spark round for
    all of them, in which batches add up their times' terms (see ``group_sums``), so no task holds such a group. Both take the same steps.
    The correlations of components with the eyes follow from the moments. ``veog`` averages two channels, ``heog`` is
    the difference of two. It warns if an unmixing still turns after ``most`` steps.
    """
    from sigloom.sources.staging import stage

    p = n_channels
    rows = df.select(F.col(by).alias("__g"), F.col(sample).alias("__x"))
    start = np.linalg.qr(np.random.RandomState(seed).normal(size=(p, p)))[0].ravel()

    def centre_and_white(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        mean, c = _pooled(n, m, p)
        return np.concatenate([mean, linalg.invsqrtm(c).reshape(len(n), -1), c.reshape(len(n), -1)], 1)

    moments = pooled_moments(rows, ["__g"], p, "__x", finite=True).filter("n > 0")
    fixed = stage(moments.select("__g", "n", shaped(centre_and_white, F.array("n"), "moments").alias("__f")), "ica-moments")
    first = F.slice("__f", 1, p)
    white = F.slice("__f", p + 1, p * p)
    model = fixed.select("__g", "n", first.alias("__m"), white.alias("__v"), F.array(*[F.lit(float(x)) for x in start]).alias("__w"), F.lit(1.0).alias("__turn"))

    def terms(samples: pa.Array, m: pa.Array, v: pa.Array, w: pa.Array) -> np.ndarray:
        mean, whiten, unmix = batch(m.slice(0, 1))[0], square(batch(v.slice(0, 1)))[0], square(batch(w.slice(0, 1)))[0]
        z = whiten @ (_times(samples, p, finite=True) - mean[:, None])
        g = np.tanh(unmix @ z)
        return np.concatenate([(g @ z.T).ravel(), (1 - g**2).sum(1)])

    def turned(w: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        old = square(w)
        new = s[:, : p * p].reshape(-1, p, p) / n[:, :, None] - (s[:, p * p :] / n)[:, :, None] * old
        u, _, v = np.linalg.svd(new)
        new = u @ v
        turn = np.abs(np.abs(np.einsum("nij,nij->ni", new, old)) - 1).max(1, keepdims=True)
        return np.concatenate([new.reshape(len(w), -1), turn], 1)

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        n, held = float(frame["n"].iloc[0]), [pa.array([list(frame[c].iloc[0])], pa.list_(pa.float64())) for c in ("__m", "__v")]
        times = _times(pa.array(frame["__x"].map(list).tolist(), pa.list_(pa.float64())), p, finite=True)
        w, one = start[None], [pa.array([times.ravel().tolist()], pa.list_(pa.float64())), *held]
        for _ in range(most):
            out = turned(w, terms(*one, pa.array([w[0].tolist()], pa.list_(pa.float64())))[None], np.array([[n]]))
            w = out[:, :-1]
            if out[0, -1] < tolerance:
                break
        return pd.DataFrame({"__g": [frame["__g"].iloc[0]], "n": [n], "__m": [frame["__m"].iloc[0]], "__v": [frame["__v"].iloc[0]], "__w": [w[0]], "__turn": [float(out[0, -1])]})

    kind = df.schema[by].dataType.simpleString()
    small = rows.join(model.filter(F.col("n") <= largest).select(F.col("__g").alias("__h"), "n", "__m", "__v"), F.col("__g") == F.col("__h")).drop("__h")
    ended = small.groupBy("__g").applyInPandas(alone, f"__g {kind}, n double, __m array<double>, __v array<double>, __w array<double>, __turn double")
    model = stage(model.filter(F.col("n") > largest), "ica")
    for _ in range(0 if model.isEmpty() else most):
        open_ = model.filter(F.col("__turn") >= tolerance).select(F.col("__g").alias("__h"), "__m", "__v", "__w")
        sums = group_sums(rows.join(open_, F.col("__g") == F.col("__h")), ["__g"], ["__x", "__m", "__v", "__w"], terms, "__s").withColumnRenamed("__g", "__h")
        joined = model.join(sums, F.col("__g") == F.col("__h"), "left").withColumn("__new", F.when(F.col("__s").isNotNull(), shaped(turned, "__w", "__s", F.array("n"))))
        model = stage(joined.select("__g", "n", "__m", "__v", F.coalesce(F.slice("__new", 1, p * p), "__w").alias("__w"), F.coalesce(F.element_at("__new", -1), "__turn").alias("__turn")), "ica")
        if model.filter(F.col("__turn") >= tolerance).isEmpty():
            break
    model = stage(ended, "ica").unionByName(model)
    if not model.filter(F.col("__turn") >= tolerance).isEmpty():
        warnings.warn(f"components of some groups still turn after {most} rounds", stacklevel=2)

    def cleaning(w: np.ndarray, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        eyes = np.zeros((2, p))
        eyes[0, list(veog)] = 0.5
        eyes[1, heog[0]], eyes[1, heog[1]] = 1.0, -1.0
        out = []
        for unmix, c in zip(square(w) @ square(v), f[:, p + p * p :].reshape(-1, p, p), strict=True):
            unmix = linalg.fix_signs(unmix)
            drop = {int(np.abs(r).argmax()) for r in score_components(unmix, eyes, c)}
            keep = np.diag([0.0 if k in drop else 1.0 for k in range(p)])
            out.append(np.linalg.inv(unmix) @ keep @ unmix)
        return np.stack(out)

    both = model.join(fixed.select(F.col("__g").alias("__h"), "__f"), F.col("__g") == F.col("__h"))
    return both.select(F.col("__g").alias(by), "n", shaped(cleaning, "__w", "__v", "__f").alias("cleaning"))


def score_components(unmix: np.ndarray, targets: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Correlation (targets x components) of components and targets, both given by their weights on channels of covariance ``c``; 0 for a constant one."""
    power = lambda w: np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", w, c, w), 0))
    size = power(targets)[:, None] * power(unmix)[None]
    return np.divide(targets @ c @ unmix.T, size, out=np.zeros(size.shape), where=size > 0)


def eye_removal_apply(df: DataFrame, model: DataFrame, by: str = "subject_id", sample: str = "sample") -> DataFrame:
    """Samples without the eyes; a subject without a fitted matrix fails the job."""
    m = model.select(by, F.col("cleaning").alias("__m"), F.col("n").alias("__n"))
    return lookup_subject_matrix(df, m, by, count="__n", kept="__m").withColumn(sample, apply_matrix("__m", sample)).drop("__m", "__n")


def register_sql(spark: SparkSession) -> None:
    """Matrix functions and ``split_windows`` for SQL users."""
    from pyspark.sql.functions import udtf

    for name in ("sqrtm", "invsqrtm", "logm", "expm", "inv"):
        spark.udf.register(f"matrix_{name}", _flat_udf(name))

    @udtf(returnType="part: int, sample: array<double>")
    class SplitWindows:
        def eval(self, sample: list, n_channels: int, parts: int):
            x = np.asarray(sample, float).reshape(n_channels, -1)
            each = x.shape[1] // parts
            for k in range(parts):
                yield k, x[:, k * each : (k + 1) * each].ravel().tolist()

    spark.udtf.register("split_windows", SplitWindows)


def _flat_udf(name: str):
    f = np.linalg.inv if name == "inv" else getattr(linalg, name)

    @F.pandas_udf(MATRIX)
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda v: None if v is None else f(square(np.asarray(v, float)[None]))[0].ravel())

    return run
