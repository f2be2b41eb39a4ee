"""Filters on chunked signals: rows hold a chunk of one session, (session_id, chunk, channels x times as a flat array)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import filters
from sigloom.functions.matrix import batch, lists


def to_chunks(samples: DataFrame, size: int, key: str = "session_id", order: str = "idx", x: str = "x") -> DataFrame:
    """(key, ``chunk``, ``n_channels``, ``n_times``, ``signal``): ``size`` samples a row, in order; a session's last chunk is shorter."""
    rows = samples.select(key, F.floor(F.col(order) / size).alias("chunk"), F.struct(F.col(order).alias("at"), F.col(x).alias("x")).alias("s"))
    packed = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))
    channels = F.size(F.col("s")[0]["x"])
    flat = F.flatten(F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.transform("s", lambda v: v["x"][c])))
    return packed.select(key, "chunk", channels.alias("n_channels"), F.size("s").alias("n_times"), flat.alias("signal"))


def from_chunks(chunks: DataFrame, size: int, key: str = "session_id") -> DataFrame:
    """Back to one row per sample (key, ``idx``, ``x``)."""
    at = chunks.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_times") - 1)))
    x = F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.element_at("signal", (c * F.col("n_times") + F.col("t") + 1).cast("int")))
    return at.select(key, (F.col("chunk") * size + F.col("t")).cast("long").alias("idx"), x.alias("x"))


def bandpass(chunks: DataFrame, low: float, high: float, rate: float, order: int = 4, start: str = "zero", key: str = "session_id") -> DataFrame:
    """Causal Butterworth band-pass along each session, all chunks at once (see ``run_filters``)."""
    return run_filters(chunks, [filters.butter_bandpass(low, high, rate, order)], start, key)


def _shapes(sizes: np.ndarray):
    """(row of sizes, places of the rows with it): chunks of one shape are worked out as one array."""
    for size in np.unique(sizes, axis=0):
        yield size, np.flatnonzero((sizes == size).all(1))


def run_filters(chunks: DataFrame, designs: list[np.ndarray], start: str = "zero", key: str = "session_id") -> DataFrame:
    """Each channel through each filter (sections), the channels of the first filter first; to the last bit one pass over the whole session.

    A session's chunks stream through one task in order, with one small state a session; those of equal number and shape, of many
    sessions, are worked out as one array. ``start``: ``zero`` or ``unit_step`` for the first state.
    """
    names = [key, "chunk", "n_channels", "n_times"]

    def first(d: np.ndarray, c: int) -> np.ndarray:
        return np.zeros((len(d), 2, c)) if start == "zero" else np.repeat(filters.unit_step_state(d)[..., None], c, 2)

    def run(batches):
        states: dict = {}
        for b in batches:
            keys, sizes = b.column(0).to_pylist(), np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], 1)
            # In order of the chunks' numbers.
            for (_, c, n), at in _shapes(sizes):
                rows, out, ends = pa.array(at), [], []
                x = batch(b.column(4).take(rows)).reshape(len(at) * c, n)
                before = [states.get(keys[i]) or [first(d, c) for d in designs] for i in at]
                for k, d in enumerate(designs):
                    y, state = filters.sosfilt(d, x, np.concatenate([s[k] for s in before], 2))
                    out.append(y.reshape(len(at), c * n))
                    ends.append(np.split(state, len(at), 2))
                states |= {keys[i]: [e.copy() for e in end] for i, end in zip(at, zip(*ends, strict=True), strict=True)}
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(4)], lists(np.concatenate(out, 1))], [*names, "signal"])

    kinds = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in names)
    ordered = chunks.select(*names, "signal").repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions("chunk", key)
    out = ordered.mapInArrow(run, f"{kinds}, signal array<double>")
    return out.withColumn("n_channels", (F.col("n_channels") * len(designs)).cast("int"))


def resample(chunks: DataFrame, q: int, size: int, key: str = "session_id") -> DataFrame:
    """Zero-phase decimation by ``q``: a centred FIR, every q-th sample kept.

    Chunks (of ``size``, a multiple of q and at least 10 q) meet their neighbours' edges, the only part of them that moves.
    """
    if size % q:
        raise ValueError(f"{q} does not divide {size}")
    if size < 10 * q:
        raise ValueError("chunks are shorter than half of the filter")
    taps, half = filters.decimation_taps(q), 10 * q
    each = F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.slice("signal", (c * F.col("n_times") + 1).cast("int"), F.col("n_times").cast("int")))
    edge = lambda f: F.flatten(F.transform(each, f))
    least = F.least(F.col("n_times"), F.lit(half)).cast("int")
    before = chunks.select(F.col(key).alias("__k"), (F.col("chunk") + 1).alias("__c"), edge(lambda x: F.slice(x, (F.col("n_times") - least + 1).cast("int"), least)).alias("__before"))
    after = chunks.select(F.col(key).alias("__l"), (F.col("chunk") - 1).alias("__d"), edge(lambda x: F.slice(x, 1, least)).alias("__after"))
    edges = chunks.join(before, (F.col(key) == F.col("__k")) & (F.col("chunk") == F.col("__c")), "left").join(after, (F.col(key) == F.col("__l")) & (F.col("chunk") == F.col("__d")), "left")

    def wide(rows: np.ndarray | None, inner: np.ndarray, first: bool) -> np.ndarray:
        """``half`` samples before (``first``) or after a chunk; what is missing repeats the outermost sample."""
        own = inner[:, :, :0] if rows is None else rows.reshape(*inner.shape[:2], -1)
        missing = half - own.shape[2]
        side = (own if own.shape[2] else inner)[:, :, :1] if first else (own if own.shape[2] else inner)[:, :, -1:]
        parts = (np.repeat(side, missing, 2), own)
        return np.concatenate(parts if first else parts[::-1], 2)

    def run(batches):
        for b in batches:
            lengths = [b.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for i in (5, 6)]
            sizes = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy(), *lengths], 1)
            for (c, n, first, last), at in _shapes(sizes):
                rows = pa.array(at)
                x = batch(b.column(4).take(rows)).reshape(len(at), c, n)
                sides = [batch(b.column(i).take(rows)) if m else None for i, m in ((5, first), (6, last))]
                all_ = np.concatenate([wide(sides[0], x, True), x, wide(sides[1], x, False)], 2)
                y = np.lib.stride_tricks.sliding_window_view(all_, len(taps), axis=2)[:, :, ::q] @ taps
                counts = pa.array(np.full(len(at), y.shape[2], np.int32))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(3)], counts, lists(y.reshape(len(at), -1))], [key, "chunk", "n_channels", "n_times", "signal"])

    kind = chunks.schema[key].dataType.simpleString()
    return edges.select(key, "chunk", "n_channels", "n_times", "signal", "__before", "__after").mapInArrow(run, f"{key} {kind}, chunk long, n_channels int, n_times int, signal array<double>")


def multi_band(chunks: DataFrame, channels: list[str], bands: dict[str, tuple[float, float]], rate: float, key: str = "session_id") -> tuple[DataFrame, list[str]]:
    """Each channel once per band, named ``<channel>_<band>``; the originals go. Chunks and the new names; all bands in one pass."""
    out = run_filters(chunks, [filters.butter_bandpass(low, high, rate) for low, high in bands.values()], key=key)
    return out, [f"{c}_{band}" for band in bands for c in channels]
