"""Nearest rows by exact distances: candidates stream past blocks of test rows, and only what a lower bound leaves is measured."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import linalg
from sigloom.functions.matrix import batch, riemann_distance, square
from sigloom.operators.projections import vector_distance

#: Test rows of a block within a subject and across subjects, of one matrix product, and pairs measured at once.
WITHIN, ACROSS, AT_ONCE, MEASURED = 2048, 16384, 512, 1 << 16


@dataclass(frozen=True)
class Metric:
    """``bound``: rows to vectors whose Euclidean distance is never above the distance; ``distance`` of rows of two arrays."""

    bound: Callable[[np.ndarray], np.ndarray]
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed entry by entry, as the column form does."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) * (x - y)
    return np.sqrt(total)


#: The affine-invariant metric is curved so that logarithms are never further apart than their matrices.
METRICS = {
    vector_distance: Metric(lambda v: v, _euclidean),
    riemann_distance: Metric(lambda v: linalg.upper(linalg.logm(square(v)), np.sqrt(2)), lambda a, b: linalg.riemann_distance(square(a), square(b))),
}


class _Codes:
    """Small integers for the few values of a column, in the order in which they come."""

    def __init__(self):
        self.known: dict = {}

    def of(self, column: pa.Array) -> np.ndarray:
        return np.array([self.known.setdefault(v, len(self.known)) for v in column.to_pylist()], np.int64)


class _Best:
    """The ``k`` nearest candidates so far of each row of a block of test rows."""

    def __init__(self, n: int, k: int):
        self.k, self.d = k, np.full((n, k), np.inf)
        # A candidate's place in the stream, which decides ties, its index, subject and label.
        self.of = np.zeros((n, k, 4), np.int64)

    def take(self, r: np.ndarray, d: np.ndarray, of: np.ndarray) -> None:
        rows = np.unique(r)
        old, at = np.nonzero(np.isfinite(self.d[rows]))
        r = np.concatenate([rows[old], r])
        d, of = np.concatenate([self.d[rows[old], at], d]), np.concatenate([self.of[rows[old], at], of])
        order = np.lexsort((of[:, 0], d, r))
        r, d, of = r[order], d[order], of[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        kept = rank < self.k
        self.d[rows] = np.inf
        self.d[r[kept], rank[kept]], self.of[r[kept], rank[kept]] = d[kept], of[kept]


def _spare_copies(values: np.ndarray, kinds: np.ndarray, most: int) -> np.ndarray:
    """Which candidates may be among a test row's nearest: of equal ones of one kind, all equally far, the first ``most``."""
    rows = np.ascontiguousarray(np.concatenate([values + 0.0, kinds.astype(float)], 1))
    which = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    return np.sort(order[np.arange(len(order)) - np.searchsorted(which[order], which[order]) < most])


def _search(best: _Best, metric: Metric, digits: int | None, tests: dict, others: dict, allowed: Callable, first_smaller: bool) -> None:
    """Meet a batch of candidates. A row with fewer than ``k`` so far takes the batch's ``k`` nearest by the bound; what its ``k``-th distance then does not rule out is measured too."""
    norm = lambda v: np.square(v).sum(1)
    right = np.concatenate([-2 * others["bound"], np.ones((len(others["bound"]), 1)), norm(others["bound"])[:, None]], 1).T

    def measure(r: np.ndarray, c: np.ndarray) -> None:
        found = []
        for k in range(0, len(r), MEASURED):
            x, y = tests["v"][r[k : k + MEASURED]], others["v"][c[k : k + MEASURED]]
            if first_smaller:  # A pair has one distance, whichever of the two is the test row.
                turn = (tests["of"][r[k : k + MEASURED], 1] > others["of"][c[k : k + MEASURED], 1])[:, None]
                x, y = np.where(turn, y, x), np.where(turn, x, y)
            found.append(metric.distance(x, y))
        d = np.concatenate(found)
        if digits is not None:
            scaled = d * 10.0**digits
            d = (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 10.0**digits
        best.take(r, d, others["of"][c])

    for lo in range(0, len(tests["v"]), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        bound = tests["bound"][part]
        left = np.concatenate([bound, norm(bound)[:, None], np.ones((len(bound), 1))], 1)
        square_ = left @ right
        square_[~allowed(part)] = np.inf
        few = np.flatnonzero(~np.isfinite(best.d[part, -1]))
        if len(few):
            k = min(best.k, square_.shape[1])
            near = np.argpartition(square_[few], k - 1, axis=1)[:, :k]
            r, c = np.repeat(few, k), near.ravel()
            known = np.isfinite(square_[r, c])
            if known.any():
                measure(lo + r[known], c[known])
            square_[r, c] = np.inf
        slack = 1e-10 * (left[:, -2].max() + right[-1].max())
        limit = np.square(best.d[part, -1] + (0 if digits is None else 10.0**-digits)) * (1 + 1e-9) + slack
        limit[~np.isfinite(limit)] = np.finfo(float).max
        r, c = np.nonzero(square_ <= limit[:, None])
        if len(r):
            measure(lo + r, c)


def nearest_rows(tests: DataFrame, others: DataFrame, value: str, distance: Callable[..., Column], k: int, across: bool, each: bool = False, digits: int | None = None) -> DataFrame:
    """(subject_id, test, true_label, other, candidate, label, d): the ``k`` nearest ``others`` of every test row; with ``each``, of each other subject; ties to the smaller (subject, ``i``).

    Both tables: ``__part`` (a test row meets the others of its part), ``subject_id``, ``i``, ``label``, ``value``, ``event`` (a code; null: none) and ``alone``: whether own events
    count. With ``across`` only rows of other subjects count, else only rows of other events. Others of a part stream past its test rows, which a task holds with
    their nearest so far. One matrix product gives lower bounds of all distances; those that a row's ``k``-th distance does not rule out are
    measured. What shuffles are rows, once a part, and no pair leaves a task but the nearest. ``digits``: distances are rounded before they are compared.
    """
    metric = METRICS[distance]
    columns = ["__part", "__tag", "subject_id", "i", "label", "event", "alone", value]
    both = tests.withColumn("__tag", F.lit(0)).select(columns).unionByName(others.withColumn("__tag", F.lit(1)).select(columns))
    both = both.filter(F.col("subject_id").isNotNull() & F.col(value).isNotNull())
    count = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(count, "__part").sortWithinPartitions("__part", "__tag", "subject_id", "i")
    kind = {c: rows.schema[c].dataType.simpleString() for rows in [tests] for c in ("subject_id", "i", "label")}
    names = ["subject_id", "test", "true_label", "other", "candidate", "label", "d"]

    def run(batches):
        subjects, labels = _Codes(), _Codes()
        part, held, block, best, place = None, [], None, {}, 0

        def columns_of(b: pa.RecordBatch, at: np.ndarray) -> dict:
            own = b.take(pa.array(at))
            v = batch(own.column(7))
            of = np.stack([np.zeros(len(at), np.int64), own.column(3).to_numpy(zero_copy_only=False).astype(np.int64), subjects.of(own.column(2)), labels.of(own.column(4))], 1)
            event = own.column(5).to_pylist()
            return {"v": v, "bound": metric.bound(v), "of": of, "event": np.array([-1 if e is None else e for e in event], np.int64), "none": np.array([e is None for e in event], bool), "alone": np.array(own.column(6).to_pylist(), bool)}

        def results():
            if block is None:
                return
            subject_of, label_of = pa.array(list(subjects.known), subject_type), pa.array(list(labels.known), label_type)
            for found in best.values():
                for lo in range(0, len(found.d), 512):
                    r, c = np.nonzero(np.isfinite(found.d[lo : lo + 512]))
                    of, own = found.of[lo + r, c], block["of"][lo + r]
                    made = [subject_of.take(pa.array(own[:, 2])), pa.array(own[:, 1]), label_of.take(pa.array(own[:, 3])), subject_of.take(pa.array(of[:, 2])), pa.array(of[:, 1]), label_of.take(pa.array(of[:, 3])), pa.array(found.d[lo + r, c])]
                    yield pa.RecordBatch.from_arrays(made, names)

        for b in batches:
            if not b.num_rows:
                continue
            subject_type, label_type = b.schema.field(2).type, b.schema.field(4).type
            parts, tags = b.column(0).to_pylist(), b.column(1).to_numpy()
            codes = np.array([0] + [parts[x] != parts[x - 1] for x in range(1, len(parts))]).cumsum() * 2 + tags
            for at in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1):
                if parts[at[0]] != part:
                    yield from results()
                    part, held, block, best, place = parts[at[0]], [], None, {}, 0
                rows = columns_of(b, at)
                if tags[at[0]] == 0:
                    held.append(rows)
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = {c: np.concatenate([h[c] for h in held]) for c in held[0]}, []
                rows["of"][:, 0] = place + np.arange(len(at))
                place += len(at)
                spare = _spare_copies(rows["v"], np.stack([rows["event"], rows["none"], rows["of"][:, 2]], 1), k + 1)
                rows = {c: x[spare] for c, x in rows.items()}
                for s in np.unique(rows["of"][:, 2]) if each else [None]:
                    some = rows if s is None else {c: x[rows["of"][:, 2] == s] for c, x in rows.items()}
                    if s not in best:
                        best[s] = _Best(len(block["v"]), k)

                    def allowed(at: slice, some=some) -> np.ndarray:
                        if across:
                            return block["of"][at, 2, None] != some["of"][None, :, 2]
                        other = (block["event"][at, None] != some["event"][None]) & ~some["none"][None]
                        apart = block["of"][at, 1, None] != some["of"][None, :, 1]
                        return (other | block["alone"][at, None]) & apart

                    _search(best[s], metric, digits, block, some, allowed, not across)
        yield from results()

    return dealt.mapInArrow(run, f"subject_id {kind['subject_id']}, test long, true_label {kind['label']}, other {kind['subject_id']}, candidate long, label {kind['label']}, d double").withColumns({c: F.col(c).cast(kind["i"]) for c in ("test", "candidate")})


def nearest_within(rows: DataFrame, value: str, distance: Callable[..., Column], k: int, key: str = "subject_id", digits: int | None = None) -> DataFrame:
    """(key, test, candidate, true_label, label, d): the ``k`` nearest rows of the same subject and other events; of all but itself where a subject has one event.

    ``rows``: key, ``i``, ``event_id``, ``label``, ``value``; subjects are cut into blocks of test rows by ``i``.
    """
    told = rows.groupBy(F.col(key).alias("__key")).agg(F.max(F.floor(F.col("i") / WITHIN)).alias("__most"), (F.min("event_id") == F.max("event_id")).alias("alone"), F.count("event_id").alias("__events"))
    named = rows.join(told, F.col(key) == F.col("__key")).select(F.col(key).alias("subject_id"), "i", "label", F.col("event_id").cast("long").alias("event"), F.coalesce("alone", F.lit(True)).alias("alone"), "__most", "__events", value)
    tests = named.filter(F.col("event").isNotNull() & ((~F.col("alone")) | (F.col("__events") > 1))).withColumn("__part", F.struct("subject_id", F.floor(F.col("i") / WITHIN).alias("block")))
    others = named.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__most")))).withColumn("__part", F.struct("subject_id", F.col("__block").alias("block")))
    return nearest_rows(tests, others, value, distance, k, False, digits=digits).select(F.col("subject_id").alias(key), "test", "candidate", "true_label", "label", "d")


def nearest_across(rows: DataFrame, value: str, distance: Callable[..., Column], k: int, blocks: int = 48, each: bool = False) -> DataFrame:
    """(subject_id, test, candidate, true_label, label, d): the ``k`` nearest rows of other subjects, or with ``each`` of each other subject; ``candidate`` has its ``subject_id`` and ``i``.

    Test rows are dealt in ``blocks`` at least; every row meets each block once.
    """
    n = max(blocks, -(-rows.count() // (ACROSS // 4 if each else ACROSS)))
    named = rows.select("subject_id", "i", "label", F.lit(None).cast("long").alias("event"), F.lit(False).alias("alone"), value)
    tests = named.withColumn("__part", F.pmod(F.xxhash64("subject_id", "i"), F.lit(n)))
    others = named.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    found = nearest_rows(tests, others, value, distance, k, True, each)
    return found.select("subject_id", "test", F.struct(F.col("other").alias("subject_id"), F.col("candidate").alias("i")).alias("candidate"), "true_label", "label", "d")
