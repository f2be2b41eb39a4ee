"""SimHash near-duplicates: fingerprints of word shingles, joined by walking a binary trie against itself."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.components import connected_components
from sigloom.llm.staging import small_batches, stage

SEED = 42
SPLIT_BITS = 6
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FRONTIER = 1 << 15
#: Laid-out fingerprints that a task walks, each 40 bytes or so in a few arrays.
PER_TASK = 1_000_000
_SMALL = 16


def _words(raw: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + block)
        gap = _SPACE.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits of a UTF-8 text; a bit is set if it is in over half of the shingles' hashes. No word: zero."""
    ones, n, kept = np.zeros(64, np.int64), 0, []
    for words in _words(text or b""):
        words = kept + words
        if len(words) >= shingle:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
            line = b" ".join(words)
            hashes = [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        kept = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and kept:
        return xxhash.xxh64_intdigest(b" ".join(kept), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, ``fp`` as a signed long) of every row; whole texts, null as empty."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union-find over arrays: hang the larger root below the smaller one until all pairs agree."""
    while len(i):
        for x in (i, j):
            while True:
                up = root[x]
                if np.array_equal(up, x):
                    break
                x[:] = up
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))


def _flatten(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


class TrieJoin:
    """Pairs of fingerprints within a Hamming budget, found by walking pairs of trie nodes down together.

    ``value`` is sorted within each trie, so a node is a range. A pair of nodes at a depth goes
    on to its four pairs of children; those that differ in the bit spend one of the budget and
    end beyond it. A pair whose fingerprints are already connected ends too, since
    only components are asked for: a dense group costs far less than its pairs.
    """

    def __init__(self, value: np.ndarray, name: np.ndarray, budget: int):
        self.value, self.name, self.budget = value, name, budget
        self.root = np.arange(int(name.max()) + 1 if len(name) else 0)
        self.until = np.arange(1, len(value) + 1)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.counted: dict[int, np.ndarray] = {}

    def _middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in self.counted:
            if len(self.counted) >= 16:
                self.counted.pop(next(iter(self.counted)))
            bit = (self.value >> np.uint64(63 - depth)) & np.uint64(1)
            self.counted[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]).astype(np.int32)
        ones = self.counted[depth]
        return hi - (ones[hi] - ones[lo])

    def _note(self, i: np.ndarray, j: np.ndarray) -> None:
        self.found.append((self.name[i], self.name[j]))
        self.waiting += len(i)
        if self.waiting >= 1 << 16:
            self.settle()

    def settle(self) -> None:
        if not self.found:
            return
        _merge(self.root, *(np.concatenate(x) for x in zip(*self.found, strict=True)))
        self.root = _flatten(self.root)
        self.found, self.waiting = [], 0
        label = self.root[self.name]
        ends = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(label))
        self.until = ends[np.searchsorted(ends, np.arange(len(label)), side="right")]

    def _compare(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """All pairs of small node pairs [a, b) and [c, d)."""
        each = (b - a) * (d - c)
        of = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        i, j = a[of] + k // (d - c)[of], c[of] + k % (d - c)[of]
        near = (np.bitwise_count(self.value[i] ^ self.value[j]) <= self.budget) & (self.name[i] != self.name[j])
        if near.any():
            self._note(i[near], j[near])

    def run(self, roots: np.ndarray) -> np.ndarray:
        """``roots``: rows of (lo, hi, lo, hi). Gives the smallest connected name of each name."""
        zero = np.zeros(len(roots), np.int8)
        todo = [(0, *roots[k : k + _FRONTIER].T, zero[k : k + _FRONTIER]) for k in range(0, len(roots), _FRONTIER)]
        while todo:
            depth, a, b, c, d, spent = todo.pop()
            label = self.root[self.name[a]]
            known = (self.until[a] >= b) & (self.until[c] >= d) & (label == self.root[self.name[c]])
            small = ~known & (((b - a) * (d - c) <= _SMALL) | (depth == 64))
            self._compare(a[small], b[small], c[small], d[small])
            large = ~known & ~small
            if not large.any():
                continue
            a, b, c, d, spent = a[large], b[large], c[large], d[large], spent[large]
            m, n, own = self._middle(depth, a, b), self._middle(depth, c, d), a == c
            other = ~own
            children = [(a, m, c, n, spent), (m, b, n, d, spent), (a, m, n, d, spent + 1), (m[other], b[other], c[other], n[other], spent[other] + 1)]
            a, b, c, d, spent = (np.concatenate(x) for x in zip(*children, strict=True))
            alive = (a < b) & (c < d) & (spent <= self.budget) & ~((a == c) & (b - a == 1))
            rows = [x[alive] for x in (a, b, c, d, spent)]
            todo += [(depth + 1, *(x[k : k + _FRONTIER] for x in rows)) for k in range(0, len(rows[0]), _FRONTIER)]
        self.settle()
        return self.root


def _join_tasks(budget: int):
    """Runs on a partition of (task, side, fp, rot): trie joins of its tasks; edges that span what they link."""

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        task, side, fp, rot = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(4))
        value = rot.view(np.uint64)
        order = np.lexsort((value, side, task))
        task, side, value, fp = task[order], side[order], value[order], fp[order].view(np.uint64)
        names, name = np.unique(fp, return_inverse=True)
        starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])]))
        ends = np.append(starts[1:], len(task))
        own = (side[starts] == 2) & (ends - starts > 1)
        left = np.flatnonzero((side[starts[:-1]] == 0) & (side[starts[1:]] == 1) & (task[starts[:-1]] == task[starts[1:]]))
        roots = np.concatenate([np.stack([starts[own], ends[own], starts[own], ends[own]], 1), np.stack([starts[left], ends[left], starts[left + 1], ends[left + 1]], 1)])
        root = TrieJoin(value, name, budget).run(roots)
        linked = np.flatnonzero(root != np.arange(len(root)))
        a, b = names[linked].view(np.int64), names[root[linked]].view(np.int64)
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], ["a", "b"])

    return run


def _descend(hot: DataFrame, bits: DataFrame, budget: int) -> DataFrame:
    """Node pairs of a hot task: its fingerprints by their values in the chosen bits, paired within what is left of the budget."""
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    value = "aggregate(__bits, 0, (v, p) -> 2 * v + getbit(fp, p))"
    rows = hot.join(F.broadcast(bits), "task").withColumn("__own", F.expr(value))
    rows = rows.withColumn("__mask", F.explode(F.array(*[F.lit(m) for m in masks]))).filter(F.col("spent") + F.bit_count("__mask") <= budget)
    rows = rows.withColumn("__other", F.col("__own").bitwiseXOR(F.col("__mask")))
    whole, first = F.col("side") == 2, F.col("side") == 0
    low = F.when(whole, F.least("__own", "__other")).when(first, F.col("__own")).otherwise(F.col("__other"))
    high = F.when(whole, F.greatest("__own", "__other")).when(first, F.col("__other")).otherwise(F.col("__own"))
    side = F.when(whole & (F.col("__mask") == 0), 2).when(whole, (F.col("__own") > F.col("__other")).cast("int")).otherwise(F.col("side"))
    return rows.select(F.xxhash64("task", low, high).alias("task"), side.cast("int").alias("side"), (F.col("spent") + F.bit_count("__mask")).cast("int").alias("spent"), "fp", "rot")


def _even_bits(hot: DataFrame) -> DataFrame:
    """(task, the bits that part its fingerprints most evenly); sides are weighed by themselves, so bits already walked do not count."""
    ones = hot.groupBy("task", "side").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"getbit(fp, {p})").cast("long")).alias(f"b{p}") for p in range(64)])
    split = [F.sum(F.least(F.col(f"b{p}"), F.col("n") - F.col(f"b{p}"))).alias(f"b{p}") for p in range(64)]
    by_evenness = ones.groupBy("task").agg(*split).select("task", F.array_sort(F.array(*[F.struct((-F.col(f"b{p}")).alias("e"), F.lit(p).alias("p")) for p in range(64)])).alias("s"))
    return by_evenness.select("task", F.expr(f"transform(slice(s, 1, {SPLIT_BITS}), x -> x.p)").alias("__bits"))


def linked_fingerprints(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """(``node``, ``root``) of every fingerprint of ``distinct`` (``fp``) that has one within ``budget`` differing bits.

    Of ``budget + 1`` equal stretches of a fingerprint one is equal in both of a pair, so the trie is laid
    out once per stretch, turned to the front, and its first levels, where no bit may differ, are Spark's
    partitioning, of ``PER_TASK`` rows a task or less. A node that holds more than half of an even partition's rows is walked further in Spark: its
    fingerprints go to pairs of child nodes with the differing bits added up, until none is so large.
    """
    spark, stretch = distinct.sparkSession, 64 // (budget + 1)
    laid_rows = distinct.count() * (budget + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-laid_rows // PER_TASK))
    turns = [F.struct(F.lit(k).alias("k"), F.shiftleft("fp", stretch * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - stretch * k) if k else F.lit(0)).alias("rot")) for k in range(budget + 1)]
    laid = distinct.select("fp", F.explode(F.array(*turns)).alias("t")).select("fp", "t.*")
    front = F.shiftrightunsigned("rot", 64 - min(stretch, 16))
    tasks = laid.select((F.col("k") * (1 << 16) + front).alias("task"), F.lit(2).alias("side"), F.lit(0).alias("spent"), "fp", "rot")
    most = max(64, laid_rows // (2 * parts))
    done = []
    for _ in range(64 // SPLIT_BITS + 1):
        sizes = tasks.groupBy("task").agg(F.count("*").alias("n"), F.min("side").alias("l"), F.max("side").alias("r"))
        large = stage(sizes.filter((F.col("n") > most) & ((F.col("r") == 2) | (F.col("l") < F.col("r")))).select("task"), "hot-nodes")
        if large.isEmpty():
            break
        done.append(tasks.join(F.broadcast(large), "task", "left_anti"))
        hot = tasks.join(F.broadcast(large), "task")
        tasks = stage(_descend(hot, stage(_even_bits(hot), "even-bits"), budget), "node-pairs")
    for part in done:
        tasks = tasks.unionByName(part)
    dealt = tasks.select("task", "side", "fp", "rot").repartition(parts, "task")
    return connected_components(stage(dealt.mapInArrow(_join_tasks(budget), "a long, b long"), "links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long) and ``component_id``, the smallest id reachable.

    Texts are lower-cased in A-Z and read whole; words are runs of other than ASCII white space. A text of
    fewer words than a shingle is one shingle; one without words (null, empty) has fingerprint zero and links like
    any other. Equal fingerprints are one node, so copies cost nothing; repeated rows come out
    as often as they came. Null ids count as larger than any; a component of null ids only has a null id. Other columns
    are not read, so names cannot clash. An empty table gives no rows.
    """
    with small_batches(df.sparkSession):
        rows = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fp")
    linked = stage(linked_fingerprints(distinct, budget), "linked-fp")
    least = distinct.select(F.col("fp").alias("__fp"), "least")
    smallest = stage(linked.join(least, F.col("node") == F.col("__fp")).groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("of_root")), "roots")
    of_node = stage(linked.join(smallest, F.col("root") == F.col("__root")).select("node", "of_root"), "of-node")
    component = stage(distinct.join(of_node, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("of_root", "least").alias("component_id")), "components")
    return rows.join(component, F.col("fp") == F.col("__fp")).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, whose id is their component's smallest; rows with a null id stay."""
    found = near_duplicates(df, id_col, text_col, shingle, budget)
    dropped = stage(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__dropped")).distinct(), "dropped")
    return df.join(dropped, df[id_col] == F.col("__dropped"), "left_anti")
