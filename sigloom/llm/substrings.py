"""Repeated passages: windows of words as edges of a De Bruijn graph, compacted to paths, cut where an earlier document has them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.staging import enough_partitions, shuffle_files_dropped, small_batches, stage, unstage

WORDS = 13
_ANCHOR = 5
_CHUNK = 1 << 20
_SLICE = 4 << 20
#: Any odd numbers do: bytes of a word, and words of a window, are digits to these bases modulo 2^64.
_BYTE_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NULL_ID = -(2**63)


@cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the text that it is in. Words are runs of other than ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    after_gap = np.concatenate([[True], ~inside[:-1]])
    before_gap = np.concatenate([~inside[1:], [True]])
    first = np.flatnonzero(inside & (after_gap | edge[:-1]))
    end = np.flatnonzero(inside & (before_gap | edge[1:])) + 1
    out, k = np.empty(len(first), np.uint64), 0
    while k < len(first):
        stop = max(k + 1, int(np.searchsorted(end, first[k] + _CHUNK, "right")))
        lo, hi = int(first[k]), int(end[stop - 1])
        up, down = powers(int(_BYTE_BASE), max(_CHUNK, 1 << (hi - lo).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo])])
        out[k:stop] = (sums[end[k:stop] - lo] - sums[first[k:stop] - lo]) * down[first[k:stop] - lo]
        k = stop
    return mixed(out), np.searchsorted(at[1:], first, "right")


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every ``n`` consecutive words."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for j in range(1, n):
        out = out * _WORD_BASE + words[j : j + len(out)]
    return mixed(out)


def _anchors(words: np.ndarray, n: int) -> np.ndarray:
    """For every window the least hash of the short grams in it: equal windows have the same."""
    short = grams(words, min(_ANCHOR, n))
    out = short[: max(0, len(words) - n + 1)].copy()
    for j in range(1, n - min(_ANCHOR, n) + 1):
        np.minimum(out, short[j : j + len(out)], out=out)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where texts (the first column) add up to more than ``_SLICE`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().cumsum()
        k = 0
        while k < batch.num_rows:
            stop = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + _SLICE, "right")))
            yield batch.slice(k, stop - k)
            k = stop


def _anchor_rows(n: int):
    """Runs on (text, t, d): the anchors (``m``) of each text."""

    def run(batches):
        for piece in _pieces(batches):
            words, of = word_hashes(piece.column(0))
            low = _anchors(words, n)
            of, same = of[: len(low)], of[n - 1 :] == of[: len(low)]
            low, of = low[same], of[same]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), *(c.take(pa.array(of[new])) for c in piece.columns[1:])], ["m", "t", "d"])

    return run


def _run_rows(n: int, bits: int):
    """Runs on (text, anchors, t, lo, hi): the maximal runs of windows with one of the anchors, as the windows' hashes."""

    def run(batches):
        for piece in _pieces(batches):
            words, of = word_hashes(piece.column(0))
            known = np.unique(pc.list_flatten(piece.column(1)).to_numpy().view(np.uint64))
            low, windows = _anchors(words, n), grams(words, n) >> np.uint64(64 - bits)
            of, last = of[: len(low)], of[n - 1 :]
            # Whether an anchor is in several documents says the anchor alone, so the texts of a piece can share their lists.
            hit = (of == last) & (known[np.minimum(np.searchsorted(known, low), max(0, len(known) - 1))] == low if len(known) else False)
            at = np.flatnonzero(hit)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
            cuts = np.flatnonzero(new)
            begins = at[cuts]
            start = begins - np.searchsorted(of, of[begins], "left")
            held = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)).astype(np.int32)), pa.array(windows[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of[begins])) for c in piece.columns[2:]), pa.array(start), held], ["t", "lo", "hi", "start", "ws"])

    return run


def _cut_rows(n: int):
    """Runs on (text, id, d, spans): counts, what is left, and a digest of every span as it is in this text."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "seen")}
            for text, d, spans in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                gone, seen = bytearray(len(words)), []
                for span in spans or ():
                    first, end = span["pos"], span["pos"] + span["len"] + n - 1
                    if span["head"] is not None:
                        digest = hashlib.sha256(b" ".join(words[first:end])).digest()
                        seen.append({"head": span["head"], "digest": int.from_bytes(digest[:8], "little", signed=True)})
                    if span["lo"] < d:
                        gone[first:end] = b"\1" * (end - first)
                kept = [w for w, x in zip(words, gone, strict=True) if not x] if seen or spans else words
                for name, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), seen), strict=True):
                    out[name].append(value)
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "seen": pa.list_(pa.struct([("head", pa.int64()), ("digest", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(v, kinds[c]) for c, v in out.items())], ["id", *out])

    return run


def _window_rows(n: int):
    """Runs on (text, t, d, spans): a digest of every single window of the spans."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, t, d, spans in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text.as_py() or b"").split()
                rows += [(hashlib.sha256(b" ".join(words[p : p + n])).digest(), t, d, p) for span in spans for p in range(span["pos"], span["pos"] + span["len"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "t", "d", "pos"])

    return run


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(text.cast("binary").alias("text"), F.xxhash64(text).alias("t"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("d"), F.col(id_col).alias("id"))


def candidate_runs(docs: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """(t, lo, hi, start, ws): of each distinct text the stretches of windows that may be in two documents; ``lo`` and ``hi`` are its least and greatest id.

    A window's anchor is the least hash of its 5-word grams, so windows that are equal have equal anchors; only anchors of two documents'
    let their windows through. Anchors are about a fifth as many as windows.
    """
    found = stage(docs.select("text", "t", "d").mapInArrow(_anchor_rows(n), "m long, t long, d long"), "anchors")
    shared = found.groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select(F.col("m").alias("__m"))
    asked = found.join(shared, F.col("m") == F.col("__m")).groupBy(F.col("t").alias("__t")).agg(F.collect_set("m").alias("ms"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    asked = stage(asked, "asked")
    unstage(found)
    # One row stands for all copies of a text.
    one = docs.join(asked, (F.col("t") == F.col("__t")) & (F.col("d") == F.col("lo"))).select("text", "ms", "t", "lo", "hi")
    runs = stage(one.mapInArrow(_run_rows(n, bits), "t long, lo long, hi long, start long, ws array<long>"), "window-runs")
    unstage(asked)
    return runs


def repeated_edges(runs: DataFrame) -> DataFrame:
    """(w, occurrences, lo, after, at): the windows of two documents or more as edges between their first and last ``n - 1`` words.

    ``after`` is the window one word on if all occurrences have the same there, else null; ``at`` is the coordinate of the first occurrence, in
    an order of texts by hash.
    """
    placed = runs.select("t", "lo", "hi", "start", "ws", F.posexplode("ws").alias("k", "w"))
    at = F.shiftleft(F.col("t").bitwiseAND(F.lit((1 << 38) - 1)), 24) + F.col("start") + F.col("k")
    seen = placed.select("w", "lo", "hi", F.get("ws", F.col("k") + 1).alias("next"), at.alias("at"))
    each = seen.groupBy("w").agg(
        F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("next").alias("followed"), F.min("next").alias("x"), F.max("next").alias("y"), F.min("at").alias("at")
    )
    after = F.when((F.col("followed") == F.col("n")) & (F.col("x") == F.col("y")), F.col("x"))
    return each.filter("lo <> hi").select("w", "n", "lo", after.alias("after"), "at")


def compacted(edges: DataFrame) -> DataFrame:
    """(head, len, lo): nonbranching paths of edges, by their first edge.

    An edge and the next are one path if every occurrence of the first is followed by the second and both occur equally often: then the second
    is never without the first, and the node between them has one way in and one out. All edges of a path occur together, in the
    same documents, one word apart, so its edges are consecutive in the coordinates of its first source and are counted there.
    """
    one = edges.filter("after IS NOT NULL").select(F.col("after").alias("__w"), F.col("n").alias("__n"), F.col("at").alias("__at"))
    inner = one.join(edges, (F.col("__w") == F.col("w")) & (F.col("__n") == F.col("n")) & (F.col("__at") + 1 == F.col("at"))).select(F.col("w").alias("__inner")).distinct()
    marked = edges.join(inner, F.col("w") == F.col("__inner"), "left").withColumn("head", F.col("__inner").isNull())
    along = Window.partitionBy(F.shiftright("at", 24)).orderBy("at")
    numbered = marked.withColumn("source", F.shiftright("at", 24)).withColumn("path", F.sum(F.col("head").cast("int")).over(along))
    return numbered.groupBy("source", "path").agg(F.max(F.when(F.col("head"), F.col("w"))).alias("head"), F.count("*").alias("len"), F.min("lo").alias("lo")).select("head", "len", "lo")


def _judged(docs: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    held = spans.groupBy(F.col("t").alias("__t")).agg(F.collect_list(F.struct("pos", "len", "lo", "head")).alias("spans"))
    met = docs.join(held, F.col("t") == F.col("__t"), "left").select("text", "id", "d", "spans")
    kind = docs.schema["id"].dataType.simpleString()
    return stage(met.mapInArrow(_cut_rows(n), f"id {kind}, n_words long, n_removed long, kept_sha256 string, seen array<struct<head: long, digest: long>>"), "cut")


def repeated_spans(docs: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """(t, pos, len, lo, head): where each text has a path of ``len`` repeated windows, from word ``pos`` on; ``lo`` is the least id that has it."""
    runs = candidate_runs(docs, n, bits)
    edges = stage(repeated_edges(runs), "edges")
    paths = stage(compacted(edges), "paths")
    unstage(edges)
    placed = runs.select("t", "start", F.posexplode("ws").alias("k", "w"))
    spans = stage(placed.join(paths, F.col("w") == F.col("head")).select("t", (F.col("start") + F.col("k")).alias("pos"), "len", "lo", "head"), "spans")
    unstage(runs)
    unstage(paths)
    return spans


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = 64) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words left, joined by one space.

    A word goes if it is in a window of ``words`` words that a document with a smaller id has too. Windows are judged on the input. Words are
    runs of other than ASCII white space; a null or empty text has none. A null id is smaller than any other; rows of one id are one document in this: they
    take nothing from one another. Repeated rows each have their row. Other columns are not read. An empty table gives no rows.

    Windows are met by hashes of ``bits`` bits; every path that they give is then compared by a digest of its words in each of its
    sources, and where two sources differ its windows are compared one by one by SHA-256, so collisions change no result.
    Copies of a text are one text up to the last step; a hot window, anchor or text is pre-aggregated or in a join that Spark splits.
    """
    spark = df.sparkSession
    docs = _docs(df, id_col, text_col)
    with small_batches(spark), shuffle_files_dropped(spark), enough_partitions(df):
        spans = repeated_spans(docs, words, bits)
        out = _judged(docs, spans, words)
        told = out.select(F.explode("seen").alias("s")).select("s.head", "s.digest")
        unlike = stage(told.groupBy("head").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select(F.col("head").alias("__head")), "unlike")
        if not unlike.isEmpty():
            doubted = stage(spans.join(unlike, F.col("head") == F.col("__head")).select("t", "pos", "len"), "doubted")
            held = doubted.groupBy(F.col("t").alias("__t")).agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
            single = docs.join(held, F.col("t") == F.col("__t")).select("text", "t", "d", "spans")
            single = stage(single.mapInArrow(_window_rows(words), "digest binary, t long, d long, pos long"), "windows")
            least = single.groupBy(F.col("digest").alias("__digest")).agg(F.min("d").alias("lo"))
            exact = single.join(least, F.col("digest") == F.col("__digest")).select("t", "pos", F.lit(1).cast("long").alias("len"), "lo", F.lit(None).cast("long").alias("head")).distinct()
            out = _judged(docs, stage(spans.join(unlike, F.col("head") == F.col("__head"), "left_anti").unionByName(exact), "spans"), words)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
