"""Spelling variants: words meet by what is left of them without one code point; very long ones are walked through a trie with one edit at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.staging import shuffle_files_dropped, stage, unstage
from sigloom.llm.substrings import mixed, powers

#: One by one, as Java looks single letters up in a table but tries ranges in turn.
LETTER = "[" + "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])) + "]"
#: Code points of a word that is written out once for each of them; for longer ones that would be too much.
LONG = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0xA0761D6478BD642F


def noisy_words(df: DataFrame, id_col: str, text_col: str, least_length: int, every: int) -> DataFrame:
    """(``word``): the runs of letters of all texts, A-Z lower-cased, one in ``every`` without one of its code points.

    Which, and which code point, says the CRC-32 of ``<id>:<run>`` (null id: nothing before the colon). Only words of ``least_length`` code points or
    more are given; a shorter run gives none.
    """
    runs = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0)))
    found = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("raw"))
    lowered = F.when(F.octet_length("raw") == F.char_length("raw"), F.lower("raw")).otherwise(F.translate("raw", _UPPER, _LOWER))
    found = found.select("raw", "id", lowered.alias("run")).select("raw", "run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    # Said of raw runs and not of the words: Spark tests it before it works words out, and would work each out twice.
    found = found.filter((F.char_length("raw") > least_length) | (F.col("h") % every != 0))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def _tail_nodes(batches):
    """Runs on (s, side, half): of each word the trie's nodes from depth ``half`` on, and the code point that follows each (0: none)."""
    for batch in batches:
        words, side, half = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy().astype(np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        first = lengths.cumsum() - lengths
        up, down = powers(_BASE, 1 << max(1, len(codes)).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        many = lengths - half + 1
        ends = many.cumsum()
        word = np.repeat(np.arange(len(words)), many)
        depth = np.arange(len(word)) - (ends - many)[word] + half[word]
        nodes = mixed((sums[first[word] + depth] - sums[first[word]]) * down[first[word]] * np.uint64(2) + side[word])
        after = np.where(depth < lengths[word], np.append(codes, np.uint64(0))[first[word] + depth], np.uint64(0)).astype(np.int32)
        cuts = pa.array(np.append(0, ends).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(nodes.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(after))], ["s", "side", "half", "nodes", "after"])


def trie_tails(words: DataFrame) -> DataFrame:
    """(s, side, stops): each word, forwards (side 0) and backwards (1), with the nodes of its later half at which the trie branches or a word ends.

    A stop is a struct of ``depth``, ``node``, ``open`` (there is more than one way on) and ``end``. A node is a hash of its prefix and side.
    """
    both = words.select(F.col("word").alias("s"), F.lit(0).alias("side")).unionByName(words.select(F.reverse("word").alias("s"), F.lit(1).alias("side")))
    half = F.floor((F.char_length("s") + F.col("side")) / 2).cast("int")
    paths = both.withColumn("half", half).mapInArrow(_tail_nodes, "s string, side int, half int, nodes array<long>, after array<int>")
    paths = stage(paths, "trie-paths")
    steps = paths.select("s", "side", "half", F.posexplode(F.arrays_zip("nodes", "after")).alias("k", "x")).select("s", "side", (F.col("half") + F.col("k")).alias("depth"), F.col("x.nodes").alias("node"), F.col("x.after").alias("after"))
    ways = steps.groupBy(F.col("node").alias("__node")).agg(F.min("after").alias("a"), F.max("after").alias("b")).filter("a = 0 OR a <> b")
    met = steps.join(ways, F.col("node") == F.col("__node"))
    stops = F.array_sort(F.collect_list(F.struct("depth", "node", (F.col("a") != F.col("b")).alias("open"), (F.col("a") == 0).alias("end"))))
    tails = stage(met.groupBy("s", "side").agg(stops.alias("stops")), "trie-tails")
    unstage(paths)
    return tails


def trie_edges(tails: DataFrame) -> DataFrame:
    """(parent, first, label, child, end): the trie's edges from stop to stop; ``end`` says whether a word ends at the child."""
    pairs = F.arrays_zip(F.slice("stops", F.lit(1), F.size("stops") - 1).alias("p"), F.slice("stops", F.lit(2), F.size("stops")).alias("c"))
    each = tails.select("s", F.explode(pairs).alias("x"))
    label = F.substring("s", F.col("x.p.depth") + 1, F.col("x.c.depth") - F.col("x.p.depth"))
    edges = each.select(F.col("x.p.node").alias("parent"), label.alias("label"), F.col("x.c.node").alias("child"), F.col("x.c.end").alias("end")).distinct()
    return edges.select("parent", F.substring("label", 1, 1).alias("first"), "label", "child", "end")


def _branched(tails: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, side, at, c, pos, node, end): the states after one edit, from every word's own states without one.

    The code point at ``at`` (from 0) is replaced by ``c``, or deleted where ``c`` is empty; ``pos`` code points of the word are read. In a run of equal ones
    the last is deleted, which gives the same word. Insertions are the other word's deletions.
    """
    own = tails.select("s", "side", F.explode("stops").alias("x")).select("s", "side", F.col("x.depth").alias("at"), F.col("x.node").alias("own"), F.col("x.open").alias("open"), F.col("x.end").alias("stop_end"))
    last = own.filter(F.col("stop_end") & (F.col("at") == F.char_length("s") - 1)).select("s", "side", "at", F.lit("").alias("c"), (F.col("at") + 1).alias("pos"), F.col("own").alias("node"), F.lit(True).alias("end"))
    met = own.filter("open").filter(F.col("at") < F.char_length("s")).join(edges, F.col("own") == F.col("parent")).filter(F.substring("s", F.col("at") + 1, F.lit(1)) != F.col("first"))
    size = F.char_length("label")
    replaced = F.substring("s", F.col("at") + 2, size - 1) == F.substring("label", F.lit(2), size)
    deleted = F.substring("s", F.col("at") + 2, size) == F.col("label")
    edits = F.array_compact(F.array(F.when(replaced, F.struct(F.col("first").alias("c"), (F.col("at") + size).alias("pos"))), F.when(deleted, F.struct(F.lit("").alias("c"), (F.col("at") + size + 1).alias("pos")))))
    moved = met.filter(replaced | deleted).select("s", "side", "at", F.explode(edits).alias("e"), F.col("child").alias("node"), "end")
    return moved.select("s", "side", "at", "e.c", "e.pos", "node", "end").unionByName(last)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, other): all ordered pairs of ``words`` (distinct, ``word``) that differ by exactly one inserted, deleted or replaced code point.

    Of two such words, either what is before the edit or what is after it is half of one of them or more, so the trie of words and that of
    reversed words are only walked with an edit in the later half, where they branch little. A round is one join of the states with the edge table, and
    a state after its edit has one way on at most; rounds end with the states, after as many as a word's later half has
    branchings. Pairs are compared at the end, so that colliding node hashes add none.
    """
    tails = trie_tails(words)
    edges = stage(trie_edges(tails), "trie-edges")
    states = stage(_branched(tails, edges), "states")
    unstage(tails)
    whole, found = F.col("pos") == F.char_length("s"), []
    rounds = [states]
    while True:
        ended = states.filter(whole & F.col("end"))
        found.append(ended.select("s", "side", F.concat(F.substring("s", F.lit(1), F.col("at")), "c", F.substring("s", F.col("at") + 2, F.char_length("s"))).alias("o")))
        live = states.filter(~whole).withColumn("next", F.substring("s", F.col("pos") + 1, F.lit(1))).drop("end")
        met = live.join(edges, (F.col("node") == F.col("parent")) & (F.col("next") == F.col("first"))).filter(F.substring("s", F.col("pos") + 1, F.char_length("label")) == F.col("label"))
        states = stage(met.select("s", "side", "at", "c", (F.col("pos") + F.char_length("label")).alias("pos"), F.col("child").alias("node"), "end"), "states")
        rounds.append(states)
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    turned = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(turned("s").alias("a"), turned("o").alias("b")).filter(F.levenshtein("a", "b", 1) == 1).distinct()
    pairs = stage(pairs, "near-pairs")
    for table in (edges, *rounds):
        unstage(table)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("word"), F.col("b").alias("other"))


def _last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form, or that word's form, and so on to the last. The way doubles each round; counts grow tenfold a step, so ways are short."""
    ways, changed = stage(forms.select("word", F.col("form").alias("root")), "roots"), True
    while changed:
        on = ways.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        after = stage(ways.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        unstage(ways)
        ways, changed = after, not after.filter("moved").isEmpty()
    return ways.select("word", "root")


def _with(s, i, c):
    """``s`` with ``c`` as its ``i``-th code point (from 1)."""
    return F.concat(F.substring(s, F.lit(1), i - 1), c, F.substring(s, i, F.char_length(s)))


def cut_links(words: DataFrame) -> DataFrame:
    """(word, n, near, best): rows whose ``near`` add up to the number of words one edit away, and whose least ``best`` is the first of these.

    ``best`` is a struct of ``n``, negative, and ``form``; null: none. Every word of ``words`` (distinct, ``word``, ``n``) has a row. A row of the shuffle is a word without its ``i``-th
    code point ``c``, or (``i`` 0) the whole word. Words that agree in what is left and in ``i`` differ by one replacement, and do so in no other place. What is left may also be
    a word itself: a deletion, which counts only at the last of equal code points. So no pair is met twice, and rows of what is left are counted, not paired;
    there are no more of them than letters times places in a word.
    """
    i = F.col("i")
    left = F.when(i == 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))))
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i")).select(left.alias("s"), "i", F.when(i > 0, F.substring("word", i, F.lit(1))).otherwise("").alias("c"), "n")
    same = Window.partitionBy("s")
    alike = Window.partitionBy("s", "i").orderBy(F.desc("n"), "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = cuts.repartition("s").sortWithinPartitions("s", "i", F.desc("n"), "c").withColumns({"k": F.count("*").over(same), "whole": F.max(F.when(i == 0, F.col("n"))).over(same)}).filter((F.col("k") > 1) | (i == 0))
    longer = (i > 0) & F.col("whole").isNotNull() & (F.substring("s", i, F.lit(1)) != F.col("c"))
    met = met.withColumn("word", F.when(i == 0, F.col("s")).otherwise(_with(F.col("s"), i, F.col("c")))).withColumn("longer", longer)
    met = met.withColumns({"n_longer": F.count_if("longer").over(same), "best_longer": F.min(F.when(F.col("longer"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("form")))).over(same)})
    met = met.withColumns({"m": F.count("*").over(alike), **{f"{x}{k}": F.nth_value(x, k).over(alike) for x in "nc" for k in (1, 2)}})
    n, c = (F.when(F.col("c") == F.col("c1"), F.col(f"{x}2")).otherwise(F.col(f"{x}1")) for x in "nc")
    replaced = F.when(F.col("m") > 1, F.struct((-n).alias("n"), _with(F.col("s"), i, c).alias("form")))
    other = F.when(i == 0, F.col("best_longer")).when(F.col("longer"), F.struct((-F.col("whole")).alias("n"), F.col("s").alias("form")))
    near = F.col("m") - 1 + F.when(i == 0, F.col("n_longer")).otherwise(F.col("longer").cast("long"))
    return met.select("word", "n", near.alias("near"), F.least(replaced, other).alias("best"), "i").filter((i == 0) | (F.col("near") > 0)).drop("i")


def walked_links(words: DataFrame) -> DataFrame:
    """As ``cut_links``, a row a pair, for words of more than ``LONG`` code points and their links with those of ``LONG``."""
    long, size = words.filter(F.char_length("word") >= LONG), F.char_length
    pairs = neighbours(long.select("word")).filter((size("word") > LONG) | (size("other") > LONG))
    counts = long.select(F.col("word").alias("__o"), F.col("n").alias("__n"))
    met = pairs.join(counts, F.col("other") == F.col("__o"))
    links = met.select("word", F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("__n")).alias("n"), F.col("other").alias("form")).alias("best"))
    own = long.filter(size("word") > LONG).select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(links.schema["best"].dataType).alias("best"))
    return links.unionByName(own)


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """Per word: ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of ``noisy_words`` that occur ``least_count`` times or more. ``n_near``: words one edit away (0: none); ``form``: the most frequent of them
    (ties: the first by code points) if it is ``factor`` times as frequent as the word or more, else null, as ``form_n``, its count; ``root``: from the word,
    forms followed to the last. Null and empty texts have no word, repeated rows count as often as they come, other columns are not read. An empty table
    gives no rows. Words are counted before they shuffle; a word's links are bounded by its length, and are counted where they meet.
    """
    spark = df.sparkSession
    with shuffle_files_dropped(spark):
        words = stage(noisy_words(df, id_col, text_col, least_length, every).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count), "words")
        links = cut_links(words.filter(F.char_length("word") <= LONG))
        if not words.filter(F.char_length("word") > LONG).isEmpty():
            links = links.unionByName(walked_links(words))
        judged = links.repartition("word").groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
        takes = -F.col("best.n") >= factor * F.col("n")
        judged = stage(judged.select("word", F.when(takes, F.col("best.form")).alias("form"), "n", "n_near", F.when(takes, -F.col("best.n")).alias("form_n")), "forms")
        roots = _last_forms(judged.filter("form IS NOT NULL")).select(F.col("word").alias("__w"), F.col("root").alias("__root"))
    return judged.join(roots, F.col("word") == F.col("__w"), "left").select("word", "form", F.coalesce("__root", "word").alias("root"), "n", "n_near", "form_n")
