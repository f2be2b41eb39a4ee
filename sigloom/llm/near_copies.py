"""Near copies by the exact Jaccard similarity of word shingles; SimHash fingerprints, then min-hash bands propose what is compared."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.components import connected_components
from sigloom.llm.exact_dedup import filter_room
from sigloom.llm.simhash import SEED, _words, fingerprint, linked_fingerprints
from sigloom.llm.staging import shuffle_files_dropped, small_batches, stage, unstage, wrapped
from sigloom.llm.tokens import drop_encoders

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 6
#: Differing bits of linked fingerprints.
BUDGET = 3
#: Neighbouring size bands differ by so much.
_BAND = 0.95
#: A text of a group in memory: two digests in hex, an id, and what a row of a broadcast takes besides.
_JUDGED_BYTES = 400


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; of fewer words than one, all of them together; without words that of nothing."""
    found, kept = [], []
    for words in _words(text or b""):
        words = kept + words
        found += [xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(len(words) - shingle + 1)]
        kept = words[-(shingle - 1) :] if shingle > 1 else []
    return np.unique(np.array(found or [xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64))


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS, block: int = 1024) -> np.ndarray:
    """A key per band: equal in two sets if ``rows`` min-hashes are. At a similarity of 0.8 all 40 bands of 6 differ in 5 of a million pairs."""
    random = np.random.default_rng(SEED)
    a, b = random.integers(0, 2**63, (2, bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), block):
        low = np.minimum(low, (((shingles[k : k + block] * a + b) >> np.uint64(29)) * b).min(1))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(bands, rows))], np.uint64).view(np.int64)


def similar_pairs(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets (``sets``: node, set) have a Jaccard similarity of ``least`` or more."""
    of = lambda x: sets.select(F.col("node").alias(f"__{x}"), F.col("set").alias(f"set_{x}"))
    met = pairs.join(of("a"), F.col("a") == F.col("__a")).join(of("b"), F.col("b") == F.col("__b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    sized = met.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return stage(sized.filter(F.col("both") >= least * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b"), "similar")


def prefix_pairs(sets: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of ``asked`` (node, comp): pairs of different ``comp`` that may have a similarity of ``least``; none that has is missing.

    Shingles are ordered from the rarest among these texts to the most frequent. Texts of sizes m and n that are similar share at least
    ``least / (1 + least) * (m + n)`` shingles, so the first one that they share is early enough in both orders to leave so many. Each
    text gives its early shingles for each band of sizes that a partner can have; a shingle of one text only is counted, and not given.
    Texts that share a template, and less than the similarity asks for, mostly give shingles that no other has.
    """
    near, step = ceil(log(least) / log(_BAND)) + 1, log(_BAND)
    texts = sets.join(asked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).select("node", "comp", "set", F.size("set").alias("n"))
    tokens = texts.select("node", "comp", "n", F.explode("set").alias("token"))
    shared = tokens.groupBy(F.col("token").alias("__token")).agg(F.count("*").alias("df")).filter("df > 1")
    met = tokens.join(shared, F.col("token") == F.col("__token"))
    ranked = met.groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ranked = stage(ranked.withColumn("band", F.floor(F.log("n") / -step).cast("int")), "ranked")
    dealt = ranked.withColumn("other", F.explode(F.sequence(F.col("band") - near, F.col("band") + near)))
    partner = F.greatest(F.ceil(F.col("n") * least - 1e-9), F.ceil(F.exp(F.col("other") * -step) - 1e-6), F.lit(1))
    needed = F.ceil((F.col("n") + partner) * (least / (1 + least)) - 1e-9)
    given = F.least(F.col("n") - needed + 1 - (F.col("n") - F.size("tokens")), F.size("tokens")).cast("int")
    early = dealt.filter((partner <= F.col("n") / least + 1e-9) & (given > 0))
    early = early.select("node", "comp", "n", (F.col("band") <= F.col("other")).alias("low"), (F.col("band") >= F.col("other")).alias("high"), F.least("band", "other").alias("x"), F.greatest("band", "other").alias("y"), F.explode(F.slice("tokens", F.lit(1), given)).alias("t"))
    early = stage(early.select("node", "comp", "n", "low", "high", "x", "y", F.col("t.token").alias("token")), "early")
    one = early.filter("low").select(*[F.col(c).alias(f"{c}_1") for c in ("node", "comp", "n", "x", "y", "token")])
    two = early.filter("high").select(*[F.col(c).alias(f"{c}_2") for c in ("node", "comp", "n", "x", "y", "token")])
    found = one.join(two, (F.col("token_1") == F.col("token_2")) & (F.col("x_1") == F.col("x_2")) & (F.col("y_1") == F.col("y_2")) & (F.col("comp_1") != F.col("comp_2")) & (F.col("n_1") >= F.col("n_2") * least - 1e-9) & (F.col("n_2") >= F.col("n_1") * least - 1e-9))
    return stage(found.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct(), "prefix-pairs")


def fingerprint_pairs(texts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b) of ``texts`` (node, fp): every text whose fingerprint is linked (see ``linked_fingerprints``) or equal to another's, with the first text of those."""
    linked = stage(linked_fingerprints(stage(texts.select("fp").distinct(), "distinct-fp"), budget), "linked-fp").select(F.col("node").alias("__fp"), "root")
    prints = stage(texts.join(linked, F.col("fp") == F.col("__fp"), "left").select("node", F.coalesce("root", "fp").alias("print")), "prints")
    firsts = prints.groupBy(F.col("print").alias("__print")).agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return stage(prints.join(firsts, F.col("print") == F.col("__print")).filter("node <> b").select(F.col("node").alias("a"), "b"), "fingerprint-pairs")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (with ``node``) and ``comp``: the component's root, or the node itself."""
    found = connected_components(links)
    return nodes.join(found.select(F.col("node").alias("__node"), "root"), F.col("node") == F.col("__node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("__node", "root")


def _digest(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _groups(df: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    with shuffle_files_dropped(df.sparkSession):
        return _grouped(df, id_col, text_col, shingle, least)


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """(``sha``, ``component_id``, ``keep_sha``) of every text, by its SHA-256, that another row's text equals or is similar to.

    Linked SimHash fingerprints propose first: each text is compared with the first of its fingerprint's component. Most pairs at the least similarity differ
    in more bits than these links allow, so bands of equal min-hashes propose the rest: each text not yet joined with it is compared with one other, the first of most of the buckets that it is in, which
    joins a group of copies of any size at a cost that grows with it, and the two texts of a bucket of two are compared. Where a larger bucket still has texts of different components, those
    texts' pairs across components come from ``prefix_pairs``, which leaves out none. Every link is by the exact similarity of stored shingle hashes; no task or
    row holds more than two texts' of them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), _digest(F.col(text_col)).alias("sha")).filter("id IS NOT NULL")
    kind = df.schema[id_col].dataType.simpleString()

    def keys(batches):
        drop_encoders()
        for batch in batches:
            found = [band_keys(shingle_set(t.as_py(), shingle)) for t in batch.column(1)]
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64())), pa.array(bits)], ["id", "sha", "keys", "fp"])

    def shingles(batches):
        drop_encoders()
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    with small_batches(spark):
        banded = rows.mapInArrow(keys, f"id {kind}, sha string, keys array<long>, fp long")
        alike = banded.groupBy("sha").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
        texts = stage(alike.withColumn("node", F.monotonically_increasing_id()), "bands")
    held = texts.select("node", F.explode("keys").alias("key"))
    sizes = held.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    there = stage(held.join(sizes, F.col("key") == F.col("bucket")).select("bucket", "node", "n"), "in-buckets")
    # Of a group of edited copies the text that they were made from meets most others: it is the first of its buckets.
    meets = there.groupBy(F.col("node").alias("__n")).agg(F.sum("n").alias("meets"))
    firsts = there.join(meets, F.col("node") == F.col("__n")).groupBy(F.col("bucket").alias("__bucket")).agg(F.max(F.struct("meets", "node"))["node"].alias("first"))
    inside = stage(there.join(firsts, F.col("bucket") == F.col("__bucket")).select("bucket", "node", "first", "n"), "in-buckets")
    unstage(there)
    close = fingerprint_pairs(texts.select("node", "fp"))
    # Only texts that share a bucket or whose fingerprints are linked are read again, one row of each.
    wanted = inside.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(texts.select(F.col("node").alias("__node"), F.col("sha").alias("__sha")), F.col("node") == F.col("__node"))
    with small_batches(spark):
        one = rows.join(wanted, F.col("sha") == F.col("__sha")).select("sha", "node", "text").dropDuplicates(["sha", "node"])
        sets = stage(one.select("node", "text").mapInArrow(shingles, "node long, set array<long>"), "shingles")
    asked = stage(inside.filter("node <> first").groupBy("node", "first").agg(F.count("*").alias("n"), (F.min("n") == 2).alias("two")), "asked")
    top = asked.groupBy("node").agg(F.max(F.struct("n", -F.col("first"))).alias("m")).select(F.col("node").alias("a"), (-F.col("m.col2")).alias("b"))
    # A bucket of two has one pair, which is compared whatever other buckets its texts are in.
    top = top.unionByName(asked.filter("two").select(F.col("node").alias("a"), F.col("first").alias("b"))).distinct()
    links = similar_pairs(sets, close, least)
    begun = stage(_roots(inside.select("node").distinct(), links), "begun")
    of = lambda x: begun.select(F.col("node").alias(f"__{x}"), F.col("comp").alias(f"comp_{x}"))
    unknown = top.join(of("a"), F.col("a") == F.col("__a")).join(of("b"), F.col("b") == F.col("__b")).filter("comp_a <> comp_b").select("a", "b")
    links = links.unionByName(similar_pairs(sets, unknown, least))
    named = stage(_roots(inside.filter("n > 2"), links), "named")
    mixed = named.groupBy(F.col("bucket").alias("__bucket")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("__bucket")
    left = stage(named.join(mixed, F.col("bucket") == F.col("__bucket")).select("node", "comp").distinct(), "left")
    if not left.isEmpty():
        links = links.unionByName(similar_pairs(sets, prefix_pairs(sets, left, least), least))
    placed = _roots(texts.select("node", "sha", "id", "copies"), stage(links, "links"))
    groups = placed.groupBy(F.col("comp").alias("__comp")).agg(F.min(F.struct("id", "sha")).alias("m"), F.sum("copies").alias("rows")).filter("rows > 1")
    return stage(placed.join(groups, F.col("comp") == F.col("__comp")).select("sha", F.col("m.id").alias("component_id"), F.col("m.sha").alias("keep_sha")), "near")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(``id``, ``sha``, ``component_id``, ``keep_sha``) of every row whose text, with this SHA-256, another row's text equals or is similar to.

    Similar: a Jaccard similarity of ``least`` or more in ``shingle``-word shingles of whole texts, A-Z lower-cased; words are runs of other than ASCII white space. A
    text of fewer words is one shingle; null counts as empty, and empty texts are alike. Rows are told apart by id and text: rows of one id with
    unlike texts are not linked by it, and equal rows are one here. ``component_id`` is the smallest id in the component, and ``keep_sha`` the first hash of
    its texts: the row that stands for the component has both. Rows with a null id are not looked at. An empty table gives no rows; other columns are not read.
    """
    found = _groups(df, id_col, text_col, shingle, least)
    own = df.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("__sha")).filter("id IS NOT NULL").distinct()
    return own.join(found, F.col("__sha") == F.col("sha")).select("id", "sha", "component_id", "keep_sha")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of ``df``, all columns as they are whatever their names, but of each component (see ``near_copies``) only one row: of its first id, and of that its first text.

    Of equal rows any one stays; rows with a null id all stay. An empty table gives no rows.
    """
    found = _groups(df, id_col, text_col, shingle, least)
    rows = wrapped(df).withColumn("sha", F.when(F.col("row")[id_col].isNotNull(), _digest(F.col("row")[text_col])))
    judged = found.select(F.col("sha").alias("__sha"), "keep_sha", "component_id")
    # Only texts of groups are in it: while they fit, no other text has to move.
    if judged.count() * _JUDGED_BYTES <= filter_room(df.sparkSession):
        judged = F.broadcast(judged)
    met = rows.join(judged, F.col("sha") == F.col("__sha"), "left")
    alone = met.filter("keep_sha IS NULL").select("row.*")
    stays = met.filter((F.col("sha") == F.col("keep_sha")) & (F.col("row")[id_col] == F.col("component_id")))
    return alone.unionByName(stays.dropDuplicates(["sha"]).select("row.*"))
