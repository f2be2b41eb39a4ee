"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.staging import rank_within, running_total, stage

OVERHEAD = 8
#: While labels propagate, a shard may take so many times its share: what is above it moves on by whole groups afterwards.
SLACK = 1.1


def _uniform(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def odds(asks: dict[tuple[int, int], int], room: list[float]) -> list[float]:
    """For every pair (from, to) of shards, flat, the share of the requested bytes that may move.

    What two shards ask of each other is swapped, which changes no size; what is asked beyond that shares the room of the shard
    that it goes to.
    """
    shards = len(room)
    swapped = {(i, j): min(n, asks.get((j, i), 0)) for (i, j), n in asks.items()}
    beyond = [sum(n - swapped[i, j] for (i, j), n in asks.items() if j == k) for k in range(shards)]
    share = [min(1.0, room[k] / beyond[k]) if beyond[k] else 0.0 for k in range(shards)]
    out = [0.0] * (shards * shards)
    for (i, j), n in asks.items():
        out[i * shards + j] = (swapped[i, j] + (n - swapped[i, j]) * share[j]) / n
    return out


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, capacity: float, rounds: int = 4) -> DataFrame:
    """(``node``, ``size``, ``label``) after ``rounds`` of label propagation; ``edges`` (``a``, ``b``) have a < b, each once.

    A node starts at its ``label``, if ``nodes`` has one; else where its smallest neighbour, or itself if that is smaller, hashes to. In a round a node asks
    for the label that most neighbours have (of equals the smallest), and requests are granted under quotas (see ``odds``), by a hash
    of the node and the round. In even rounds only smaller neighbours count, so that two neighbours do not swap labels for ever; in odd rounds
    all do, and half of the nodes hold still. Loads and requests, ``shards`` squared rows, are all that the driver sees.
    """
    start = nodes
    if "label" not in nodes.columns:
        smallest = edges.groupBy(F.col("b").alias("__b")).agg(F.min("a").alias("__a"))
        start = nodes.join(smallest, F.col("node") == F.col("__b"), "left").withColumn("label", F.pmod(F.xxhash64(F.coalesce("__a", "node")), F.lit(shards)).cast("int"))
    labels = stage(start.select("node", "size", "label"), "labels")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for step in range(rounds):
        heard = edges.select(F.col("b").alias("src"), F.col("a").alias("dst")) if step % 2 == 0 else both.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        theirs = labels.select(F.col("node").alias("__dst"), F.col("label").alias("wanted"))
        votes = heard.join(theirs, F.col("dst") == F.col("__dst")).groupBy("src", "wanted").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("wanted")).alias("w"))).alias("m")).select("src", (-F.col("m.w")).alias("wanted"))
        asked = labels.join(best, F.col("node") == F.col("src"), "left").select("node", "size", "label", F.coalesce("wanted", "label").alias("wanted"))
        asked = stage(asked, "asked")
        flows = asked.groupBy("label", "wanted").agg(F.sum("size").alias("s")).collect()
        asks = {(r["label"], r["wanted"]): r["s"] for r in flows if r["label"] != r["wanted"]}
        if not asks:
            break
        load = [sum(r["s"] for r in flows if r["label"] == k) for k in range(shards)]
        granted = F.array(*[F.lit(x) for x in odds(asks, [max(0.0, capacity - x) for x in load])])[F.col("label") * shards + F.col("wanted")]
        grants = (F.col("wanted") != F.col("label")) & (_uniform("node", F.lit(step)) < granted)
        if step % 2:
            grants &= F.pmod(F.xxhash64("node", F.lit(-step)), F.lit(2)) == 0
        labels = stage(asked.select("node", "size", F.when(grants, F.col("wanted")).otherwise(F.col("label")).alias("label")), "labels")
    return labels


def _laid(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: where each node of staged ``df`` begins when its key's nodes lie end to end, those of a ``group`` side by side."""
    inside = running_total(df, [*keys, "group"], ["node"], F.col("size"), "__in")
    groups = stage(df.groupBy(*keys, "group").agg(F.sum("size").alias("__sum")), "group-sizes")
    begins = running_total(groups, keys, ["group"], F.col("__sum"), "__begin").select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "group"]], "__begin")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__of_{k}") for k in [*keys, "group"]])
    return inside.join(begins, same).withColumn(name, F.col("__begin") + F.col("__in")).drop("__in", "__begin", *[f"__of_{k}" for k in [*keys, "group"]])


def _fill(laid: DataFrame, room: list[float], total: int) -> DataFrame:
    """Replace ``label`` of nodes that lie end to end from ``__at`` on: they fill each shard's ``room`` in turn."""
    whole, bounds, at = sum(room) or 1.0, [], 0.0
    for x in room[:-1]:
        at += x
        bounds.append(at / whole * total)
    middle = F.col("__at") + F.col("size") / 2
    return laid.withColumn("label", sum([(middle >= x).cast("int") for x in bounds], F.lit(0))).drop("__at")


def _loads(labels: DataFrame, shards: int) -> list[int]:
    found = {r["label"]: r["s"] for r in labels.groupBy("label").agg(F.sum("size").alias("s")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def even_out(labels: DataFrame, shards: int, capacity: float) -> DataFrame:
    """Staged (``node``, ``group``, ``size``, ``label``) with no shard above ``capacity`` by more than half of a node.

    Each shard's nodes lie end to end by group; those past the capacity leave and fill what the other shards have free, end to end by group
    again. So at most two groups a shard are parted, besides those larger than a shard.
    """
    if max(_loads(labels, shards)) <= capacity:
        return labels
    laid = stage(_laid(labels, ["label"], "__at").withColumn("__stays", F.col("__at") + F.col("size") / 2 <= capacity).drop("__at"), "laid")
    stay, leave = laid.filter("__stays").drop("__stays"), stage(laid.filter("NOT __stays").drop("__stays", "label"), "leaving")
    loads, total = _loads(stay, shards), leave.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    moved = _fill(_laid(leave, [], "__at"), [max(0.0, capacity - x) for x in loads], total)
    return stage(stay.unionByName(moved.select(*stay.columns)), "evened")


def shard_documents(df: DataFrame, shards: int = 24, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law`` (bytes), ``shard``, ``slot``, ``grown_shard`` (null).

    Sizes (bytes and 8) of the shards are equal but for about a document, the largest. Documents with equal texts (null: empty) are linked to the
    first of them. Each starts where it hashes to itself, and propagation brings those of a group together, up to ``SLACK`` of a shard's size; shards that
    get too much pass whole groups on (see ``even_out``), and the documents without copies fill
    what is left. A group larger than a shard is split among shards. Each row is a node of its own, so null ids and repeated rows are
    shards' rows like any other. Slots are gapless from 0 in each shard. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("sha"))
    base = stage(base.withColumn("node", F.monotonically_increasing_id()), "documents")
    groups = stage(base.groupBy(F.col("sha").alias("__s")).agg(F.min("node").alias("hub"), F.count("*").alias("__n")).filter("__n > 1").select("__s", "hub"), "text-groups")
    linked = stage(base.join(groups, F.col("sha") == F.col("__s"), "left").select("id", "size", "crc", "node", "hub"), "linked")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    edges = stage(linked.filter("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")
    nodes = linked.filter("hub IS NOT NULL").select("node", "size", "hub")
    apart = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("label")
    labels = propagate(nodes.select("node", "size", apart), edges, shards, SLACK * total / shards, rounds)
    grouped = labels.join(nodes.select(F.col("node").alias("__node"), F.col("hub").alias("group")), F.col("node") == F.col("__node")).drop("__node")
    labels = even_out(stage(grouped.select("node", "group", "size", "label"), "grouped"), shards, total / shards)
    loads = _loads(labels, shards)
    free = running_total(linked.filter("hub IS NULL").select("node", "size"), [], ["node"], F.col("size"), "__at")
    filled = _fill(free, [max(0.0, total / shards - x) for x in loads], total - sum(loads)).select(F.col("node").alias("__node"), F.col("label").cast("int").alias("shard"))
    given = labels.select(F.col("node").alias("__node"), F.col("label").cast("int").alias("shard")).unionByName(filled)
    final = stage(linked.join(given, F.col("node") == F.col("__node")).select("id", "size", "crc", "node", "shard"), "sharded")
    ranked = rank_within(final, ["shard"], ["node"], "slot")
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
