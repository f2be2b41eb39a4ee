"""Connected components by contraction: every vertex joins the first of its neighbours until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.staging import stage


def contract(edges: DataFrame) -> list[DataFrame]:
    """One staged (``node``, ``root``) table a round, each over the vertices that the round before left with edges.

    A round maps a vertex to the first of itself and its neighbours and keeps the distinct edges between different images.
    First means smallest in the first round, which ends stars around their smallest member at once, and smallest in a new hashed order in
    each later round: then a round is expected to leave a fixed share of the vertices, whatever the graph, so that rounds grow with
    the logarithm of the vertices. Tables shrink from round to round. Firsts are combined before they shuffle, and
    the tables that a hot vertex's edges join with are read from files, so that Spark can split such joins.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("a", "node")
        if rounds:
            place = lambda x: F.struct(F.xxhash64(x, F.lit(len(rounds))).alias("at"), F.col(x).alias("x"))  # noqa: E731, B023
            first = both.groupBy("node").agg(F.min(place("b")).alias("b")).select("node", F.least(place("node"), "b")["x"].alias("root"))
        else:
            first = both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
        first = stage(first, "first")
        rounds.append(first)
        of_a, of_b = (first.select(F.col("node").alias(f"__{x}"), F.col("root").alias(f"__r{x}")) for x in "ab")
        moved = edges.join(of_a, F.col("a") == F.col("__a")).join(of_b, F.col("b") == F.col("__b")).filter("__ra <> __rb")
        edges = stage(moved.select(F.least("__ra", "__rb").alias("a"), F.greatest("__ra", "__rb").alias("b")).distinct(), "edges")
    return rounds


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``); equal roots mean connected.

    Rounds (see ``contract``) are put together from the last to the first, so each is joined once. Nulls and self-loops are dropped; an
    empty input gives no rows.
    """
    rounds = contract(edges)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    labels = rounds.pop()
    while rounds:
        onward = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        labels = stage(rounds.pop().join(onward, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root")), "labels")
    return labels
