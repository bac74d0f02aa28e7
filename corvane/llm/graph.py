"""Connected components of a table of links, by contracting every node to the least of its neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common


def _order(node: str) -> Column:
    """Nodes in pseudo-random order, so that chains contract by a constant share a round."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, label): nodes have the same label if links join them.

    A round sends every node to the least node (in hash order) among itself and its neighbours and rewrites the links
    between those; it ends when none is left. Rounds grow as the logarithm of the nodes. A hub costs no more than a row
    a task, as neighbourhoods are aggregated before the shuffle, and its joins may be split. Each round is written to
    the shared folder. Links of a node with itself give the node a label; nulls are dropped.
    """
    links = links.select("a", "b").filter("a is not null and b is not null")
    edges = common.stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds: list[DataFrame] = []
    while True:
        to = edges.groupBy("a").agg(F.min(_order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", _order("a")).alias("m"))
        to = common.stored(to.select("node", F.col("m.node").alias("label")))
        rounds.append(to)
        left, right = to.select(F.col("node").alias("a"), F.col("label").alias("_a")), to.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        edges = edges.join(left, "a").join(right, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        edges = common.stored(edges)
        if edges.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("_label", "label").alias("label"))
    return found
