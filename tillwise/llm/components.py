"""Connected components of a graph in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import store

# A node with more than one in so many links is hot; fewer than twice as many nodes can be.
HOT_SHARE = 1000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (``a``, ``b``, both long); nodes are
    connected if and only if their roots are equal.

    Rounds of contraction: every node moves to its neighbour with the smallest hash, if that is
    smaller than its own; links then run between the nodes moved to. The hash is another one
    each round, so a fixed share of the nodes goes in each, whatever the shape of the graph.
    What a round leaves is stored; loops and repeated links are dropped on the way. Where hot nodes
    move to is broadcast, as they are few, so their links need not meet in one task.
    """
    between = store(_plain(links), "links")
    moved: list[DataFrame] = []
    turn = 0
    while (n_links := between.count()) > 0:
        both = between.union(between.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("hash"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("hash"), F.col("a").alias("node"))
        least = both.groupBy("a").agg(F.min(rank).alias("least"), F.count("*").alias("n"))
        to = F.least("least", own).getField("node").alias("to")
        hot = (F.col("n") > n_links // HOT_SHARE).alias("hot")
        step = store(least.select(F.col("a").alias("node"), to, hot), "moved")
        moved.append(step.drop("hot"))
        again = _end_moved(_end_moved(between, step, "a"), step, "b")
        between = store(_plain(again), "links")
        turn += 1
    if not moved:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = moved[-1].select("node", F.col("to").alias("root"))
    for step in reversed(moved[:-1]):
        ends = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(ends, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        roots = store(roots, "roots")
    return roots


def _end_moved(links: DataFrame, step: DataFrame, end: str) -> DataFrame:
    """``links`` with one of its ends replaced by the node it moves to."""
    nodes = step.select(F.col("node").alias(end), F.col("to").alias("moved"), "hot")
    hot = F.broadcast(nodes.where("hot").drop("hot"))
    rest = links.join(hot, end, "left_anti").join(nodes.where("not hot").drop("hot"), end)
    both = links.join(hot, end).unionByName(rest)
    return both.drop(end).withColumnRenamed("moved", end)


def _plain(links: DataFrame) -> DataFrame:
    """Each link once, no loops."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.where("a <> b").distinct()
