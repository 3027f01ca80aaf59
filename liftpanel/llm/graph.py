"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import written


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; the root is the smallest node that can be reached.

    Rounds of large-star and small-star: each node's larger neighbours, then the node itself, are tied to
    the smallest neighbour. Minima are combined before they are shuffled, so a node with very many links
    costs one row per task; the joins are inner joins that adaptive execution may split. The edges of each
    round are a written table. It ends when a round changes nothing, after a number of rounds that grows
    with the logarithm of the longest path. Links of a node to itself and repeated links count once; an
    empty table gives an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "links")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select("a", F.col("m").alias("b")).union(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "links")
        now = _signature(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
