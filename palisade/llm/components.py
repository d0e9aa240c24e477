"""Connected components of an undirected graph, by alternating stars over tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import checkpointed


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest node it sees (large star, small
    star); rows never exceed the edges, and the rounds are logarithmic in the longest path. Null ends are ignored.
    """
    rows = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rows = checkpointed(rows)
    before = None
    while True:
        both = _both(rows)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        rows = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
