"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stage


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b); the root is the least node of the component.

    Turns by turns every node's greater neighbours, then its lesser ones, are tied to
    its least neighbour, until nothing but stars around roots is left.  Only least
    neighbours are gathered per node, so a hub is summed before it is shuffled.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = stage(pairs, "edges")
    while True:
        size, mark = _state(pairs)
        if not size:
            break
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # greater neighbours of each node go to the least around it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large")
        # lesser neighbours of each node, and the node, go to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = down.unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = stage(down, "small")
        if _state(pairs) == (size, mark):
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(pairs: DataFrame) -> tuple[int, object]:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
