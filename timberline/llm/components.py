"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import done, spread, written


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least v of each u; combined before the shuffle and joined back, so that a hub can be split."""
    return pairs.join(spread(pairs.groupBy("u").agg(F.min("v").alias("m"))), "u")


def _done(pairs: DataFrame) -> bool:
    """Whether each node hangs under one other that hangs under none."""
    nodes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    most = nodes.agg(F.max("n")).first()[0]
    return most is None or most == 1 and not pairs.join(nodes.select(F.col("u").alias("v")), "v", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node of ``edges`` (``a, b``): ``root`` is the smallest node that it reaches.

    Each round hangs every node under smaller ones, in a number of rounds that grows with the logarithm of a
    component's size; only edges move, and no node's edges are gathered. Null ends and loops are left out.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct()
    pairs = written(pairs, "edges")
    while not _done(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _least(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, pairs = pairs, written(small.where("u <> v").distinct(), "edges")
        done(before)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
