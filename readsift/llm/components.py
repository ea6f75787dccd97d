"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round links neighbours to the least node that they see, until all that remains are stars around the least node of
each component. Every step is a grouped minimum and a join on the node, so a node with very many links is combined
before the shuffle and split by adaptive execution after it. Rounds are cut off in the shared folder; nothing but two
counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm.common import compact, cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lifted = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return lifted.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _done(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (a > b), materialised, and how many nodes keep them from being stars: such as have two edges down, or
    edges both ways."""
    done = cut(edges)
    ends = done.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(done.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    bad = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("all") > 1))
    rows, wrong = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(bad)).collect()[0]
    return compact(done, rows), wrong


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for every node of an edge (a, b) with a <> b; nulls are dropped."""
    now, wrong = _done(_small(edges.select("a", "b").where("a <> b")))
    while wrong:
        now, wrong = _done(_small(_large(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
