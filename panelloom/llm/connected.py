"""Connected components of a stored edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node of ``edges`` (a, b): node, label.

    Large-star and small-star rounds in turn: every node hands its neighbours to the least
    node it knows, until all edges are stars around the least node of a component.  Rounds
    grow with the logarithm of the number of nodes.  Minima are combined before the
    shuffle and the joins have one row per key on one side, so a node with very many
    neighbours can be split.  Each round is stored.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = stored(pairs.distinct(), "edges")
    state = None
    while True:
        new = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select("b", "b").distinct()
            )
        state = new
        now = stored(_small_star(_large_star(now)).distinct(), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").where("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return handed.union(least)
