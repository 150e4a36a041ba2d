"""Connected components of a graph given as edges, by alternating large and small stars.

In each round every node's neighbours are hung on the smallest node near it, until nothing changes.
Minima are combined before the shuffle and joined back, so a node with very many neighbours is a
skewed join, which Spark splits, never one group. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(
        F.least("m", "a").alias("a"), "b"
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    joined = edges.join(least, F.col("b") == F.col("u"))
    return joined.select(F.col("m").alias("a"), "b").union(
        joined.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge (a, b)."""
    edges = staged(
        edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = None
    while True:
        edges = staged(_small_star(_large_star(edges)).distinct(), "stars")
        # Stars whose centres are smallest stay as they are: the same edges twice in a row.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
