"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternfold.llm import shared


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (itself included)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (its least node) for every node of the links a, b (long). Nodes without a link don't occur.

    Each round is written to the shared folder; the rounds end when the links no longer change, which is when each
    is from a node to its component's least node. Their number grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    path = shared.fresh(spark, "links")
    links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().write.parquet(path)
    read = lambda p: spark.read.schema("a long, b long").parquet(p)
    edges = read(path)
    for _ in range(rounds):
        then = shared.fresh(spark, "links")
        _small(_large(edges)).write.parquet(then)
        now = read(then)
        same = now.count() == edges.count() and now.join(edges, ["a", "b"], "left_anti").isEmpty()
        shared.remove(spark, path)
        path, edges = then, now
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
    raise RuntimeError("components did not settle")
