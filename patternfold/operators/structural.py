"""Graphs and baskets: co-occurrence, connected components, association rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.schema import KEY, by_series, compressed
from patternfold.storage import written


def cooccurrence(obs: DataFrame, size: int = 2) -> DataFrame:
    """Undirected pairs a < b of different labels within ``size`` consecutive present ones, with their count."""
    if size < 2:
        raise PatternError("size must be 2 at least")
    w = by_series("pos")
    v = compressed(obs, keep=F.col("label").isNotNull())
    parts = [v.select(KEY, F.col("label").alias("x"), F.lead("label", k).over(w).alias("y")) for k in range(1, size)]
    pairs = reduce(DataFrame.unionByName, parts).where("y is not null and x != y")
    return pairs.groupBy(KEY, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("count"))


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 64) -> DataFrame:
    """node, component (its least node) for edges a, b of any ordered type; ``nodes`` (node) adds those without an edge.

    Least labels spread along edges and are then taken over from the label's own label, so chains shorten by half each
    round. Rounds are written to the shared folder; the last is the one that changes nothing.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    every = both.select(F.col("a").alias("node"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    both = written(both, "edges")
    labels = written(every.distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("_near"))
        one = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("_near", "component")).alias("component"))
        up = one.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = written(one.join(up, F.col("component") == F.col("_n")).select("node", F.least("component", "_c").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "_old"), "node").where("component != _old").isEmpty()
        labels = new
        if changed:
            return labels
    raise PatternError("components did not settle")


def association_rules(baskets: DataFrame, min_support: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """Per series, rules antecedent -> consequent between items of its transactions (series_id, txn, item): count, support
    (share of transactions), confidence. A repeated item counts once in a transaction."""
    items = baskets.select(KEY, "txn", "item").where("item is not null").distinct()
    n = items.select(KEY, "txn").distinct().groupBy(KEY).agg(F.count("*").alias("_n"))
    single = items.groupBy(KEY, "item").agg(F.count("*").alias("_c"))
    frequent = items.join(single.where(F.col("_c") >= min_support).select(KEY, "item"), [KEY, "item"], "left_semi")
    left, right = frequent.select(KEY, "txn", F.col("item").alias("a")), frequent.select(KEY, "txn", F.col("item").alias("b"))
    pairs = left.join(right, [KEY, "txn"]).where("a < b").groupBy(KEY, "a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= min_support)
    both = pairs.select(KEY, F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "count").union(pairs.select(KEY, "b", "a", "count"))
    rules = both.join(single.select(KEY, F.col("item").alias("antecedent"), "_c"), [KEY, "antecedent"]).join(n, KEY)
    return rules.select(KEY, "antecedent", "consequent", "count", (F.col("count") / F.col("_n")).alias("support"), (F.col("count") / F.col("_c")).alias("confidence")).where(F.col("confidence") >= min_confidence)


def rank_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("confidence"), F.desc("support"), "antecedent", "consequent")).cast("long"))
