"""Variable-order prediction: counts of what follows each context, and backing off from long contexts to short ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternfold.schema import KEY, by_series


def contexts(obs: DataFrame, max_order: int = 2) -> DataFrame:
    """Every present label with each context before it that has no missing label: series_id, idx, ord, ctx, nxt."""
    w = by_series()
    parts = []
    for o in range(max_order + 1):
        ctx = F.array(*[F.lag("label", k).over(w) for k in range(o, 0, -1)]) if o else F.array().cast("array<string>")
        parts.append(obs.select(KEY, "idx", F.lit(o).cast("long").alias("ord"), ctx.alias("ctx"), F.col("label").alias("nxt")))
    every = reduce(DataFrame.unionByName, parts)
    return every.where(F.col("nxt").isNotNull() & ~F.exists("ctx", lambda x: x.isNull()))


def context_model(obs: DataFrame, max_order: int = 2) -> DataFrame:
    """ord, ctx, nxt, cnt. A label before a series' begin counts as missing."""
    return contexts(obs, max_order).groupBy(KEY, "ord", "ctx", "nxt").agg(F.count("*").alias("cnt"))


def with_probability(model: DataFrame) -> DataFrame:
    return model.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(KEY, "ord", "ctx")))


def suffixes(obs: DataFrame, max_order: int = 2) -> DataFrame:
    """The last labels of each series, in every length from 0 to max_order: series_id, ord, ctx."""
    tail = obs.where("label is not null").withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("idx")))).where(F.col("_r") <= max(1, max_order))
    last = tail.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("_l"))
    o = F.explode(F.sequence(F.lit(0), F.least(F.lit(max_order), F.size("_l"))))
    return last.select(KEY, "_l", o.alias("o")).select(KEY, F.col("o").cast("long").alias("ord"), F.when(F.col("o") == 0, F.array().cast("array<string>")).otherwise(F.expr("slice(_l, size(_l) - o + 1, o)")).alias("ctx"))


def backoff(model: DataFrame, asked: DataFrame, top_k: int = 3) -> DataFrame:
    """For contexts (series_id, ord, ctx: all suffixes of one), the likeliest next labels of the longest that is known."""
    met = with_probability(model).join(asked, [KEY, "ord", "ctx"]).withColumn("_o", F.max("ord").over(Window.partitionBy(KEY))).where("ord = _o")
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("cnt"), "nxt"))
    return met.select(KEY, "ord", "nxt", "cnt", "p", rank.cast("long").alias("rank")).where(F.col("rank") <= top_k)


def log_loss(model: DataFrame, obs: DataFrame, max_order: int = 2) -> DataFrame:
    """Per series, the mean of -log2(p) of its labels, each from the longest context in which it is known; scored counts them."""
    met = contexts(obs, max_order).join(with_probability(model), [KEY, "ord", "ctx", "nxt"])
    best = met.groupBy(KEY, "idx").agg(F.max_by("p", "ord").alias("p"))
    return best.groupBy(KEY).agg(F.avg(-F.log2("p")).alias("log_loss"), F.count("*").alias("scored"))
