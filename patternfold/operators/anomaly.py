"""Anomalies of a batch: values far from the mean, label pairs nobody has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.operators.sequence import ngrams
from patternfold.schema import KEY, number

#: Scores of unknown label pairs, by whether their first label is known.
MISSING_TRANSITION, NOVEL_SEQUENCE = 0.55, 0.60


def series_stats(obs: DataFrame) -> DataFrame:
    """series_id, mean, stdev of the numbers; 0 where there is none."""
    return obs.groupBy(KEY).agg(F.coalesce(F.avg(number()), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(number()), F.lit(0.0)).alias("stdev"))


def statistical(obs: DataFrame, stats: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Values ``threshold`` deviations off at least: idx, value, z, score, kind."""
    if threshold <= 0:
        raise PatternError("threshold must be positive")
    met = obs.join(stats, KEY).where((F.col("stdev") > 0) & number().isNotNull())
    z = (F.col("value") - F.col("mean")) / F.nullif(F.col("stdev"), F.lit(0.0))
    return met.withColumn("z", z).where(F.abs("z") >= threshold).select(KEY, "idx", "value", F.lit(None).cast("string").alias("label"), "z", F.least(F.lit(1.0), F.abs("z") / (2 * threshold)).alias("score"), F.lit("statistical").alias("kind"))


def known_bigrams(patterns: DataFrame) -> DataFrame:
    """Distinct adjacent pairs a, b of the sequences of patterns."""
    pairs = F.expr("CASE WHEN size(sequence) < 2 THEN cast(array() AS array<struct<a:string,b:string>>) ELSE zip_with(slice(sequence, 1, size(sequence) - 1), slice(sequence, 2, size(sequence) - 1), (x, y) -> struct(x AS a, y AS b)) END")
    return patterns.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def novel_pairs(obs: DataFrame, known: DataFrame) -> DataFrame:
    """Adjacent labels that are no known pair, at the second one: nothing if no pair is known."""
    pairs = ngrams(obs, 2).select(KEY, (F.col("idx") + 1).alias("idx"), F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b")).where("a is not null and b is not null")
    unseen = pairs.join(known, ["a", "b"], "left_anti")
    heads = known.select("a").distinct().withColumn("_known", F.lit(True))
    some = known.agg((F.count("*") > 0).alias("_some"))  # one row
    out = unseen.join(heads, "a", "left").crossJoin(F.broadcast(some)).where("_some")
    kind = F.when(F.col("_known"), "missing_transition").otherwise("novel_sequence")
    return out.select(KEY, "idx", F.lit(None).cast("double").alias("value"), F.col("b").alias("label"), F.lit(None).cast("double").alias("z"), F.when(F.col("_known"), MISSING_TRANSITION).otherwise(NOVEL_SEQUENCE).alias("score"), kind.alias("kind"))


def detect(obs: DataFrame, patterns: DataFrame | None = None, threshold: float = 3.0) -> DataFrame:
    """statistical() against the batch itself and, with patterns, novel_pairs()."""
    out = statistical(obs, series_stats(obs), threshold)
    return out if patterns is None else out.unionByName(novel_pairs(obs, known_bigrams(patterns)))
