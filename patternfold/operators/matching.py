"""Observations against patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternfold.schema import KEY


def similarity(label: Column, value: Column, sequence: Column, features: Column) -> Column:
    """The better of two: twice the label's share in the sequence if it is in there, 2 / (1 + length), and closeness
    1 / (1 + |value - centre| / scale) to the mean of a numeric sequence, scaled by the pattern's spread if it has one."""
    by_label = F.when(F.array_contains(sequence, label), 2.0 / (1.0 + F.size(sequence))).otherwise(0.0)
    numbers = F.transform(sequence, lambda x: x.try_cast("double"))
    centre = F.when((F.size(sequence) > 0) & ~F.exists(numbers, lambda x: x.isNull()), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sequence), F.lit(0)))
    scales = [F.when(features[k] > 0, features[k]) for k in ("stdev", "std", "stddev", "scale", "spread")]
    scale = F.coalesce(*scales, F.lit(1.0))
    by_value = F.coalesce(1.0 / (1.0 + F.abs(value - centre) / scale), F.lit(0.0))
    return F.greatest(F.coalesce(by_label, F.lit(0.0)), by_value)


def match(obs: DataFrame, patterns: DataFrame, least: float = 0.5, top: int | None = None) -> DataFrame:
    """Every observation against every pattern of its series: idx, id, similarity, matched (``least`` or more), rank.

    Observations meet patterns by series. ``top`` keeps the best ones of each observation.
    """
    p = patterns.select(KEY, "id", "sequence", "features")
    met = obs.join(p, KEY).withColumn("similarity", similarity(F.col("label"), F.col("value"), F.col("sequence"), F.col("features")))
    rank = F.row_number().over(Window.partitionBy(KEY, "idx").orderBy(F.desc("similarity"), F.length("id"), "id"))
    out = met.select(KEY, "idx", "id", "similarity", (F.col("similarity") >= least).alias("matched"), rank.cast("long").alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)
