"""What comes next in each series: by transitions, by context, by closed-form rule, by trend, by season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternfold.config import Config
from patternfold.operators import arithmetic, context, sequence, stats
from patternfold.schema import KEY, compressed


def markov(obs: DataFrame, top_k: int = 3, current: DataFrame | None = None) -> DataFrame:
    rows = obs.where("label is not null")
    rows = compressed(rows, keep=F.col("label").isNotNull()).drop("idx").withColumnRenamed("pos", "idx")
    return sequence.predict_next(sequence.transitions(rows), sequence.last_labels(rows) if current is None else current, top_k)


def by_context(obs: DataFrame, config: Config, top_k: int = 3) -> DataFrame:
    return context.backoff(context.context_model(obs, config.context_order), context.suffixes(obs, config.context_order), top_k)


def trend_forecast(obs: DataFrame, steps: int = 3) -> DataFrame:
    """last + slope * 1 .. steps."""
    last = obs.where("value is not null").groupBy(KEY).agg(F.max_by("value", "idx").alias("_x"))
    t = stats.trend(obs).join(last, KEY)
    return t.select(KEY, "slope", F.array(*[F.col("_x") + F.col("slope") * k for k in range(1, steps + 1)]).alias("forecast"))


def seasonal_forecast(obs: DataFrame, periods: DataFrame, least: float = 0.5) -> DataFrame:
    """Per series with a period (series_id, period, strength) of at least that strength, the mean value of the next row's phase."""
    v = compressed(obs)
    n = v.groupBy(KEY).agg(F.count("*").alias("_n"))
    met = v.join(periods.where(F.col("strength") >= least), KEY).join(n, KEY)
    return met.where("pos % period = _n % period").groupBy(KEY).agg(F.first("period").alias("period"), F.avg("value").alias("forecast"))


def next_symbol(obs: DataFrame, config: Config) -> DataFrame:
    """Per series one answer: the rule's next value if it is sure (0.9 or more), else the context's if no less likely than
    the transition's, else the transition's: next, probability, method."""
    rule = arithmetic.solve(obs).where("confidence >= 0.9").select(KEY, F.col("next")[0].cast("string").alias("_r"), F.col("confidence").alias("_rp"))
    c = by_context(obs, config, 1).select(KEY, F.col("nxt").alias("_c"), F.col("p").alias("_cp"))
    m = markov(obs, 1).select(KEY, F.col("next").alias("_m"), F.col("probability").alias("_mp"))
    every = obs.select(KEY).distinct().join(rule, KEY, "left").join(c, KEY, "left").join(m, KEY, "left")
    by_rule, by_ctx = F.col("_r").isNotNull(), F.col("_c").isNotNull() & (F.col("_cp") >= F.coalesce("_mp", F.lit(0.0)))
    pick = lambda r, x, y: F.when(by_rule, F.col(r)).when(by_ctx, F.col(x)).otherwise(F.col(y))
    method = F.when(by_rule, "rule").when(by_ctx, "context").when(F.col("_m").isNotNull(), "transition").otherwise("none")
    return every.select(KEY, pick("_r", "_c", "_m").alias("next"), pick("_rp", "_cp", "_mp").alias("probability"), method.alias("method"))
