"""Operators with row frames: moving statistics, delay embedding, change points, seasons, online anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.functions.columns import safe_ratio
from patternfold.schema import KEY, by_series, clamp, compressed, finite, number

INF = float("inf")


def moving_average(obs: DataFrame, size: int) -> DataFrame:
    """Mean of the last ``size`` rows, this one included; missing values are left out, null if there is no other."""
    if size < 1:
        raise PatternError("size must be 1 at least")
    return obs.withColumn("moving_average", F.avg(number()).over(by_series().rowsBetween(1 - size, 0)))


def running_stats(obs: DataFrame) -> DataFrame:
    """Per series: n, missing, mean, variance, stdev over finite values. Partial and final sums merge, in streams too."""
    v = finite()
    return obs.groupBy(KEY).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stdev"))


def sliding_stats(obs: DataFrame, size: int) -> DataFrame:
    """Observations with n, mean, stdev of the last ``size`` rows (missing ones take a place) and all missing ones so far."""
    w, v = by_series().rowsBetween(1 - size, 0), finite()
    return obs.select(KEY, "idx", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("mean"), F.stddev_pop(v).over(w).alias("stdev"), F.sum(v.isNull().cast("long")).over(by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("missing"))


def stream_anomalies(obs: DataFrame, size: int = 50, threshold: float = 3.0, warmup: int | None = None) -> DataFrame:
    """Values far from the ``size`` rows before them: idx, value, z, score. A value that leaves a constant past has an
    infinite z and score 1. Nothing is said of the first ``warmup`` (by default ``size``) rows."""
    if size < 1 or threshold <= 0:
        raise PatternError("size and threshold must be positive")
    w, v = by_series().rowsBetween(-size, -1), finite()
    seen = obs.select(KEY, "idx", v.alias("value"), (F.row_number().over(by_series()) - 1).alias("_at"), F.count(v).over(w).alias("_n"), F.avg(v).over(w).alias("_m"), F.stddev_pop(v).over(w).alias("_s"))
    x, m, many = F.col("value"), F.col("_m"), F.col("_n") >= 2
    z = F.when(F.col("_s") > 0, (x - m) / F.nullif(F.col("_s"), F.lit(0.0))).when(many & (x > m), INF).when(many & (x < m), -INF)
    out = seen.where((F.col("_at") >= (size if warmup is None else warmup)) & F.col("value").isNotNull()).withColumn("z", z)
    return out.where(F.abs("z") >= threshold).select(KEY, "idx", "value", "z", F.when(F.abs("z") == INF, 1.0).otherwise(F.least(F.lit(1.0), F.abs("z") / (2 * threshold))).alias("score"))


def streaming_describe(obs: DataFrame, size: int = 50) -> DataFrame:
    """Per series: n, missing, mean, stdev of all, and recent_mean, recent_stdev of the last ``size`` rows."""
    v = finite()
    last = obs.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("idx"))))
    recent = F.when(F.col("_r") <= size, v)
    return last.groupBy(KEY).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.avg(recent).alias("recent_mean"), F.stddev_pop(recent).alias("recent_stdev"))


def embed(obs: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """Windows of ``size`` finite values that start at every ``stride``-th row: series_id, start, vector."""
    w = by_series()
    vector = F.array(finite(), *[F.lead(finite(), k).over(w) for k in range(1, size)])
    rows = obs.select(KEY, F.col("idx").alias("start"), (F.row_number().over(w) - 1).alias("_at"), vector.alias("vector"))
    return rows.where((F.col("_at") % stride == 0) & ~F.exists("vector", lambda x: x.isNull())).drop("_at")


def change_candidates(obs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Positions whose ``size`` values before and after differ in mean by ``threshold`` standard errors at least."""
    w = by_series("pos")
    before, after, both = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1), w.rowsBetween(-size, size - 1)
    v = compressed(obs)
    out = v.select(KEY, "idx", "pos", F.avg("value").over(before).alias("before_mean"), F.avg("value").over(after).alias("after_mean"), F.stddev_pop("value").over(both).alias("_sd"), F.count("*").over(both).alias("_n"), F.count("*").over(before).alias("_b")).where((F.col("_n") == 2 * size) & (F.col("_b") == size))
    se, d = F.col("_sd") * (2.0 / size) ** 0.5, F.col("after_mean") - F.col("before_mean")
    z = F.when(se > 0, d / F.nullif(se, F.lit(0.0))).when(d > 0, INF).when(d < 0, -INF).otherwise(0.0)
    return out.withColumn("z", z).where(F.abs("z") >= threshold).drop("_sd", "_n", "_b")


def change_points(obs: DataFrame, size: int = 10, threshold: float = 3.0) -> DataFrame:
    """The strongest candidates that keep ``size`` positions from each other: idx, pos, before_mean, after_mean, z.

    Candidates are few; picking them is sequential, so it runs per series in Python.
    """
    if size < 1 or threshold < 0:
        raise PatternError("size must be positive and threshold not negative")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows.pos, -rows.z.abs()))]
        taken: list[int] = []
        keep = []
        for p in rows.pos:
            good = all(abs(p - t) >= size for t in taken)
            keep.append(good)
            if good:
                taken.append(p)
        return rows[keep].sort_values("pos")

    found = change_candidates(obs, size, threshold)
    return found.groupBy(KEY).applyInPandas(pick, found.schema)


def period(obs: DataFrame, max_period: int = 256, least: float = 0.3) -> DataFrame:
    """Per series, its smallest period of 2 or more at a peak of autocorrelation over ``least``: period, strength.

    Missing values keep their places. A row meets max_period + 1 lags at most.
    """
    m = obs.groupBy(KEY).agg(F.avg(number()).alias("_m"), F.count("*").alias("_n"))
    v = obs.join(m, KEY).withColumn("d", number() - F.col("_m")).withColumn("pos", F.row_number().over(by_series()))
    top = F.least(F.expr("cast(_n div 2 as int)"), F.lit(max_period), F.col("_n").cast("int") - 1)
    total = v.groupBy(KEY).agg(F.sum(F.col("d") * F.col("d")).alias("_s"))
    # a frame holds the rows ahead, so products are summed where they arise and only a row a lag is shuffled
    ahead = F.collect_list(F.coalesce("d", F.lit(0.0))).over(by_series().rowsBetween(1, max_period + 1))
    r = v.select(KEY, "d", top.alias("_top"), ahead.alias("_e")).where("_top >= 2").select(KEY, "d", "_top", F.posexplode("_e").alias("lag", "e")).withColumn("lag", F.col("lag") + 1).where("lag <= _top + 1")
    r = r.groupBy(KEY, "lag", "_top").agg(F.sum(F.col("d") * F.col("e")).alias("_c")).join(total, KEY).withColumn("r", safe_ratio(F.col("_c"), F.col("_s")))
    w = by_series("lag")
    peaks = r.select(KEY, "lag", "_top", "r", F.lag("r").over(w).alias("_b"), F.lead("r").over(w).alias("_a")).where((F.col("lag") >= 2) & (F.col("lag") <= F.col("_top")) & (F.col("r") > least) & (F.col("r") > F.col("_b")) & (F.col("_a").isNull() | (F.col("r") >= F.col("_a"))))
    return peaks.groupBy(KEY).agg(F.min("lag").cast("long").alias("period"), F.min_by("r", "lag").alias("strength"))


def decompose(obs: DataFrame, size: int) -> DataFrame:
    """Trend (centred mean over a period; half weight for both ends of an even one), seasonal (mean of what is left, by
    phase) and residual of every row; nulls where the frame leaves the series."""
    if size < 2:
        raise PatternError("a period is 2 at least")
    h = size // 2
    w = by_series()
    f, v = w.rowsBetween(-h, h), number()
    total, n = F.coalesce(F.sum(v).over(f), F.lit(0.0)), F.count(v).over(f).cast("double")
    if size % 2 == 0:
        for end in (F.lag(v, h).over(w), F.lead(v, h).over(w)):
            total, n = total - F.coalesce(end, F.lit(0.0)) / 2, n - F.when(end.isNotNull(), 0.5).otherwise(0.0)
    full = F.count("*").over(f) == 2 * h + 1
    t = obs.select(KEY, "idx", v.alias("value"), F.when(full, total / F.nullif(n, F.lit(0.0))).alias("trend"), ((F.row_number().over(w) - 1) % size).cast("long").alias("phase"))
    season = t.groupBy(KEY, "phase").agg(F.coalesce(F.avg(F.col("value") - F.col("trend")), F.lit(0.0)).alias("seasonal"))
    return t.join(season, [KEY, "phase"]).select(KEY, "idx", "value", "phase", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonal_strength(parts: DataFrame) -> DataFrame:
    """From decompose(): trend_strength and seasonal_strength, shares of variance that are not left over."""
    ok = F.col("residual").isNotNull()
    res = F.var_pop(F.when(ok, F.col("residual")))
    detrended, unseasoned = F.var_pop(F.when(ok, F.col("value") - F.col("trend"))), F.var_pop(F.when(ok, F.col("value") - F.col("seasonal")))
    return parts.groupBy(KEY).agg(clamp(F.when(detrended > 0, 1 - res / F.nullif(detrended, F.lit(0.0)))).alias("seasonal_strength"), clamp(F.when(unseasoned > 0, 1 - res / F.nullif(unseasoned, F.lit(0.0)))).alias("trend_strength"))
