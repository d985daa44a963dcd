"""Aggregates of series: description, quality, histogram, correlation, trend, autocorrelation, spectrum."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.functions.columns import correlation, safe_ratio, z_score
from patternfold.schema import KEY, by_series, clamp, compressed, number


def describe(obs: DataFrame) -> DataFrame:
    """Per series: n, missing, mean, median, variance and stdev (population), min, max, p25, p50, p75, iqr, cv."""
    v = number()
    out = obs.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stdev"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"),
    )
    p = lambda i: F.col("_p")[i]
    cv = F.when(F.col("mean") != 0, F.col("stdev") / F.nullif(F.abs("mean"), F.lit(0.0))).when(F.col("stdev") == 0, 0.0)
    return out.select(KEY, "n", "missing", "mean", p(1).alias("median"), "variance", "stdev", "min", "max", p(0).alias("p25"), p(1).alias("p50"), p(2).alias("p75"), (p(2) - p(0)).alias("iqr"), cv.alias("cv"))


def percentile(obs: DataFrame, share: float) -> DataFrame:
    """Per series, the value at a share of the order, interpolated linearly."""
    return obs.groupBy(KEY).agg(F.percentile(number(), F.lit(share)).alias("percentile"))


def z_scores(obs: DataFrame) -> DataFrame:
    """Observations with z: 0 where the series is constant, null where the value is missing."""
    m = obs.groupBy(KEY).agg(F.avg(number()).alias("_m"), F.stddev_pop(number()).alias("_s"))
    return obs.join(m, KEY).withColumn("z", z_score(number(), F.col("_m"), F.col("_s"))).drop("_m", "_s")


def validate(obs: DataFrame, max_missing_fraction: float = 0.3) -> DataFrame:
    """Per series: ok, n, missing, warnings. Not ok: more missing than allowed. Constant series are warned of."""
    if not 0 <= max_missing_fraction <= 1:
        raise PatternError("max_missing_fraction must be within 0 and 1")
    present = F.coalesce(number().cast("string"), F.col("value_str"))
    g = obs.groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(present.isNull()).alias("missing"), F.min(present).alias("_a"), F.max(present).alias("_b"))
    much = F.col("missing") / F.col("n") > max_missing_fraction
    same = (F.col("n") - F.col("missing") >= 2) & (F.col("_a") == F.col("_b"))
    return g.select(KEY, (~much).alias("ok"), "n", "missing", F.array_compact(F.array(F.when(much, F.lit("too many missing values")), F.when(same, F.lit("constant data")))).alias("warnings"))


def outlier_fraction(obs: DataFrame) -> DataFrame:
    """Per series, the share of numbers over 3 population deviations from their mean."""
    z = z_scores(obs)
    return z.groupBy(KEY).agg(F.coalesce(F.count_if(F.abs("z") > 3) / F.nullif(F.count(number()), F.lit(0)), F.lit(0.0)).alias("outlier_fraction"))


def quality(obs: DataFrame) -> DataFrame:
    """Per series: n, missing_fraction, numeric_fraction, constant, outlier_fraction, quality and the reason for it."""
    text = F.when(F.trim("value_str") != "", F.col("value_str"))
    present = F.coalesce(number().cast("string"), text)
    g = obs.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_if(present.isNull()).alias("missing"), F.count(number()).alias("_numeric"), F.min(present).alias("_a"), F.max(present).alias("_b")
    ).join(outlier_fraction(obs), KEY)
    there = F.col("n") - F.col("missing")
    g = g.select(KEY, "n", "missing", (F.col("missing") / F.col("n")).alias("missing_fraction"), safe_ratio(F.col("_numeric").cast("double"), there.cast("double")).alias("numeric_fraction"), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("constant"), "outlier_fraction")
    c = F.col
    score = clamp(1 - c("missing_fraction") - F.when(c("constant"), 0.3).otherwise(0.0) - F.least(F.lit(0.3), c("outlier_fraction")))
    reason = (
        F.when(c("missing") == c("n"), "all values missing").when(c("constant"), "constant data").when(c("missing_fraction") > 0.5, "high missing fraction").when(c("numeric_fraction") == 0, "no numeric values")
        .when(c("numeric_fraction") < 0.5, "low numeric fraction").when(c("outlier_fraction") > 0.1, "high outlier fraction").when(c("missing_fraction") > 0, "minor missing data")
        .when(c("outlier_fraction") > 0, "minor outliers").otherwise("ok")
    )
    return g.withColumn("quality", score).withColumn("reason", reason)


def histogram(obs: DataFrame, bins: int = 10) -> DataFrame:
    """Per series and bin: count, support (share of the numbers), low and high edge, mode (the fullest bin, the first of equals)."""
    v = compressed(obs)
    e = v.groupBy(KEY).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("long")
    g = v.join(e, KEY).select(KEY, bin_.alias("bin"), "_lo", width.alias("_w"), "_n", "_hi").groupBy(KEY, "bin").agg(F.count("*").alias("count"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.first("_n").alias("_n"))
    rank = F.row_number().over(by_series().orderBy(F.desc("count"), "bin"))
    return g.select(KEY, "bin", "count", (F.col("count") / F.col("_n")).alias("support"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), (rank == 1).alias("mode"))


def _paired(a: str, b: str) -> tuple[Column, Column]:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))


def covariance_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, covariance (population, over rows that have both), pairs: all k x k in one aggregate."""
    ready = rows.select(*[number(F.col(c).cast("double")).alias(c) for c in columns])
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.covar_pop(*_paired(a, b)), F.lit(0.0)).alias("covariance"), F.count(_paired(a, b)[0]).alias("pairs")) for a, b in product(columns, columns)]
    return ready.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, correlation (0 where a side is constant, also on the diagonal), pairs."""
    ready = rows.select(*[number(F.col(c).cast("double")).alias(c) for c in columns])
    aggs = []
    for a, b in product(columns, columns):
        x, y = _paired(a, b)
        r = F.when(F.var_pop(x) > 0, 1.0).otherwise(0.0) if a == b else correlation(F.covar_pop(x, y), F.var_pop(x), F.var_pop(y))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("correlation"), F.count(x).alias("pairs")))
    return ready.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def strong_correlations(rows: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Pairs a < b in column order with |correlation| of the threshold at least: a, b, correlation, pairs."""
    keep = [f"{a}\0{b}" for a, b in combinations(columns, 2)]
    return correlation_matrix(rows, columns).where(F.concat("a", F.lit("\0"), "b").isin(keep) & (F.abs("correlation") >= threshold))


def cross_correlation(obs: DataFrame, a: str, b: str, max_lag: int) -> DataFrame:
    """Per series and lag k: correlation of a at i with b at i + k, over rows that have both."""
    w = by_series()
    shifted = [(F.lead(b, k) if k >= 0 else F.lag(b, -k)).over(w).alias(f"_{k + max_lag}") for k in range(-max_lag, max_lag + 1)]
    wide = obs.select(KEY, a, *shifted)
    long = wide.select(KEY, F.col(a).cast("double").alias("x"), F.posexplode(F.array(*[F.col(f"_{i}").cast("double") for i in range(2 * max_lag + 1)])).alias("k", "y")).where("x is not null and y is not null")
    return long.groupBy(KEY, (F.col("k") - max_lag).cast("long").alias("lag")).agg(correlation(F.covar_pop("x", "y"), F.var_pop("x"), F.var_pop("y")).alias("correlation"), F.count("*").alias("pairs"))


def trend(obs: DataFrame) -> DataFrame:
    """Per series, least squares of the numbers over their positions: slope, intercept, r2 (0 if constant), direction."""
    v = compressed(obs).withColumn("pos", F.col("pos").cast("double"))
    g = v.groupBy(KEY).agg(F.count("*").alias("n"), F.coalesce(F.covar_pop("pos", "value") / F.nullif(F.var_pop("pos"), F.lit(0.0)), F.lit(0.0)).alias("slope"), F.avg("value").alias("_y"), F.avg("pos").alias("_x"), F.covar_pop("pos", "value").alias("_c"), F.var_pop("pos").alias("_vx"), F.var_pop("value").alias("_vy"))
    r2 = clamp(safe_ratio(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy")))
    way = F.when(F.abs("slope") <= 1e-9, "flat").when(F.col("slope") > 0, "up").otherwise("down")
    return g.select(KEY, "n", "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"), r2.alias("r2"), way.alias("direction"))


def _centred(v: DataFrame) -> DataFrame:
    m = v.groupBy(KEY).agg(F.avg("value").alias("_m"))
    return v.join(m, KEY).withColumn("d", F.col("value") - F.col("_m"))


def autocorrelation(obs: DataFrame, max_lag: int) -> DataFrame:
    """Per series and lag 1..max_lag (under the number of values): autocorrelation around the mean, missing values left out."""
    v = _centred(compressed(obs))
    w = by_series("pos")
    wide = v.select(KEY, "d", F.array(*[F.lead("d", k).over(w) for k in range(1, max_lag + 1)]).alias("next"))
    total = v.groupBy(KEY).agg(F.sum(F.col("d") * F.col("d")).alias("_s"), F.count("*").alias("_n"))
    long = wide.select(KEY, "d", F.posexplode("next").alias("k", "e")).groupBy(KEY, (F.col("k") + 1).cast("long").alias("lag")).agg(F.coalesce(F.sum(F.col("d") * F.col("e")), F.lit(0.0)).alias("_c"))
    return long.join(total, KEY).where("lag < _n").select(KEY, "lag", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(F.col("_c"), F.col("_s")))).alias("autocorrelation"))


def spectrum(obs: DataFrame, top_k: int = 3, most: int = 256) -> DataFrame:
    """Per series, its strongest periods by discrete Fourier transform of at most ``most`` evenly drawn values (that limit is
    the feature's resolution): period, magnitude, strength (share of the strongest), rank."""
    v = compressed(obs)
    n = v.groupBy(KEY).agg(F.count("*").alias("_n")).withColumn("_stride", F.ceil(F.col("_n") / most))
    v = v.join(n, KEY).where("pos % _stride = 0").withColumn("j", F.col("pos") / F.col("_stride"))
    m = v.groupBy(KEY).agg(F.avg("value").alias("_m"), F.count("*").alias("_k"))
    v = v.join(m, KEY).where("_k >= 2").select(KEY, "j", "_stride", "_k", (F.col("value") - F.col("_m")).alias("d"), F.explode(F.expr("sequence(1, cast(_k div 2 as int))")).alias("k"))
    angle = 2 * 3.141592653589793 * F.col("k") * F.col("j") / F.col("_k")
    g = v.groupBy(KEY, "k").agg(F.sum(F.col("d") * F.cos(angle)).alias("_re"), F.sum(F.col("d") * F.sin(angle)).alias("_im"), F.first("_k").alias("_k"), F.first("_stride").alias("_stride"))
    g = g.select(KEY, (F.col("_k") / F.col("k") * F.col("_stride")).alias("period"), F.round(F.hypot("_re", "_im") / F.col("_k"), 6).alias("magnitude"))
    rank = F.row_number().over(by_series().orderBy(F.desc("magnitude"), "period"))
    peak = F.max("magnitude").over(by_series().orderBy(F.desc("magnitude"), "period"))
    return g.select(KEY, "period", "magnitude", F.round(safe_ratio(F.col("magnitude"), peak), 6).alias("strength"), rank.cast("long").alias("rank")).where(F.col("rank") <= top_k)


def mean_vector(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """dim, mean of the valid entries of each dimension (0 if none)."""
    long = vectors.select(F.posexplode(column).alias("dim", "x"))
    return long.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.coalesce(F.avg(number("x")), F.lit(0.0)).alias("mean"))


def covariance_of_vectors(vectors: DataFrame, dims: int, column: str = "vector", ridge: float = 1e-6) -> DataFrame:
    """i, j, covariance (sample, over complete vectors, ridge on the diagonal; a single vector gives zeros plus ridge)."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where((F.size(column) == dims) & ~bad).select(*[F.col(column)[i].cast("double").alias(f"d{i}") for i in range(dims)])
    aggs = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), (F.when(F.count("*") > 1, F.covar_pop(f"d{i}", f"d{j}") * F.count("*") / F.nullif(F.count("*") - 1, F.lit(0))).otherwise(0.0) + (ridge if i == j else 0.0)).alias("covariance")) for i in range(dims) for j in range(dims)]
    return ok.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """n_runs, n_ok, n_failed, total_patterns, avg_patterns, avg_confidence of rows run, error, type, confidence (a row for
    each pattern; a run without patterns has one with a null type)."""
    runs = outcomes.groupBy("run").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    good = outcomes.where("error is null and type is not null").agg(F.count("*").alias("total_patterns"), F.avg("confidence").alias("avg_confidence"))
    n = runs.agg(F.count("*").alias("n_runs"), F.count_if(~F.col("failed")).alias("n_ok"), F.count_if("failed").alias("n_failed"))
    return n.crossJoin(F.broadcast(good)).select("n_runs", "n_ok", "n_failed", "total_patterns", safe_ratio(F.col("total_patterns").cast("double"), F.col("n_ok").cast("double")).alias("avg_patterns"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def batch_types(outcomes: DataFrame) -> DataFrame:
    """type, count over all successful runs."""
    return outcomes.where("error is null and type is not null").groupBy("type").agg(F.count("*").alias("count"))
