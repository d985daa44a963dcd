"""The pattern store as tables: identity, merge, scores, lifecycle, drift, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternfold.schema import KEY, clamp

#: The six parts of a score and their default weights, and the thresholds of the lifecycle.
WEIGHTS = {"frequency": 0.25, "similarity": 0.15, "stability": 0.20, "novelty": 0.10, "predictive": 0.15, "recency": 0.15}
PENALTIES = {"noise": 0.5, "uncertainty": 0.5}
STATES = ("NEW", "OBSERVED", "CONFIRMED", "ESTABLISHED", "EVOLVING", "STALE", "RETIRED")
LIFECYCLE = {"confirm_threshold": 3, "establish_freq": 10, "establish_confidence": 0.8, "stale_after": 100, "retired_after": 200, "drift_threshold": 0.5}


def pattern_id(n: Column) -> Column:
    return F.concat(F.lit("P-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def id_number(id_: Column) -> Column:
    return F.regexp_extract(id_, r"(\d+)$", 1).try_cast("long")


def signature(type_: Column, sequence: Column, series: Column | None = None) -> Column:
    """Twelve hex digits of a pattern's identity: its type and sequence (counts may change, so they don't count)."""
    parts = [type_.alias("type"), sequence.alias("sequence")] + ([series.alias(KEY)] if series is not None else [])
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 12)


def merge(patterns: DataFrame) -> DataFrame:
    """Patterns of one identity become one: frequencies add up, occurrences join, the surest confidence and the first id stay."""
    sig = signature(F.col("type"), F.col("sequence"), F.col(KEY))
    first = lambda c: F.min_by(c, F.struct(id_number(F.col("id")), F.col("id")))
    g = patterns.withColumn("_sig", sig).groupBy("_sig").agg(
        first("id").alias("id"), first(KEY).alias(KEY), first("type").alias("type"), first("features").alias("_features"), first("sequence").alias("sequence"), first("relationships").alias("relationships"),
        F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sort_array(F.flatten(F.collect_list("occurrences"))).alias("occurrences"),
        F.max("confidence").alias("confidence"), first("similarity").alias("similarity"), first("novelty").alias("novelty"), first("context").alias("context"), first("metadata").alias("metadata"), first("state").alias("state"),
    )
    count = F.map_from_arrays(F.array(F.lit("count")), F.array(F.size("occurrences").cast("double")))
    features = F.when(F.map_contains_key("_features", "count"), F.map_concat(F.map_filter("_features", lambda k, v: k != "count"), count)).otherwise(F.col("_features"))
    return g.withColumn("features", features).select(*patterns.columns)


def score(frequency: Column, total: Column, similarity: Column | float = 1.0, stability: Column | float = 1.0, predictive: Column | float = 0.0, recency: Column | float = 0.5, noise: Column | float = 0.0, uncertainty: Column | float = 0.0, weights: dict | None = None) -> dict[str, Column]:
    """The parts of a pattern's score and its confidence; parts are within 0 and 1, weights of the positive ones add up to 1."""
    col = lambda x: clamp(x if isinstance(x, Column) else F.lit(float(x)))
    w = WEIGHTS | PENALTIES | {k: float(v) for k, v in (weights or {}).items() if v is not None}
    positive = {k: max(0.0, w[k]) for k in WEIGHTS}
    whole = sum(positive.values())
    positive = {k: v / whole if whole > 0 else 1 / len(WEIGHTS) for k, v in positive.items()}
    share = F.when(total > 0, clamp(F.greatest(F.coalesce(frequency, F.lit(0)), F.lit(0)) / F.nullif(total, F.lit(0)))).otherwise(0.0)
    parts = {"frequency": share, "similarity": col(similarity), "stability": col(stability), "novelty": clamp(1 - share), "predictive": col(predictive), "recency": col(recency)}
    mean = sum((positive[k] * c for k, c in parts.items()), F.lit(0.0))
    parts["confidence"] = clamp(mean - max(0.0, w["noise"]) * col(noise) - max(0.0, w["uncertainty"]) * col(uncertainty))
    return parts


def blend(patterns: DataFrame, mode: str = "bulk", weights: dict | None = None) -> DataFrame:
    """Patterns with confidence halfway between their own and their score's.

    Their own doubt (1 - confidence) is the score's uncertainty. ``bulk`` weighs every pattern against all of its series,
    ``sequential`` against those stored before it, by id, and itself.
    """
    every = Window.partitionBy(KEY)
    order = every.orderBy(id_number(F.col("id")), "id").rowsBetween(Window.unboundedPreceding, 0)
    w = every if mode == "bulk" else order
    total, latest = F.sum("frequency").over(w), F.max("last_seen").over(w)
    recency = F.when(F.col("last_seen") == latest, 1.0).otherwise(0.5)
    parts = score(F.col("frequency"), F.col("_total"), recency=F.col("_recency"), uncertainty=1 - F.col("confidence"), weights=weights)
    ready = patterns.withColumn("_total", total).withColumn("_recency", recency)
    return ready.withColumn("confidence", 0.5 * F.col("confidence") + 0.5 * parts["confidence"]).drop("_total", "_recency")


def advance(state: Column, frequency: Column, confidence: Column, drift: Column, idle: Column, observed: Column, thresholds: dict | None = None) -> Column:
    """The next state of the lifecycle; ``idle`` counts steps without observation before this one."""
    t = LIFECYCLE | (thresholds or {})
    state = F.when(F.upper(state).isin(*STATES), F.upper(state)).otherwise("NEW")
    known, moved = state.isin("CONFIRMED", "ESTABLISHED"), drift >= t["drift_threshold"]
    waiting = idle + 1
    seen = (
        F.when(state.isin("RETIRED", "STALE", "NEW"), "OBSERVED").when(known & moved, "EVOLVING").when(state == "EVOLVING", F.when(moved, "EVOLVING").otherwise("CONFIRMED"))
        .when(state == "OBSERVED", F.when(frequency >= t["confirm_threshold"], "CONFIRMED").otherwise("OBSERVED"))
        .when(state == "CONFIRMED", F.when((frequency >= t["establish_freq"]) | (confidence >= t["establish_confidence"]), "ESTABLISHED").otherwise("CONFIRMED")).otherwise("ESTABLISHED")
    )
    unseen = (
        F.when(state == "RETIRED", "RETIRED").when((state == "STALE") & (waiting >= t["retired_after"]), "RETIRED")
        .when((state != "STALE") & (waiting >= t["stale_after"]), F.when(known & moved, "EVOLVING").otherwise("STALE")).when(known & moved, "EVOLVING").otherwise(state)
    )
    return F.when(observed, seen).otherwise(unseen)


def adjust_confidence(confidence: Column, matched: Column) -> Column:
    """A match adds 0.05, a miss takes 0.10."""
    return F.when(matched, F.least(F.lit(1.0), confidence + 0.05)).otherwise(F.greatest(F.lit(0.0), confidence - 0.10))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, drift, keys of two long tables id, key, value: the mean of min(1, |change| / |old|) over keys both have."""
    met = old.select("id", "key", F.col("value").alias("_o")).join(new.select("id", "key", F.col("value").alias("_n")), ["id", "key"])
    step = F.least(F.lit(1.0), F.abs(F.col("_n") - F.col("_o")) / (F.abs("_o") + 1e-9))
    return met.groupBy("id").agg(F.avg(step).alias("drift"), F.count("*").alias("keys"))


def snapshot(patterns: DataFrame) -> DataFrame:
    """A pattern's numbers as rows: id, key, value."""
    own = F.map_from_arrays(F.array(F.lit("confidence"), F.lit("frequency")), F.array("confidence", F.col("frequency").cast("double")))
    named = F.transform_keys("features", lambda k, v: F.concat(F.lit("features."), k))
    return patterns.select("id", F.explode(F.map_concat(own, named)).alias("key", "value"))


def drift_trend(scores: DataFrame) -> DataFrame:
    """Per id, the trend of its drift scores (id, step, drift): unknown, stable, drifting, converging or oscillating."""
    w = Window.partitionBy("id").orderBy("step")
    s = scores.select("id", "step", "drift", F.lag("drift").over(w).alias("_b"))
    g = s.groupBy("id").agg(F.count("drift").alias("n"), F.max("drift").alias("_max"), F.max_by("drift", "step").alias("_last"), F.coalesce(F.bool_and(F.col("drift") >= F.col("_b")), F.lit(True)).alias("_up"), F.coalesce(F.bool_and(F.col("drift") <= F.col("_b")), F.lit(True)).alias("_down"))
    trend = F.when(F.col("n") < 1, "unknown").when(F.col("_max") < 0.1, "stable").when(F.col("_up") & (F.col("_last") >= 0.3), "drifting").when(F.col("_down"), "converging").otherwise("oscillating")
    return g.select("id", "n", trend.alias("trend"))


def prune(patterns: DataFrame, most: int) -> DataFrame:
    """At most ``most`` patterns of each series: retired ones go first, those longest unseen (or never) before others."""
    gone = (F.col("state") == "RETIRED").cast("int")
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(gone), F.asc_nulls_first("last_seen"), id_number(F.col("id")), "id"))
    size = F.count("*").over(Window.partitionBy(KEY))
    marked = patterns.withColumn("_r", rank).withColumn("_over", size - most).withColumn("_gone", gone)
    return marked.where((F.col("_r") > F.col("_over")) | (F.col("_gone") == 0)).drop("_r", "_over", "_gone")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identities of two pattern tables: signature, status (added, removed, common), id (of b, if it has one)."""
    sig = lambda d: d.select(signature(F.col("type"), F.col("sequence")).alias("signature"), "id").groupBy("signature").agg(F.min("id").alias("id"))
    x, y = sig(a).withColumnRenamed("id", "_a"), sig(b).withColumnRenamed("id", "_b")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("common")
    return x.join(y, "signature", "full").select("signature", status.alias("status"), F.coalesce("_b", "_a").alias("id"))
