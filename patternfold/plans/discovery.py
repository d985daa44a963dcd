"""Discovery: every miner's finds as rows of one pattern table, and the evidence beside them.

Miners are lazy; a series too short for one gives no row. Identity is a pattern's type and sequence within its series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternfold.config import Config
from patternfold.operators import arithmetic, clustering, memory, sequence, stats, structural, windows
from patternfold.schema import KEY, PATTERN, clamp

#: Stages in the order in which ids are given.
ORDER = {"recurring_value": 0, "frequent_sequence": 1, "regime": 2, "correlation": 3, "seasonal": 4, "arithmetic": 5, "association": 6}


def _features(**parts: Column) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*[c.cast("double") for c in parts.values()])), lambda k, v: v.isNotNull())


def _pattern(df: DataFrame, type_: str, features: Column, seq: Column, frequency: Column, occurrences: Column, confidence: Column, order: Column) -> DataFrame:
    none = F.lit(None)
    return df.select(
        none.cast("string").alias("id"), F.col(KEY), F.lit(type_).alias("type"), features.alias("features"), seq.cast("array<string>").alias("sequence"), none.cast("map<string,map<string,double>>").alias("relationships"),
        frequency.cast("long").alias("frequency"), F.array_min(occurrences).alias("first_seen"), F.array_max(occurrences).alias("last_seen"), occurrences.alias("occurrences"), clamp(confidence).alias("confidence"),
        F.lit(1.0).alias("similarity"), F.lit(0.0).alias("novelty"), F.create_map().cast("map<string,string>").alias("context"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit("NEW").alias("state"), order.alias("_order"),
    )


def mine(obs: DataFrame, config: Config, columns: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """All miners' patterns without ids, with the number of their stage and their order in it."""
    none = F.array().cast("array<long>")
    count, occ = F.col("count"), F.col("occurrences")
    sure = F.least(F.lit(1.0), 0.4 + 0.1 * count)
    value = F.coalesce("label", F.col("value").cast("string"))
    parts = [_pattern(sequence.recurring_values(obs.withColumn("label", value), config.min_support), "recurring_value", _features(count=count, support=F.col("support")), F.array("value"), count, occ, sure, F.struct(-count, F.col("value")))]
    parts.append(_pattern(sequence.frequent_sequences(obs, config.min_support, config.max_n), "frequent_sequence", _features(count=count, support=F.col("support"), n=F.col("n")), F.col("gram"), count, occ, sure, F.struct(-count, F.concat_ws("\0", "n", "gram"))))
    sized = obs.join(obs.where("value is not null").groupBy(KEY).agg(F.count("*").alias("_n")), KEY)
    enough = lambda n: sized.where((F.col("_n") >= n) & F.col("value").isNotNull()).drop("_n")
    if config.regimes:
        r = clustering.regimes(enough(16), max(2, config.regime_size), max(2, config.n_clusters))
        parts.append(_pattern(r, "regime", _features(count=count, support=F.col("support")), F.transform("centroid", lambda x: F.round(x, 4)), count, occ, F.col("support"), F.struct(-count, F.col("cluster").cast("string"))))
    if config.correlation and columns is not None and names and len(names) > 1:
        c = stats.strong_correlations(columns, names, config.corr_threshold).withColumn(KEY, F.lit("all"))
        parts.append(_pattern(c, "correlation", _features(correlation=F.col("correlation"), pairs=F.col("pairs")), F.array("a", "b"), F.col("pairs"), none, F.abs("correlation"), F.struct((-F.abs("correlation") * 1e9).cast("long"), F.concat_ws("\0", "a", "b"))))
    if config.seasonality:
        p = windows.period(enough(12), config.max_period)
        parts.append(_pattern(p, "seasonal", _features(period=F.col("period"), strength=F.col("strength")), F.array(F.col("period").cast("string")), F.lit(1), none, F.col("strength"), F.struct(-F.col("period"), F.lit(""))))
    a = arithmetic.solve(enough(3)).where("kind != 'unknown'")
    parts.append(_pattern(a, "arithmetic", _features(parameter=F.col("parameter"), next=F.col("next")[0]), F.array("kind"), F.col("n"), none, F.col("confidence"), F.struct(-F.col("n"), F.col("kind"))))
    rules = structural.association_rules(sequence.triples(obs), config.min_support, 0.5)
    parts.append(_pattern(rules, "association", _features(support=F.col("support"), confidence=F.col("confidence")), F.array("antecedent", "consequent"), count, none, F.col("confidence"), F.struct((-F.col("confidence") * 1e9).cast("long"), F.concat_ws("\0", "antecedent", "consequent"))))
    flat = [p.withColumn("_o1", F.col("_order")[p.schema["_order"].dataType.names[0]].cast("long")).withColumn("_o2", F.col("_order")[p.schema["_order"].dataType.names[1]].cast("string")).drop("_order") for p in parts]
    return reduce(DataFrame.unionByName, flat)


def numbered(mined: DataFrame, first: int = 1) -> DataFrame:
    """Mined patterns with ids P-001 ... within their series, by stage and order."""
    stage = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in ORDER.items()])
    at = F.row_number().over(Window.partitionBy(KEY).orderBy(stage, "_o1", "_o2")) + (first - 1)
    return mined.withColumn("id", memory.pattern_id(at)).drop("_o1", "_o2")


def stored(patterns: DataFrame, known: DataFrame | None, config: Config, mode: str = "bulk") -> DataFrame:
    """Patterns merged with those known, advanced by one observation, their confidence blended with their score."""
    if known is not None:
        patterns = known.unionByName(patterns)
    merged = memory.merge(patterns)
    moved = merged.withColumn("state", memory.advance(F.col("state"), F.col("frequency"), F.col("confidence"), F.col("novelty"), F.lit(0), F.lit(True)))
    return memory.blend(moved, mode, config.weights or None).select(*[f.split(" ")[0] for f in _fields()])


def _fields() -> list[str]:
    out, depth, word = [], 0, ""
    for c in PATTERN:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def related(patterns: DataFrame, obs: DataFrame) -> DataFrame:
    """Patterns with relationships: which sequence pattern of their series follows them in its labels, and how often (the likeliest three)."""
    links = sequence.strongest_relationships(sequence.relationships(obs, patterns.where("type = 'frequent_sequence'").select(KEY, "id", "sequence")))
    found = links.groupBy(KEY, F.col("a").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "followed_by")))).alias("_f"))
    out = patterns.join(found, [KEY, "id"], "left")
    return out.withColumn("relationships", F.when(F.col("_f").isNotNull(), F.create_map(F.lit("followed_by"), F.col("_f")))).select(*patterns.columns)


def structure(obs: DataFrame) -> DataFrame:
    """Per series: nodes, edges of its label graph."""
    edges = structural.cooccurrence(obs, 2).groupBy(KEY).agg(F.count("*").alias("edges"))
    nodes = obs.groupBy(KEY).agg(F.countDistinct("label").alias("nodes"))
    return nodes.join(edges, KEY, "left").select(KEY, "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
