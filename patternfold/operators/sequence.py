"""Operators on labels in order: n-grams, runs, transitions, recurring values and sequences, pattern adjacency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.schema import KEY, by_series, compressed


def ngrams(obs: DataFrame, n: int) -> DataFrame:
    """Every run of n labels with its start idx; a missing label is a token like others."""
    if n < 1:
        raise PatternError("n must be 1 at least")
    w = by_series()
    gram = F.array("label", *[F.lead("label", k).over(w) for k in range(1, n)])
    ahead = F.lead("idx", n - 1).over(w) if n > 1 else F.col("idx")
    return obs.select(KEY, "idx", gram.alias("gram"), ahead.alias("_end")).where("_end is not null").drop("_end")


def _numbered_runs(obs: DataFrame) -> DataFrame:
    new = (~F.col("label").eqNullSafe(F.lag("label").over(by_series()))) | (F.row_number().over(by_series()) == 1)
    return obs.select(KEY, "idx", "label", F.sum(new.cast("long")).over(by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


def runs(obs: DataFrame) -> DataFrame:
    """Maximal runs of equal labels (missing ones too): run, label, start, end, length."""
    return _numbered_runs(obs).groupBy(KEY, "run").agg(F.first("label").alias("label"), F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("length"))


def run_length_encode(obs: DataFrame) -> DataFrame:
    return runs(obs).select(KEY, "run", "label", "length")


def label_changes(obs: DataFrame) -> DataFrame:
    """Rows whose label differs from the one before."""
    w = by_series()
    marked = obs.select(KEY, "idx", "label", F.lag("label").over(w).alias("before"), F.row_number().over(w).alias("_n"))
    return marked.where((F.col("_n") > 1) & ~F.col("label").eqNullSafe(F.col("before"))).drop("_n")


def transitions(obs: DataFrame) -> DataFrame:
    """a, b, count, probability (of b after a) of adjacent labels; missing labels are states too."""
    pairs = ngrams(obs, 2).select(KEY, F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b")).groupBy(KEY, "a", "b").count()
    return pairs.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy(KEY, "a")))


def states(obs: DataFrame) -> DataFrame:
    return obs.select(KEY, "label").distinct()


def predict_next(matrix: DataFrame, current: DataFrame, top_k: int = 3) -> DataFrame:
    """For current (series_id, label): likeliest next labels with rank. ``matrix`` comes from transitions()."""
    met = matrix.join(current.select(KEY, F.col("label").alias("a")), [KEY, "a"])
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("probability"), "b"))
    return met.select(KEY, F.col("a").alias("current"), F.col("b").alias("next"), "count", "probability", rank.cast("long").alias("rank")).where(F.col("rank") <= max(1, top_k))


def last_labels(obs: DataFrame) -> DataFrame:
    return obs.where("label is not null").groupBy(KEY).agg(F.max_by("label", "idx").alias("label"))


def recurring_values(obs: DataFrame, min_support: int = 3, value: str = "label") -> DataFrame:
    """Values that stand min_support times at least: value, count, support (share of present values), occurrences."""
    v = obs.where(F.col(value).isNotNull()).select(KEY, "idx", F.col(value).cast("string").alias("value"))
    n = v.groupBy(KEY).agg(F.count("*").alias("_n"))
    g = v.groupBy(KEY, "value").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("idx")).alias("occurrences")).where(F.col("count") >= min_support)
    return g.join(n, KEY).select(KEY, "value", "count", (F.col("count") / F.col("_n")).alias("support"), "occurrences")


def frequent_sequences(obs: DataFrame, min_support: int = 3, max_n: int = 3) -> DataFrame:
    """Runs of 2..max_n present labels that stand min_support times at least: n, gram, count, support (share of the
    places for such a run, those with missing labels too), occurrences."""
    grams = reduce(DataFrame.unionByName, [ngrams(obs, n).withColumn("n", F.lit(n).cast("long")) for n in range(2, max_n + 1)])
    slots = obs.groupBy(KEY).agg(F.count("*").alias("_rows"))
    g = grams.where(~F.exists("gram", lambda x: x.isNull())).groupBy(KEY, "n", "gram").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("idx")).alias("occurrences")).where(F.col("count") >= min_support)
    return g.join(slots, KEY).select(KEY, "n", "gram", "count", (F.col("count") / (F.col("_rows") - F.col("n") + 1)).alias("support"), "occurrences")


def find_starts(obs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Where each pattern (id, sequence) stands in each series: series_id, id, start, end. Overlaps count.

    Patterns that name a series are sought in that one only, and met by series and gram."""
    own = KEY in patterns.columns
    sizes = sorted(r[0] for r in patterns.select(F.size("sequence")).where("size(sequence) > 0").distinct().collect())  # distinct lengths only
    empty = obs.select(KEY, F.lit("").alias("id"), F.col("idx").alias("start"), F.col("idx").alias("end")).limit(0)
    known = patterns.select(*([KEY] if own else []), "id", F.col("sequence").alias("gram"))
    found = [ngrams(obs, n).join(known, [KEY, "gram"] if own else "gram").select(KEY, "id", F.col("idx").alias("start"), (F.col("idx") + n - 1).alias("end")) for n in sizes]
    return reduce(DataFrame.unionByName, found, empty)


def pattern_sequence(starts: DataFrame) -> DataFrame:
    """Found patterns (series_id, id, start) as observations: label is the pattern, in order of start and id."""
    at = F.row_number().over(Window.partitionBy(KEY).orderBy("start", "id")) - 1
    return starts.select(KEY, at.cast("long").alias("idx"), F.col("id").alias("label"))


def relationships(obs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern b right after pattern a: a, b, count, followed_by (share of what follows a), preceded_by (share of what
    stands before b), evidence (count of both orders)."""
    at = find_starts(obs, patterns)
    left = at.select(KEY, F.col("id").alias("a"), (F.col("end") + 1).alias("at"))
    pairs = left.join(at.select(KEY, F.col("id").alias("b"), F.col("start").alias("at")), [KEY, "at"]).groupBy(KEY, "a", "b").count()
    back = pairs.select(KEY, F.col("a").alias("b"), F.col("b").alias("a"), F.col("count").alias("_back"))
    share = lambda by: F.col("count") / F.sum("count").over(Window.partitionBy(KEY, by))
    shared = pairs.withColumn("followed_by", share("a")).withColumn("preceded_by", share("b"))
    return shared.join(back, [KEY, "a", "b"], "left").select(KEY, "a", "b", "count", "followed_by", "preceded_by", (F.col("count") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("_back", F.lit(0)))).alias("evidence"))


def strongest_relationships(related: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` likeliest followers of each pattern, with rank."""
    rank = F.row_number().over(Window.partitionBy(KEY, "a").orderBy(F.desc("followed_by"), "b"))
    return related.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def triples(obs: DataFrame) -> DataFrame:
    """Labels in threes that don't overlap, as transactions: series_id, txn, item; the rest is left out."""
    v = compressed(obs, keep=F.col("label").isNotNull()).select(KEY, F.floor(F.col("pos") / 3).alias("txn"), F.col("label").alias("item"))
    return v.withColumn("_n", F.count("*").over(Window.partitionBy(KEY, "txn"))).where("_n = 3").drop("_n")
