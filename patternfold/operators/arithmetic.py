"""Closed-form rules of numeric series: constant differences, sums of the two before, constant ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternfold.schema import KEY, by_series, compressed

#: Names of the polynomial rules by order.
KINDS = {1: "arithmetic", 2: "quadratic", 3: "cubic"}


def _near(a: Column, b: Column, exact: Column) -> Column:
    room = F.when(exact, 0.0).otherwise(1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
    return F.abs(a - b) <= room


def differences(obs: DataFrame, max_order: int = 3) -> DataFrame:
    """Present values with their differences of orders 1..max_order, d1..; the first of each order are null."""
    w = by_series("pos")
    out = compressed(obs).select(KEY, "pos", "value")
    last = "value"
    for k in range(1, max_order + 1):
        out = out.withColumn(f"d{k}", F.col(last) - F.lag(last).over(w))
        last = f"d{k}"
    return out


def constant_order(obs: DataFrame, max_order: int = 3) -> DataFrame:
    """Per series: n, exact (all whole), the lowest order whose differences are constant and number two at least, difference."""
    w = by_series("pos")
    d = differences(obs, max_order)
    exact = d.groupBy(KEY).agg(F.bool_and(F.col("value") == F.floor("value")).alias("exact"), F.count("*").alias("n"))
    d = d.join(exact, KEY)
    firsts = d.select("*", *[F.first(f"d{k}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_f{k}") for k in range(1, max_order + 1)])
    tests = [F.coalesce(F.bool_and(F.when(F.col(f"d{k}").isNotNull(), _near(F.col(f"d{k}"), F.col(f"_f{k}"), F.col("exact")))), F.lit(False)).alias(f"_c{k}") for k in range(1, max_order + 1)]
    g = firsts.groupBy(KEY).agg(F.first("n").alias("n"), F.first("exact").alias("exact"), *tests, *[F.first(f"_f{k}", ignorenulls=True).alias(f"_f{k}") for k in range(1, max_order + 1)])
    order, diff = F.lit(None).cast("long"), F.lit(None).cast("double")
    for k in range(max_order, 0, -1):
        good = F.col(f"_c{k}") & (F.col("n") - k >= 2)
        order, diff = F.when(good, F.lit(k).cast("long")).otherwise(order), F.when(good, F.col(f"_f{k}")).otherwise(diff)
    return g.select(KEY, "n", "exact", order.alias("order"), diff.alias("difference"))


def additive(obs: DataFrame) -> DataFrame:
    """Per series: additive, whether each value from the third is the sum of the two before it."""
    w = by_series("pos")
    v = compressed(obs).select(KEY, "value", F.lag("value").over(w).alias("_a"), F.lag("value", 2).over(w).alias("_b"))
    whole = F.col("value") == F.floor("value")
    return v.groupBy(KEY).agg(((F.count("*") >= 3) & F.coalesce(F.bool_and(F.when(F.col("_b").isNotNull(), _near(F.col("value"), F.col("_a") + F.col("_b"), whole))), F.lit(False))).alias("additive"))


def geometric(obs: DataFrame) -> DataFrame:
    """Per series: ratio of neighbours where it is constant (three values at least, none but the last zero)."""
    w = by_series("pos")
    v = compressed(obs).select(KEY, "pos", "value", F.lag("value").over(w).alias("_a"))
    v = v.withColumn("q", F.col("value") / F.nullif(F.col("_a"), F.lit(0.0)))
    first = F.first("q", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    v = v.withColumn("_f", first)
    g = v.groupBy(KEY).agg(F.count("*").alias("_n"), F.count_if(F.col("_a") == 0).alias("_zero"), F.bool_and(F.when(F.col("q").isNotNull(), _near(F.col("q"), F.col("_f"), F.lit(False)))).alias("_same"), F.first("_f").alias("_f"))
    return g.select(KEY, F.when((F.col("_n") >= 3) & (F.col("_zero") == 0) & F.col("_same"), F.col("_f")).alias("ratio"))


def solve(obs: DataFrame, steps: int = 1, max_order: int = 3) -> DataFrame:
    """Per series: kind (arithmetic, quadratic, cubic, fibonacci_like, geometric, unknown), parameter, next values, confidence.

    A rule in whole numbers is certain (1.0), one within rounding 0.95. Next values come from the last few: sums of the
    last differences for a polynomial, so no row is visited again.
    """
    d = differences(obs, max_order)
    tail = d.groupBy(KEY).agg(F.max_by(F.struct("value", *[f"d{k}" for k in range(1, max_order + 1)]), "pos").alias("_l"), F.max_by("value", F.col("pos")).alias("_x"))
    prior = d.withColumn("_r", F.row_number().over(by_series("pos").orderBy(F.desc("pos")))).where("_r = 2").select(KEY, F.col("value").alias("_y"))
    s = constant_order(obs, max_order).join(additive(obs), KEY).join(geometric(obs), KEY).join(tail, KEY).join(prior, KEY, "left")
    order = F.col("order")
    kind = F.when((F.col("n") < 3), "unknown")
    for k in range(1, max_order + 1):
        kind = kind.when(order == k, KINDS.get(k, f"poly-order-{k}"))
    kind = kind.when(F.col("additive"), "fibonacci_like").when(F.col("ratio").isNotNull(), "geometric").otherwise("unknown")
    s = s.withColumn("kind", kind)

    def ahead(k: int) -> Column:
        """The polynomial's value k steps on: differences of order o count comb(k + o - 1, o) times."""
        total, times = F.col("_l.value"), F.lit(1.0)
        for o in range(1, max_order + 1):
            times = times * (k + o - 1) / o
            total = total + F.when(order >= o, times * F.when(order == o, F.col("difference")).otherwise(F.col(f"_l.d{o}"))).otherwise(0.0)
        return total

    fib = [F.col("_x") + F.col("_y")]
    fib.append(fib[0] + F.col("_x"))
    while len(fib) < steps:
        fib.append(fib[-1] + fib[-2])
    poly = F.array(*[ahead(k) for k in range(1, steps + 1)])
    geo = F.array(*[F.col("_x") * F.pow("ratio", F.lit(k)) for k in range(1, steps + 1)])
    poly_kind = F.col("kind").isin(*[KINDS.get(k, f"poly-order-{k}") for k in range(1, max_order + 1)])
    nxt = F.when(poly_kind, poly).when(F.col("kind") == "fibonacci_like", F.array(*fib[:steps])).when(F.col("kind") == "geometric", geo).otherwise(F.array().cast("array<double>"))
    param = F.when(poly_kind, F.col("difference")).when(F.col("kind") == "geometric", F.col("ratio"))
    sure = F.when(F.col("kind") == "unknown", 0.0).when(F.col("exact"), 1.0).otherwise(0.95)
    return s.select(KEY, "n", "kind", param.alias("parameter"), nxt.alias("next"), sure.alias("confidence"))
