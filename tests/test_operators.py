import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternfold.errors import PatternError, SingularDataError
from patternfold.functions import arrow, columns
from patternfold.operators import anomaly, arithmetic, clustering, context, memory, multivariate, sequence, stats, structural, windows
from patternfold.schema import KEY


def one(df):
    return df.collect()[0].asDict()


def test_describe_and_quality(series):
    d = one(stats.describe(series([1, 2, None, 4])))
    assert (d["n"], d["missing"], d["mean"], d["median"], d["p25"]) == (4, 1, 7 / 3, 2.0, 1.5)
    q = one(stats.quality(series([7, 7, 7])))
    assert q["quality"] == 0.7 and q["constant"] and q["reason"] == "constant data"
    assert one(stats.quality(series([1, 2, 3, 4, 5])))["quality"] == 1.0
    assert one(stats.quality(series([1, 2, None, None])))["missing"] == 2
    assert not one(stats.validate(series([1, None, None])))["ok"]
    z = [r.z for r in stats.z_scores(series([5, 5, None])).orderBy("idx").collect()]
    assert z == [0.0, 0.0, None]


def test_correlation(spark):
    rnd = random.Random(42)
    df = spark.createDataFrame([(float(i), 3.0 * i + rnd.uniform(-0.5, 0.5), 7.0, None if i % 2 else float(i)) for i in range(20)], "x double, y double, c double, h double")
    strong = stats.strong_correlations(df, ["x", "y", "c"], 0.9).collect()
    assert [(r.a, r.b) for r in strong] == [("x", "y")] and strong[0].correlation > 0.95
    m = {(r.a, r.b): (r.correlation, r.pairs) for r in stats.correlation_matrix(df, ["x", "c", "h"]).collect()}
    assert m["c", "c"][0] == 0 and m["x", "x"][0] == 1 and m["x", "h"][1] == 10


def test_time_structure(series):
    sine = [math.sin(2 * math.pi * i / 12) for i in range(48)]
    p = one(windows.period(series(sine)))
    assert p["period"] == 12 and p["strength"] > 0.5
    parts = windows.decompose(series(sine), 12)
    assert one(windows.seasonal_strength(parts))["seasonal_strength"] > 0.8
    assert windows.period(series([3.0] * 30)).count() == 0
    best = stats.spectrum(series([math.sin(2 * math.pi * i / 8) for i in range(64)])).where("rank = 1").collect()[0]
    assert abs(best.period - 8) < 1
    t = one(stats.trend(series([5.0] * 4)))
    assert (t["slope"], t["r2"], t["direction"]) == (0, 0, "flat")
    assert [r.autocorrelation for r in stats.autocorrelation(series([1.0, 1.0, 1.0]), 2).collect()] == [0, 0]


def test_change_points_and_streams(series):
    got = windows.change_points(series([1.0] * 20 + [10.0] * 20), 5, 2.0).collect()
    assert any(15 <= r.idx <= 25 for r in got)
    assert windows.change_points(series([1.0] * 5), 5).count() == 0
    jump = windows.stream_anomalies(series([5.0] * 5 + [20.0]), 5).collect()
    assert [(r.idx, r.z, r.score) for r in jump] == [(5, math.inf, 1.0)]
    rnd = random.Random(1)
    values = [10 + rnd.random() for _ in range(50)] + [40.0] + [10 + rnd.random() for _ in range(10)]
    assert [r.idx for r in windows.stream_anomalies(series(values), 20).collect()] == [50]
    with pytest.raises(PatternError):
        windows.stream_anomalies(series([1.0]), 0)
    assert windows.embed(series([0.0] * 20 + [10.0] * 20), 4).count() == 37


def test_labels(series):
    abc = series(labels=list("ABC" * 3))
    value = {r.value: r for r in sequence.recurring_values(abc).collect()}
    assert value["A"]["count"] == 3 and value["B"].occurrences == [1, 4, 7]
    grams = {"".join(r.gram): r["count"] for r in sequence.frequent_sequences(abc).collect()}
    assert grams["ABC"] == 3
    t = {(r.a, r.b): r.probability for r in sequence.transitions(abc).collect()}
    assert t["C", "A"] == 1.0
    runs = [(r.label, r.start, r.end, r.length) for r in sequence.runs(series(labels=["x", "x", None, None, "y"])).orderBy("start").collect()]
    assert runs == [("x", 0, 1, 2), (None, 2, 3, 2), ("y", 4, 4, 1)]
    assert [r.idx for r in sequence.label_changes(series(labels=["x", None, "y"])).orderBy("idx").collect()] == [1, 2]
    b = one(context.backoff(context.context_model(abc), context.suffixes(abc), 1))
    assert (b["ord"], b["nxt"], b["p"]) == (2, "A", 1.0)
    assert one(context.log_loss(context.context_model(abc), abc))["scored"] == 9
    numbers = random.Random(42)
    noise = series(labels=[str(numbers.randrange(1000)) for _ in range(100)])
    assert sequence.frequent_sequences(noise).count() == 0


def test_relationships(spark, series):
    p = spark.createDataFrame([("X", ["A", "B"]), ("Y", ["C"]), ("Z", [])], "id string, sequence array<string>")
    r = {(x.a, x.b): x for x in sequence.relationships(series(labels=list("ABCABC")), p).collect()}
    assert r["X", "Y"]["count"] == 2 and r["X", "Y"].followed_by == 1.0 and r["X", "Y"].evidence == 3 and r["Y", "X"]["count"] == 1


@pytest.mark.parametrize(
    "values, kind, nxt",
    [([2, 4, 6, 8], "arithmetic", 10), ([1, 4, 9, 16], "quadratic", 25), ([3, 6, 12, 24], "geometric", 48), ([1, 1, 2, 3, 5, 8], "fibonacci_like", 13), ([2, 7, 1, 9], "unknown", None), ([5, 5, 5, 5], "arithmetic", 5), ([1, 8, 27, 64, 125], "cubic", 216), ([1, 2], "unknown", None)],
)
def test_rules(series, values, kind, nxt):
    s = one(arithmetic.solve(series(values), 2))
    assert s["kind"] == kind and (s["next"][0] if s["next"] else None) == nxt
    assert s["confidence"] == (0.0 if kind == "unknown" else 1.0)


def test_rule_steps(series):
    assert one(arithmetic.solve(series([1, 4, 9, 16]), 3))["next"] == [25, 36, 49]
    assert one(arithmetic.solve(series([1, 1, 2, 3, 5]), 3))["next"] == [8, 13, 21]
    assert one(arithmetic.solve(series([0.1, 0.2, 0.3]), 1))["confidence"] == 0.95


def test_graphs(spark, series):
    g = {(r.a, r.b): r["count"] for r in structural.cooccurrence(series(labels=["b", "a", None, "b", "b"])).collect()}
    assert g == {("a", "b"): 2}
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 10), (10, 11), (11, 12), (12, 13)], "a long, b long")
    c = {r.node: r.component for r in structural.components(e, spark.createDataFrame([(7,)], "node long")).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 9: 9, 10: 9, 11: 9, 12: 9, 13: 9}
    t = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 1, "b"), ("s", 2, "a"), ("s", 2, "b"), ("s", 3, "a")], f"{KEY} string, txn long, item string")
    rules = {(r.antecedent, r.consequent): (r["count"], round(r.support, 3), round(r.confidence, 3)) for r in structural.association_rules(t).collect()}
    assert rules == {("a", "b"): (2, 0.667, 0.667), ("b", "a"): (2, 0.667, 1.0)}


def test_clusters(spark):
    points = [[0.0], [0.1], [-0.1], [10.0], [10.1], [9.9]]
    v = spark.createDataFrame([("s", i, p) for i, p in enumerate(points)], f"{KEY} string, start long, vector array<double>")
    for out in (clustering.kmeans(v, 2), clustering.agglomerative(v, 2)):
        c = [r.cluster for r in out.orderBy("start").collect()]
        assert len(set(c[:3])) == len(set(c[3:])) == 1 and c[0] != c[3]
    d = spark.createDataFrame([(i, p) for i, p in enumerate([*points, [50.0]])], "id long, vector array<double>")
    assert [r.cluster for r in clustering.dbscan(d, 0.5, 2).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, -1]
    with pytest.raises(PatternError):
        clustering.kmeans_points(__import__("numpy").zeros((2, 1)), 3)


def test_regimes(series):
    r = clustering.regimes(series([5.0] * 40 + [50.0] * 40), 8, 2).collect()
    means = sorted(sum(x.centroid) / 8 for x in r)
    assert len(r) == 2 and means[0] < 10 and means[1] > 40


def test_multivariate(spark):
    v = spark.createDataFrame([([float(i), 2.0 * i],) for i in range(1, 5)], "vector array<double>")
    m = multivariate.pca(v, 1, 2)
    assert m.ratios[0] == pytest.approx(1) and multivariate.reconstruction_error(v, m).collect()[0].error == pytest.approx(0, abs=1e-9)
    rnd = random.Random(3)
    rows = [([20 + rnd.random(), 1013 + rnd.random()],) for _ in range(25)] + [([35.0, 990.0],), ([None, 1.0],)]
    odd = multivariate.multivariate_anomalies(spark.createDataFrame(rows, "vector array<double>"), 2).collect()
    assert len(odd) == 1 and odd[0].vector == [35.0, 990.0]
    with pytest.raises(SingularDataError):
        multivariate.inverse(__import__("numpy").zeros((2, 2)))


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], ["a", "b"], ["b", "c"])], "a array<double>, b array<double>, x array<string>, y array<string>")
    row = df.select(columns.euclidean(F.col("a"), F.col("b")), columns.cosine_similarity(F.col("a"), F.col("b")), columns.pearson_similarity(F.col("a"), F.col("b")), columns.jaccard(F.col("x"), F.col("y")), arrow.dtw_distance("a", "b"), arrow.sequence_similarity("x", "y")).collect()[0]
    assert [round(x, 6) for x in row] == [0.0, 1.0, 1.0, 0.333333, 0.0, 0.5]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="one size"):
        bad.select(columns.euclidean(F.col("a"), F.col("b"))).collect()


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8), st.lists(st.floats(-5, 5), min_size=1, max_size=8))
def test_dtw_properties(a, b):
    assert arrow.dtw(tuple(a), tuple(a))[0] == 0
    d, path = arrow.dtw(tuple(a), tuple(b))
    assert d == pytest.approx(arrow.dtw(tuple(b), tuple(a))[0]) and path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
    assert d == pytest.approx(sum(abs(a[i] - b[j]) for i, j in path))


def test_anomalies(spark, series):
    values = [10 + i % 3 for i in range(60)] + [100.0]
    assert [r.idx for r in anomaly.detect(series(values)).collect()] == [60]
    p = spark.createDataFrame([(["A", "B", "C"],)], "sequence array<string>")
    found = {r.idx: r.kind for r in anomaly.novel_pairs(series(labels=["A", "B", "A", "X", "C"]), anomaly.known_bigrams(p)).collect()}
    assert found == {2: "missing_transition", 3: "missing_transition", 4: "novel_sequence"}
    assert anomaly.novel_pairs(series(labels=["A", "B"]), anomaly.known_bigrams(p.limit(0))).count() == 0


def test_memory(spark):
    state = lambda *a: spark.range(1).select(memory.advance(*[F.lit(x) for x in a])).collect()[0][0]
    assert [state("NEW", 1, 0.1, 0.0, 0, True), state("OBSERVED", 3, 0.1, 0.0, 0, True), state("CONFIRMED", 3, 0.8, 0.0, 0, True), state("ESTABLISHED", 3, 0.8, 0.6, 0, True)] == ["OBSERVED", "CONFIRMED", "ESTABLISHED", "EVOLVING"]
    assert [state("OBSERVED", 1, 0.1, 0.0, 99, False), state("STALE", 1, 0.1, 0.0, 199, False), state("RETIRED", 1, 0.1, 0.0, 0, True), state("EVOLVING", 1, 0.1, 0.1, 0, True)] == ["STALE", "RETIRED", "OBSERVED", "CONFIRMED"]
    old = spark.createDataFrame([("P", "frequency", 10.0), ("P", "x", 1.0), ("Q", "x", 1.0)], "id string, key string, value double")
    new = spark.createDataFrame([("P", "frequency", 15.0), ("P", "y", 1.0), ("Q", "x", 1.0)], "id string, key string, value double")
    assert {r.id: round(r.drift, 6) for r in memory.drift(old, new).collect()} == {"P": 0.5, "Q": 0.0}
    s = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.05), ("b", 1, 0.3), ("b", 2, 0.4), ("c", 1, 0.4), ("c", 2, 0.2), ("d", 1, 0.2), ("d", 2, 0.1), ("d", 3, 0.3)], "id string, step long, drift double")
    assert {r.id: r.trend for r in memory.drift_trend(s).collect()} == {"a": "stable", "b": "drifting", "c": "converging", "d": "oscillating"}
