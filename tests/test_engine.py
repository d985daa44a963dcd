import math
import random

import pytest

from patternfold.engine import PatternEngine
from patternfold.errors import PatternError
from patternfold.operators import windows
from patternfold.schema import OBS
from patternfold.streaming import online


def test_labels_end_to_end(spark, series, tmp_path):
    e = PatternEngine(spark)
    result = e.discover(series(labels=list("ABC" * 10)))
    found = {"".join(r.sequence): r for r in result.patterns.where("type = 'frequent_sequence'").collect()}
    assert found["ABC"].frequency == 10 and found["ABC"].id.startswith("P-") and found["ABC"].state == "OBSERVED"
    assert e.predict_next(series(labels=list("ABC" * 10))).collect()[0].next == "A"
    p = e.predict(series(labels=list("ABC" * 10)))
    assert p["markov"].collect()[0].probability == 1.0 and p["context"].collect()[0].nxt == "A"
    before = e.size()
    e.discover(series(labels=list("ABC" * 10)))
    again = {"".join(r.sequence): r for r in e.find_by_type("frequent_sequence").collect()}
    assert e.size() == before and again["ABC"].frequency == 20 and again["ABC"].state == "CONFIRMED"
    text = e.report(limit=3)
    assert text.startswith("# Pattern report") and "+" in text and "P-001" in e.report(form="text")
    assert "P-001" in e.explain("P-001") and "no pattern" in e.explain("P-999")
    e.save(str(tmp_path / "engine"))
    assert PatternEngine.load(spark, str(tmp_path / "engine")).size() == before
    assert e.history("all/P-001").count() > 0
    e.update("P-001", state="RETIRED", id="P-777")
    assert e.get_pattern("P-001").collect()[0].state == "RETIRED"
    e.prune(before - 1)
    assert e.size() == before - 1


def test_numbers_end_to_end(spark, series):
    e = PatternEngine(spark)
    sine = [math.sin(2 * math.pi * i / 12) for i in range(48)]
    types = {r.type for r in e.discover(series(sine)).patterns.collect()}
    assert {"seasonal", "regime"} <= types
    assert [r.forecast for r in e.predict(series(sine))["seasonal"].collect()][0] == pytest.approx(0, abs=1e-6)
    fresh = PatternEngine(spark)
    rnd = random.Random(0)
    out = fresh.find_anomalies(series([10 + rnd.random() for _ in range(60)] + [100.0])).anomalies.collect()
    assert any(r.kind == "statistical" and r.idx == 60 for r in out) and any(r.kind == "multivariate" and r.idx == 60 for r in out)
    assert PatternEngine(spark).discover(series([2.0, 4.0, 6.0, 8.0])).patterns.where("type = 'arithmetic'").count() == 1


def test_columns_batch_match(spark, series):
    table = spark.createDataFrame([(float(i), 3.0 * i) for i in range(20)], "x double, y double")
    e = PatternEngine(spark, {"seasonality": False, "regimes": False})
    found = e.discover(series([1.0, 2.0]), table).patterns.where("type = 'correlation'").collect()
    assert found[0].sequence == ["x", "y"] and found[0].frequency == 20
    b = e.batch({"one": list("ABABABAB"), "two": [1.0, 2.0, 3.0], "none": []})
    assert {r.series_id for r in b.patterns.select("series_id").distinct().collect()} == {"one", "two"}
    e2 = PatternEngine(spark)
    d = e2.detect(series(labels=list("ABABAB")))
    assert d.matches.where("similarity >= 0.5").count() > 0


def test_series_keep_to_themselves(spark, series):
    """Equal series have equal patterns and relationships, however many they are; ids are theirs alone."""
    from functools import reduce

    one = list("UVWX" * 7)
    e = PatternEngine(spark, {"regimes": False, "seasonality": False})
    alone = e.discover(series(labels=one, key="s0")).patterns.where("type = 'frequent_sequence'").collect()
    many = PatternEngine(spark, {"regimes": False, "seasonality": False})
    both = many.discover(reduce(lambda a, b: a.unionByName(b), [series(labels=one, key=f"s{i}") for i in range(4)])).patterns.where("type = 'frequent_sequence'").collect()
    of = lambda rows, key: {tuple(r.sequence): (r.id, r.frequency, r.relationships) for r in rows if r.series_id == key}
    want = of(alone, "s0")
    assert want[("U", "V")][2]["followed_by"] and all(of(both, f"s{i}") == want for i in range(4))
    with pytest.raises(PatternError):
        many.update("P-001", state="RETIRED")
    with pytest.raises(PatternError):
        many.explain("P-001")
    many.update("P-001", series="s2", state="RETIRED")
    assert {r.series_id for r in many.get_pattern("P-001").where("state = 'RETIRED'").collect()} == {"s2"} and "P-001" in many.explain("P-001", "s1")


def test_batch_goes_on(spark):
    e = PatternEngine(spark, {"regimes": False, "seasonality": False})
    b = e.batch({"good": list("KLKLKLKL"), "bad": spark.range(3)})
    assert {r.series_id for r in b.patterns.select("series_id").distinct().collect()} == {"good"} and b.matches.count() > 0
    assert "bad" in {r.series_id for r in b.evidence["errors"].collect()}
    assert e.batch({}).patterns.count() == 0


def test_saved_trails(spark, series, tmp_path):
    e = PatternEngine(spark, {"regimes": False, "seasonality": False})
    path = str(tmp_path / "engine")
    e.discover(series(labels=list("GHI" * 5)))
    e.save(path)
    e.discover(series(labels=list("GHI" * 5)))
    e.save(path)
    (tmp_path / "engine" / "manifest-000000009-broken").mkdir()  # a save that broke off
    back = PatternEngine.load(spark, path)
    trail = lambda x: sorted((r.step, r.key, r.value) for r in x.history("all/P-001").collect())
    assert back.runs == 2 and trail(back) == trail(e) and {t[0] for t in trail(back)} == {0, 1}
    back.discover(series(labels=list("GHI" * 5)))
    assert {t[0] for t in trail(back)} == {0, 1, 2}
    with pytest.raises(PatternError):
        PatternEngine.load(spark, str(tmp_path / "none"))


def test_stream_equals_batch(spark, series, tmp_path):
    rnd = random.Random(5)
    values = [rnd.gauss(0, 1) for _ in range(200)]
    values[120] = 30.0
    obs = series(values)
    source = str(tmp_path / "in")
    for lo in range(0, 200, 40):
        obs.where(f"idx >= {lo} and idx < {lo + 40}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(source)
    q = online.stream_anomalies(stream, 20).writeStream.format("memory").queryName("odd").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.idx, round(r.z, 6)) for r in spark.sql("select * from odd where not late").collect()}
    want = {(r.idx, round(r.z, 6)) for r in windows.stream_anomalies(obs, 20).collect()}
    assert 120 in {i for i, _ in got} and (got == want or spark.sql("select * from odd where late").count() > 0)
    q = online.running_stats(spark.readStream.schema(OBS).parquet(source)).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n from stats").collect()[0].n == 200


def test_catalogue(spark, small):
    from patternfold import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    for name in ("describe_by_type", "stream_anomalies", "frequent_sequences"):
        assert catalogue.QUERIES[name](spark, small).count() >= 0


def test_describe_matches_sql(spark, small):
    import duckdb

    from patternfold import catalogue

    c = duckdb.connect()
    c.sql(f"create view events as select * from '{small}/events.parquet'")
    for name in ("describe_by_type", "transitions", "zscore_outliers", "moving_avg"):
        a = catalogue.QUERIES[name](spark, small).toPandas()
        b = c.sql(catalogue.ORACLE_SQL[name]).df()[list(a.columns)]
        by = list(a.columns)
        assert a.sort_values(by).round(5).astype(str).values.tolist() == b.sort_values(by).round(5).astype(str).values.tolist(), name
