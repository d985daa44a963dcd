import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patternfold.caching import LruCache, memoize, timed
from patternfold.records import Pattern, clamp01, pattern_id
from patternfold.streaming.counters import RunningStats, SlidingStats

numbers = st.lists(st.one_of(st.floats(-1e3, 1e3), st.none(), st.just(math.nan)), max_size=30)


@settings(max_examples=60, deadline=None)
@given(numbers, numbers)
def test_running_stats_merge(a, b):
    one, two, both = RunningStats(), RunningStats(), RunningStats()
    for x in a:
        one.update(x), both.update(x)
    for x in b:
        two.update(x), both.update(x)
    merged = one.merge(two)
    assert (merged.n, merged.missing) == (both.n, both.missing)
    good = [x for x in a + b if x is not None and x == x]
    if good:
        assert merged.mean == pytest.approx(statistics.fmean(good), abs=1e-6) and merged.stdev == pytest.approx(statistics.pstdev(good), abs=1e-6)
    else:
        assert merged.mean is None and merged.stdev is None


def test_sliding_stats():
    s = SlidingStats(3)
    for x in [1.0, None, 3.0, 5.0, True]:
        s.update(x)
    assert (s.n, s.mean, s.missing, len(s)) == (2, 4.0, 2, 3)
    s = SlidingStats(2)
    for x in [1e6, 1.0, 1.0]:
        s.update(x)
    assert s.stdev == 0.0
    with pytest.raises(ValueError):
        SlidingStats(0)


def test_pattern_record():
    p = Pattern.from_dict({"id": pattern_id(7), "confidence": 3, "frequency": -1, "novelty": "x", "unknown": 1})
    assert (p.id, p.confidence, p.frequency, p.novelty) == ("P-007", 1.0, 0, 0.0) and Pattern.from_dict(p.to_dict()) == p
    assert '"id": "P-007"' in p.to_json() and clamp01(math.nan, 0.5) == 0.5


def test_caches():
    c = LruCache(2)
    for k in "abc":
        c.set(k, k)
    assert "a" not in c and c.get("b") == "b" and c.get("a", 0) == 0 and len(c) == 2
    c.set("d", 1)
    assert "c" not in c and c.stats() == {"hits": 1, "misses": 1, "size": 2, "maxsize": 2}
    c.clear()
    calls = []
    f = memoize(4)(lambda x: calls.append(x) or x)
    assert f(1) == f(1) == 1 and calls == [1]
    spent = {}
    with timed(spent, "x"):
        pass
    assert spent["x"] >= 0


def test_record_of_a_row():
    p = Pattern.from_dict({})
    assert (p.type, p.series_id, p.state, p.frequency, p.similarity, p.first_seen, p.features, p.sequence) == ("unknown", "all", "NEW", 0, None, None, {}, [])
    assert p.features is not Pattern().features and p == Pattern() and p != Pattern(frequency=2) and p != {}
    assert Pattern(similarity=-2.0).similarity == 0.0 and Pattern.from_dict({"sequence": ["a"], "state": None}).to_dict()["state"] == "NEW"
    with pytest.raises(TypeError):
        Pattern(colour="red")
