import duckdb
import numpy as np
import pytest

from patternfold import catalogue
from patternfold.errors import PatternError
from patternfold.functions import arrow
from patternfold.operators import clustering, multivariate, sequence


def test_warping_covers_whole_series(spark, small):
    series: dict = {}
    for r in spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").collect():
        series.setdefault(r.event_type, []).append(r.value)
    assert min(map(len, series.values())) > 60
    got = {(r.a, r.b): r.distance for r in catalogue.QUERIES["dtw_users"](spark, small).collect()}
    assert got == {(a, b): pytest.approx(arrow.dtw(tuple(series[a]), tuple(series[b]))[0], abs=1e-6) for a in series for b in series if a < b}


def test_components_of_all_customers(spark, small):
    edges = [(r.c_nationkey, 100 + r.c_custkey % 7) for r in spark.read.parquet(f"{small}/customer.parquet").collect()]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in catalogue.QUERIES["components"](spark, small).collect()}
    assert got == {x: root(x) for x in parent}


def test_covariance_of_all_dimensions(spark, small):
    v = np.array([r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()], float)
    got = {(r.i, r.j): r.covariance for r in catalogue.QUERIES["vector_covariance"](spark, small).collect()}
    want = np.cov(v, rowvar=False) + 1e-6 * np.eye(v.shape[1])
    assert len(got) == v.shape[1] ** 2 == 4096
    assert all(abs(got[i, j] - want[i, j]) < 1e-6 for i, j in got)
    one = spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    assert [r.covariance for r in multivariate.covariance(one, 2).collect()] == [1e-6, 0.0, 0.0, 1e-6]


def test_warping_by_diagonals():
    for a, b in (([1.0], [2.0]), ([1.0, 5.0, 2.0], [4.0]), ([3.0, 1.0], [1.0, 2.0, 9.0, 4.0, 4.0]), ([0.0] * 7, [1.0, -1.0])):
        assert arrow.dtw_whole(a, b) == arrow.dtw_whole(b, a) == arrow.dtw(tuple(a), tuple(b))[0]
    for a, b in (([], [1.0]), ([1.0, None], [1.0])):
        with pytest.raises(ValueError):
            arrow.dtw_whole(a, b)


def plain_dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps] for i in range(n)]
    labels, number = [-1] * n, 0
    for i in range(n):
        if labels[i] < 0 and len(near[i]) >= least:
            todo = [i]
            while todo:
                j = todo.pop()
                if labels[j] < 0:
                    labels[j] = number
                    if len(near[j]) >= least:
                        todo += near[j]
            number += 1
    return labels


def test_dense_points():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 60, 60):
        p = r.integers(0, 12, (n, 2)).astype(float)
        for eps in (0.5, 1.0, 1.5, clustering.auto_eps(p)):
            assert clustering.dense_points(p, eps, 3).tolist() == plain_dbscan(p.tolist(), eps, 3)


def test_dense_regimes(series):
    values = [5.0] * 12 + [50.0] * 12
    r = clustering.regimes(series(values), 8, method="dbscan").orderBy("cluster").collect()
    p = [values[i : i + 8] for i in range(17)]
    labels = plain_dbscan(p, clustering.auto_eps(np.array(p)), 3)
    assert -1 in labels and len(r) == max(labels) + 1 == 2
    for x in r:
        own = [i for i, c in enumerate(labels) if c == x.cluster]
        assert list(x.occurrences) == own and x["count"] == len(own) and x.support == pytest.approx(len(own) / 17)
    with pytest.raises(PatternError):
        clustering.regimes(series(values), 8, method="other")


def test_recurring_values_beside_rare_ones(spark, series, tmp_path):
    labels = {7: "aabbaabcc", 8: "abcabcabc", 9: "aabbcc", 10: "xxxy"}
    rows = ", ".join(f"({100 * u + i}, TIMESTAMP '2024-01-01' + INTERVAL {i} SECOND, {u}, '{x}', 1.0)" for u, text in labels.items() for i, x in enumerate(text))
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, catalogue.QUERIES["recurring_values"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(catalogue.ORACLE_SQL["recurring_values"]).fetchall())
    assert got == [("10", "x", 3, 1.0, 0, 2), ("7", "a", 4, 0.571429, 0, 5), ("7", "b", 3, 0.428571, 2, 6), *[("8", x, 3, 0.333333, i, i + 6) for i, x in enumerate("abc")]]
    own = {r.value: r.support for r in sequence.recurring_values(series(labels=[*labels[7], None])).collect()}
    assert own == {"a": 4 / 9, "b": 3 / 9}
