"""Clusters of vectors and regimes of series.

k-means, single linkage and their ties are sequential; for many series they run per series in Arrow-fed numpy. For one
large set of vectors, ``kmeans_large`` uses Spark's distributed k-means and ``dbscan`` is joins and components.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternfold.errors import PatternError
from patternfold.operators.structural import components
from patternfold.operators.windows import embed
from patternfold.schema import KEY


def kmeans_points(points: np.ndarray, k: int, seed: int = 0, most: int = 100) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Labels, centroids, inertia, iterations. Seeding is k-means++; ties go to the lowest cluster, an empty one takes
    the farthest point."""
    n = len(points)
    if not 1 <= k <= n:
        raise PatternError(f"k must be within 1 and {n}")
    r = random.Random(seed)
    centres = [points[r.randrange(n)]]
    while len(centres) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        total = float(d.sum())
        pick = r.random() * total if total > 0 else 0.0
        at = int(np.searchsorted(np.cumsum(d), pick, side="right")) if total > 0 else r.randrange(n)
        centres.append(points[min(at, n - 1)])
    c, labels, turn = np.array(centres, float), np.full(n, -1), 0
    for turn in range(1, most + 1):
        d = ((points[:, None, :] - c[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        for j in range(k):
            own = points[labels == j]
            c[j] = own.mean(axis=0) if len(own) else points[d.min(axis=1).argmax()]
    d = ((points - c[labels]) ** 2).sum(axis=1)
    return labels, c, float(d.sum()), turn


def kmeans(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Per series: cluster of every vector (series_id, start, vector). Series with fewer vectors than k get none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        if len(rows) < k:
            return rows.assign(cluster=pd.Series(dtype="int64"))[:0]
        labels = kmeans_points(np.array(rows.vector.tolist(), float), k, seed)[0]
        return rows.assign(cluster=labels)

    return vectors.select(KEY, "start", "vector").groupBy(KEY).applyInPandas(run, f"{KEY} string, start long, vector array<double>, cluster long")


def kmeans_large(vectors: DataFrame, k: int, column: str = "vector", seed: int = 0) -> DataFrame:
    """``vectors`` with a cluster each, by distributed k-means (its seeding differs, so clusters may be numbered otherwise)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", maxIter=100).fit(ready)
    return model.transform(ready).drop("_features")


def neighbours(points: DataFrame, eps: float, key: str = "id", column: str = "vector") -> DataFrame:
    """Pairs a, b of points (b = a too) at distance eps at most.

    Points meet in cells of eps along the three dimensions that vary most, and each looks into the adjacent ones, so
    only near points are compared.
    """
    size = points.select(F.size(column)).first()
    if size is None:
        return points.select(F.col(key).alias("a"), F.col(key).alias("b"))
    spread = points.agg(*[F.var_pop(F.col(column)[i]).alias(str(i)) for i in range(size[0])]).first()
    dims = sorted(range(size[0]), key=lambda i: -(spread[i] or 0))[:3]
    cell = [F.floor(F.col(column)[i] / eps).cast("long").alias(f"_c{n}") for n, i in enumerate(dims)]
    cells = [f"_c{n}" for n in range(len(dims))]
    left = points.select(F.col(key).alias("a"), F.col(column).alias("x"), *cell)
    right = points.select(F.col(key).alias("b"), F.col(column).alias("y"), *cell)
    for c in cells:
        right = right.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    return left.join(right, cells).where(square <= eps * eps).select("a", "b")


def dbscan(points: DataFrame, eps: float, min_points: int, key: str = "id", column: str = "vector") -> DataFrame:
    """key, cluster: numbered by least core point from 0, border points in the lowest cluster that reaches them, noise -1."""
    near = neighbours(points, eps, key, column)
    core = near.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).select(F.col("a").alias("node"))
    links = near.join(core, near["a"] == core["node"], "left_semi").join(core, near["b"] == core["node"], "left_semi")
    groups = components(links, core)
    number = _ranked(groups.select("component").distinct())
    numbered = groups.join(number, "component").select(F.col("node").alias("b"), "cluster")
    reached = near.join(numbered, "b").groupBy("a").agg(F.min("cluster").alias("_reach"))
    own = numbered.select(F.col("b").alias("a"), F.col("cluster").alias("_own"))
    out = points.select(F.col(key).alias("a")).join(own, "a", "left").join(reached, "a", "left")
    return out.select(F.col("a").alias(key), F.coalesce("_own", "_reach", F.lit(-1)).cast("long").alias("cluster"))


def _ranked(found: DataFrame) -> DataFrame:
    """component, cluster: its rank from 0. Ranges of components are counted apart; only a count for each range is summed in one place."""
    from patternfold.storage import written

    ranges = written(found.repartitionByRange("component").withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("component"))
    return ranges.join(F.broadcast(before), "_part").select("component", (F.col("_before") + inside - 1).cast("long").alias("cluster"))


def single_linkage(points: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Labels (clusters by their least member) after merging the nearest clusters until k are left, and all merges."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, d[i, j]))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    merges = []
    for e in order.tolist():
        if n - len(merges) <= k:
            break
        a, b = sorted((root(int(i[e])), root(int(j[e]))))
        if a != b:
            parent[b] = a
            merges.append((a, b, float(d[i[e], j[e]])))
    roots = [root(x) for x in range(n)]
    number = {r: c for c, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots]), merges


def agglomerative(vectors: DataFrame, k: int, most: int = 1000) -> DataFrame:
    """Per series, single-linkage clusters of its vectors. Over ``most`` vectors in a series is refused: it takes their square."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise PatternError(f"{len(rows)} vectors in a series; {most} at most")
        rows = rows.sort_values("start")
        return rows.assign(cluster=single_linkage(np.array(rows.vector.tolist(), float), min(k, len(rows)))[0])

    return vectors.select(KEY, "start", "vector").groupBy(KEY).applyInPandas(run, f"{KEY} string, start long, vector array<double>, cluster long")


def auto_eps(points: np.ndarray) -> float:
    """1.5 times the mean distance to the nearest neighbour; 1 where there is none."""
    if len(points) < 2:
        return 1.0
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    eps = 1.5 * float(d.min(axis=1).mean()) + 1e-9
    return eps if eps > 1e-9 else 1.0


def dense_points(points: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Labels as ``dbscan`` gives them."""
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_points
    labels, number = np.full(len(points), -1), 0
    for i in np.flatnonzero(core).tolist():
        if labels[i] < 0:
            reached = near[i].copy()
            while True:
                wider = reached | near[reached & core].any(axis=0)
                if (wider == reached).all():
                    break
                reached = wider
            labels[reached & (labels < 0)] = number
            number += 1
    return labels


def dense(vectors: DataFrame, min_points: int = 3, most: int = 1000) -> DataFrame:
    """Per series, dense clusters of its vectors within ``auto_eps`` of them, noise -1. Refused over ``most`` vectors, as in ``agglomerative``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise PatternError(f"{len(rows)} vectors in a series; {most} at most")
        rows = rows.sort_values("start")
        points = np.array(rows.vector.tolist(), float)
        return rows.assign(cluster=dense_points(points, auto_eps(points), min_points))

    return vectors.select(KEY, "start", "vector").groupBy(KEY).applyInPandas(run, f"{KEY} string, start long, vector array<double>, cluster long")


def regimes(obs: DataFrame, size: int = 8, k: int = 2, method: str = "kmeans") -> DataFrame:
    """Clusters of a series' windows by kmeans, agglomerative or dbscan: cluster, count, support, centroid, occurrences (starts).

    dbscan finds their number itself; its noise is no cluster, but counts in the denominator of support.
    """
    methods = {"kmeans": lambda v: kmeans(v, k), "agglomerative": lambda v: agglomerative(v, k), "dbscan": dense}
    if method not in methods:
        raise PatternError(f"method must be one of {', '.join(methods)}")
    clustered = methods[method](embed(obs, size))
    n = clustered.groupBy(KEY).agg(F.count("*").alias("_n"))
    dims = [F.avg(F.col("vector")[i]).alias(f"_{i}") for i in range(size)]
    g = clustered.where("cluster >= 0").groupBy(KEY, "cluster").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("start")).alias("occurrences"), *dims).join(n, KEY)
    return g.select(KEY, "cluster", "count", (F.col("count") / F.col("_n")).alias("support"), F.array(*[F.col(f"_{i}") for i in range(size)]).alias("centroid"), "occurrences")
