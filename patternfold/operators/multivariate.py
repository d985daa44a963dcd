"""Principal components and Mahalanobis distance. Matrices are dims x dims and go to the driver; rows never do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternfold.errors import EmptyDataError, SingularDataError
from patternfold.functions.columns import dot


def valid(column: str, dims: int) -> Column:
    """Whether a vector has all its numbers."""
    return F.col(column).isNotNull() & (F.size(column) == dims) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _literal(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def moments(vectors: DataFrame, column: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population covariances over complete vectors: sums in one aggregate, then a product of matrices
    for each batch, around the means. A task sends one matrix of dims x dims; tasks' matrices add up by position."""
    d = vectors.where(valid(column, dims)).select(F.col(column).cast("array<double>").alias("v"))
    row = d.agg(F.count("*"), F.array(*[F.avg(F.col("v")[i]) for i in range(dims)])).first()
    n = row[0]
    if not n:
        raise EmptyDataError("no complete vector")
    mean = np.array(row[1], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, dims) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = d.mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    cov = np.zeros((dims, dims))
    for r in parts.collect():  # dims x dims numbers
        cov[r.i, r.j] = r.x / n
    return n, mean, (cov + cov.T) / 2


def covariance(vectors: DataFrame, dims: int, column: str = "vector", ridge: float = 1e-6) -> DataFrame:
    """i, j, covariance as ``stats.covariance_of_vectors`` has them, for vectors too wide for an aggregate of each pair."""
    n, _, cov = moments(vectors, column, dims)
    cov = (cov * n / (n - 1) if n > 1 else np.zeros_like(cov)) + ridge * np.eye(dims)
    return vectors.sparkSession.createDataFrame([(i, j, float(cov[i, j])) for i in range(dims) for j in range(dims)], "i long, j long, covariance double")


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # [k, dims]
    variances: np.ndarray
    ratios: np.ndarray  # of the variance of the components taken


def pca(vectors: DataFrame, k: int, dims: int, column: str = "vector") -> Pca:
    """The k first principal components. Signs: the largest entry of each is positive."""
    _, mean, cov = moments(vectors, column, dims)
    values, vs = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    parts = vs[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    variances = np.maximum(values[order], 0)
    total = variances.sum()
    return Pca(mean, parts, variances, variances / total if total > 0 else np.zeros(len(order)))


def pca_table(vectors: DataFrame, k: int, dims: int, column: str = "vector") -> DataFrame:
    """component, variance, ratio, vector."""
    m = pca(vectors, k, dims, column)
    return vectors.sparkSession.createDataFrame([(i, float(v), float(r), [float(x) for x in c]) for i, (v, r, c) in enumerate(zip(m.variances, m.ratios, m.components))], "component long, variance double, ratio double, vector array<double>")


def project(vectors: DataFrame, model: Pca, column: str = "vector") -> DataFrame:
    """``vectors`` that are complete, with their coordinates along the components."""
    centred = F.zip_with(F.col(column), _literal(model.mean), lambda x, m: x - m)
    return vectors.where(valid(column, len(model.mean))).withColumn("projected", F.array(*[dot(centred, _literal(c)) for c in model.components]))


def reconstruction_error(vectors: DataFrame, model: Pca, column: str = "vector") -> DataFrame:
    """error: mean square of what the components miss, over all numbers."""
    p = project(vectors, model, column)
    dims = len(model.mean)
    back = [F.lit(float(model.mean[i])) + sum((F.col("projected")[j] * float(c[i]) for j, c in enumerate(model.components)), F.lit(0.0)) for i in range(dims)]
    miss = sum(((F.col(column)[i] - back[i]) * (F.col(column)[i] - back[i]) for i in range(dims)), F.lit(0.0))
    return p.agg((F.sum(miss) / (F.count("*") * dims)).alias("error"))


def inverse(matrix: np.ndarray) -> np.ndarray:
    if abs(np.linalg.det(matrix)) == 0 or np.linalg.cond(matrix) > 1e14:
        raise SingularDataError("the matrix has no inverse")
    return np.linalg.inv(matrix)


def mahalanobis(x: Column, mean: np.ndarray, inv: np.ndarray) -> Column:
    """Squared distance of a vector column."""
    d = F.zip_with(x, _literal(mean), lambda a, m: a - m)
    return sum((dot(d, _literal(r)) * (x[i] - float(mean[i])) for i, r in enumerate(inv)), F.lit(0.0))


def multivariate_anomalies(vectors: DataFrame, dims: int, column: str = "vector", threshold: float = 0.8, ridge: float = 1e-6) -> DataFrame:
    """Complete vectors whose score d2 / (d2 + dims) reaches the threshold, with d2, score and causes: the two dimensions
    farthest from their means in deviations. Sample covariance with ``ridge`` on its diagonal."""
    n, mean, cov = moments(vectors, column, dims)
    cov = (cov * n / (n - 1) if n > 1 else np.zeros_like(cov)) + ridge * np.eye(dims)
    d2 = mahalanobis(F.col(column), mean, inverse(cov))
    sd = np.sqrt(np.diag(cov))
    away = F.array(*[F.struct((-F.abs(F.col(column)[i] - float(mean[i])) / float(sd[i])).alias("z"), F.lit(i).cast("long").alias("dim")) for i in range(dims)])
    out = vectors.where(valid(column, dims)).withColumn("d2", d2).withColumn("score", F.col("d2") / (F.col("d2") + dims))
    far = F.filter(F.slice(F.array_sort(away), 1, 2), lambda x: x["z"] < -1e-9)
    return out.where(F.col("score") >= threshold).withColumn("causes", F.transform(far, lambda x: x["dim"]))
