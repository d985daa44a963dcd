"""Column functions on arrays and numbers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(a: Column, b: Column) -> Column:
    """True; raises where the arrays are empty, of different sizes or hold a missing number."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | F.exists(a, lambda x: x.isNull() | F.isnan(x)) | F.exists(b, lambda x: x.isNull() | F.isnan(x))
    return F.when(bad, F.raise_error(F.lit("arrays must be of one size, not empty, and without missing numbers")).cast("boolean")).otherwise(F.lit(True))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(checked(a, b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(checked(a, b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def normalised_similarity(distance: Column, scale: float = 1.0) -> Column:
    """1 / (1 + distance / scale)."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.when(distance < 0, F.raise_error(F.lit("a distance is negative")).cast("double")).otherwise(1 / (1 + distance / scale))


def cosine_similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(checked(a, b), F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / F.nullif(norm, F.lit(0.0)) + 1) / 2))))


def pearson_similarity(a: Column, b: Column) -> Column:
    """(correlation + 1) / 2; 0.5 where one is constant."""
    n = F.size(a).cast("double")
    ma, mb = _sum(a) / n, _sum(b) / n
    sab = dot(a, b) - n * ma * mb
    va, vb = dot(a, a) - n * ma * ma, dot(b, b) - n * mb * mb
    flat = (va <= 1e-12) | (vb <= 1e-12)
    r = sab / F.nullif(F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))), F.lit(0.0))
    return F.when(checked(a, b), F.when(flat, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r + 1) / 2))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of label sets: 1 if both are empty, 0 if one is."""
    u = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(u, F.lit(0)))


def safe_ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b; ``otherwise`` where b is 0 or something is null."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(otherwise))


def correlation(cov: Column, var_a: Column, var_b: Column) -> Column:
    """Correlation from population moments of the same rows, within 1; 0 where one is constant."""
    root = F.sqrt(F.greatest(var_a, F.lit(0.0)) * F.greatest(var_b, F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(cov, root)))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """0 where sd is 0, null where x is."""
    return F.when(x.isNotNull(), F.when(sd > 0, (x - mean) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))
