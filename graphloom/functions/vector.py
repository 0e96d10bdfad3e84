"""Vector columns, all in the JVM: dot product, norm, cosine, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fault(vector, dim: int) -> Column:
    """wrong_dim, not_finite or zero_norm, the first that holds; null for a sound vector."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.when(F.size(v) != dim, "wrong_dim").when(odd, "not_finite").when(norm(v) < 1e-6, "zero_norm")


def usual_dim(emb: DataFrame) -> int:
    """The most frequent number of dimensions, the smaller of equals; 0 without vectors."""
    row = emb.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return row["dim"] if row else 0


def sound(emb: DataFrame, dim: int | None = None) -> DataFrame:
    """The rows whose vector has `dim` dimensions (else the usual number), all finite, and a norm."""
    dim = usual_dim(emb) if dim is None else dim
    return emb.where(F.col("vector").isNotNull() & fault("vector", dim).isNull())
