"""Vector expressions over ARRAY<DOUBLE>; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v at unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a missing or zero vector."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Cosine similarity; null for missing, unlike or zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean_vector(df, keys: list[str], vec: str, name: str):
    """The mean of the vectors of each group: partial sums by position, no group is gathered."""
    parts = df.select(*keys, F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    pairs = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return parts.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_x"]).alias(name))
