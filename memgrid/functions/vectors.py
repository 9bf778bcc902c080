"""Vector arithmetic on array columns. Vectors are taken as doubles; a null vector, an empty one and a zero norm give similarity 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def normalized(v: Column, least: float = 1e-12) -> Column:
    size = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / size)


def projected(v: Column, matrix: list[list[float]]) -> Column:
    """Matrix times vector for a small literal matrix."""
    return F.array(*[dot(v, F.array(*map(F.lit, row))) for row in matrix])


def diversity(relevance: Column, closest: Column, weight: float = 0.4, first_scaled: bool = False) -> Column:
    """Maximal marginal relevance; closest is null for the first pick, whose relevance counts whole unless first_scaled."""
    first = relevance * weight if first_scaled else relevance
    return F.when(closest.isNull(), first).otherwise(weight * relevance - (1 - weight) * closest)
