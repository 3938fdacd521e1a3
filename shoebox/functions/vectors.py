"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shoebox.functions.scalar import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; null if either is null or the lengths differ, 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(F.size(col(a)) == F.size(col(b)), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))
