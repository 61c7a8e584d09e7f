"""Vector functions M01-M04 in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance_score(cos: Column) -> Column:
    """max(0, 1 - d / 2) of the euclidean distance d between unit vectors, four decimals."""
    d = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos))
    return F.round(F.greatest(F.lit(0.0), 1 - d / 2), 4)
