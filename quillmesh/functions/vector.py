"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 for null, empty or zero vectors and for ones of different sizes."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n), F.lit(0.0))
