"""Column functions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))


def normalize(a: Column) -> Column:
    """To length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def strict_cosine(a: Column, b: Column) -> Column:
    """Like ``cosine``, but a zero norm or different lengths raise an error."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.raise_error(F.lit("vectors of different lengths or without length")).cast("double"))


def negated_distance(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
