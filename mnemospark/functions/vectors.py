"""Vector functions as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 where they are null, empty, of unequal length or zero."""
    size = dot(left, left) * dot(right, right)
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (size > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(left, right) / F.sqrt(size)).otherwise(F.lit(0.0))


def unit(vector: Column, dimensions: Column) -> Column:
    """The vector over its length; null where it is of another width, zero, or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(dot(vector, vector))
    return F.when((F.size(vector) == dimensions) & ~bad & (length > 0), F.transform(vector, lambda x: x.cast("double") / length))


def non_zero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
