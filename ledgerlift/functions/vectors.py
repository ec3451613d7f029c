"""Vector expressions over ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(_sum_of(squares))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null when either vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms != 0.0, 1.0 - dot(a, b) / norms)


def check_dim(vector: Column, dim: int) -> Column:
    """The vector itself, or an error when its length is not ``dim``."""
    problem = F.concat(
        F.lit(f"vector length is not {dim}: "), F.coalesce(F.size(vector).cast("string"), F.lit("null"))
    )
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(problem))
