"""Arithmetic on dense vectors held as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "array_to_vector", "vector_to_array", "dot", "norm", "euclidean", "cosine",
    "inverse_cosine", "unit", "drop_positions",
]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either norm is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def inverse_cosine(similarity: Column) -> Column:
    """1 / cosine used as a distance; +Infinity where the cosine is zero."""
    return F.when(similarity == 0, F.lit(float("inf"))).otherwise(1.0 / similarity)


def unit(a: Column) -> Column:
    """The vector divided by its Euclidean norm; null for a zero vector."""
    pair = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.element_at(
        F.transform(pair, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"]))), 1
    )


def drop_positions(vector: Column, dropped: Column) -> Column:
    """Delete the zero-based positions listed in ``dropped``."""
    return F.filter(vector, lambda _, i: ~F.array_contains(dropped, i))
