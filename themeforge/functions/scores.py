"""Scores of a distance under a class spread, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(distance: Column, variance: Column, form: str = "small_variance") -> Column:
    """Zero-mean normal density at ``distance``.

    ``small_variance`` adds 1e-10 to variances below 1e-10; ``shifted_exponent``
    adds 1e-5 to the variance in the exponent only.
    """
    if form == "small_variance":
        v = F.when(variance < 1e-10, variance + 1e-10).otherwise(variance)
        return F.exp(-0.5 * distance * distance / v) / F.sqrt(2 * math.pi * v)
    if form == "shifted_exponent":
        return F.exp(-0.5 * distance * distance / (variance + 1e-5)) / F.sqrt(2 * math.pi * variance)
    raise ValueError(f"unknown form: {form}")


def log_gaussian(distance: Column, variance: Column) -> Column:
    """Logarithm of the density, for ranking where the density underflows to zero."""
    v = F.when(variance < 1e-10, variance + 1e-10).otherwise(variance)
    return -0.5 * distance * distance / v - 0.5 * F.log(2 * math.pi * v)


def gaussian_ratio(distance: Column, variance: Column) -> Column:
    """g / (g + 1e-4) with g = exp(-(distance / (variance + 1e-4))^2 / 2)."""
    z = distance / (variance + 1e-4)
    g = F.exp(-0.5 * z * z)
    return g / (g + 1e-4)


def exponential(distance: Column, alpha: float = 0.5) -> Column:
    """exp(-alpha * distance); falls with distance, so it ranks as distance does."""
    return F.exp(-alpha * distance)
