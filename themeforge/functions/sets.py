"""Losses and overlaps between two label sets held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(array: Column) -> Column:
    return F.size(array).cast("double")


def set_loss(
    truth: Column,
    predicted: Column,
    false_positive: float = 1.0,
    false_negative: float = 1.0,
    form: str = "normalized",
) -> Column:
    """Loss between the true and the predicted label set; 0 exactly when they are equal.

    ``plain``: fp * |predicted - truth| + fn * |truth - predicted|.
    ``normalized``: the plain loss over the size of the union.
    ``second_term``: fn * |truth - predicted| + fp * |predicted - truth| / |union|.
    Two empty sets give 0.
    """
    extra = false_positive * _count(F.array_except(predicted, truth))
    missing = false_negative * _count(F.array_except(truth, predicted))
    union = _count(F.array_union(truth, predicted))
    if form == "plain":
        loss = extra + missing
    elif form == "normalized":
        loss = (extra + missing) / union
    elif form == "second_term":
        loss = missing + extra / union
    else:
        raise ValueError(f"unknown form: {form}")
    return F.when(union == 0, F.lit(0.0)).otherwise(loss)


def label_recall(truth: Column, retrieved: Column) -> Column:
    """Struct (missing, found, n_found): which true labels were retrieved."""
    found = F.array_intersect(truth, retrieved)
    return F.struct(
        F.array_except(truth, retrieved).alias("missing"),
        found.alias("found"),
        F.size(found).alias("n_found"),
    )


def overlap_parts(left: Column, right: Column) -> Column:
    """Struct (only_left, shared, either) of two arrays taken as sets."""
    return F.struct(
        F.array_except(left, right).alias("only_left"),
        F.array_intersect(left, right).alias("shared"),
        F.array_union(left, right).alias("either"),
    )
