"""Learning per-class thresholds and predicting label sets with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.functions.scores import gaussian_ratio
from themeforge.functions.sets import set_loss
from themeforge.operators.ordering import group_positions


def sweep(
    scores: DataFrame,
    truth: Column,
    label: str,
    value: str,
    grid: Sequence[float],
    form: str = "second_term",
    false_positive: float = 1.0,
    false_negative: float = 1.0,
) -> DataFrame:
    """(label, threshold, loss) for every grid point.

    A row (document, label, value) predicts {label} where value > threshold and
    nothing otherwise; the loss is the mean set loss against ``truth``. Rows are
    summed by how many grid points lie below their value, so the cost does not
    grow with the grid and only a few rows per label leave the first step.
    """
    points = sorted(grid)
    label_type = scores.schema[label].dataType
    nothing = F.array().cast(f"array<{label_type.simpleString()}>")
    idle = set_loss(truth, nothing, false_positive, false_negative, form)
    chosen = set_loss(truth, F.array(F.col(label)), false_positive, false_negative, form)
    below = sum((F.coalesce(F.col(value) > p, F.lit(False)).cast("int") for p in points), F.lit(0))
    steps = scores.select(F.col(label), below.alias("b"), idle.alias("i"), (chosen - idle).alias("d"))
    steps = steps.groupBy(label, "b").agg(
        F.sum("i").alias("i"), F.sum("d").alias("d"), F.count("*").alias("m")
    )
    table = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("t"))
                      for j, p in enumerate(points)])
    cells = steps.withColumn("g", F.explode(table))
    return cells.groupBy(label, F.col("g.t").alias("threshold")).agg(
        (
            (F.sum("i") + F.sum(F.when(F.col("b") > F.col("g.j"), F.col("d")).otherwise(0.0)))
            / F.sum("m")
        ).alias("loss")
    )


def quantile_grid(scores: DataFrame, label: str, value: str, steps: int = 20) -> DataFrame:
    """(label, grid): the values at ``steps`` + 1 even quantiles of each label, smallest first.

    Exact for labels of any size: the value at quantile q of n is the one of rank ceil(q n),
    at least 1. All ranks come from one range sort of (label, value); only the rows at those
    ranks are gathered. Null values have no rank.
    """
    known = scores.select(label, value).filter(F.col(value).isNotNull())
    placed = group_positions(known, [label], [value], "_p")
    rank = F.col("_p") + 1
    at = [F.greatest(F.lit(1), F.ceil(F.lit(i / steps) * F.col("group_rows"))) for i in range(steps + 1)]
    chosen = placed.filter(reduce(or_, [rank == k for k in at]))
    return chosen.groupBy(label).agg(F.array_sort(F.collect_set(value)).alias("grid"))


def sweep_grid(
    scores: DataFrame,
    grids: DataFrame,
    truth: Column,
    label: str,
    value: str,
    form: str = "second_term",
    false_positive: float = 1.0,
    false_negative: float = 1.0,
) -> DataFrame:
    """(label, threshold, loss) as ``sweep``, with each label's own grid of thresholds."""
    label_type = scores.schema[label].dataType
    nothing = F.array().cast(f"array<{label_type.simpleString()}>")
    idle = set_loss(truth, nothing, false_positive, false_negative, form)
    chosen = set_loss(truth, F.array(F.col(label)), false_positive, false_negative, form)
    rows = scores.select(
        F.col(label), F.col(value).alias("_v"), idle.alias("i"), (chosen - idle).alias("d")
    ).join(grids.select(label, "grid"), label)
    below = F.size(F.filter("grid", lambda p: F.coalesce(F.col("_v") > p, F.lit(False))))
    steps = rows.groupBy(label, below.alias("b")).agg(
        F.sum("i").alias("i"), F.sum("d").alias("d"), F.count("*").alias("m"), F.first("grid").alias("grid")
    )
    cells = steps.select(label, "b", "i", "d", "m", F.posexplode("grid").alias("j", "threshold"))
    passed = F.sum(F.when(F.col("b") > F.col("j"), F.col("d")).otherwise(0.0))
    return cells.groupBy(label, "threshold").agg(((F.sum("i") + passed) / F.sum("m")).alias("loss"))


def best_threshold(losses: DataFrame, label: str) -> DataFrame:
    """(label, threshold, loss) with the least loss, the lowest threshold on ties."""
    best = F.min(F.struct(F.round("loss", 9).alias("loss"), F.col("threshold")))
    return losses.groupBy(label).agg(best.alias("b")).select(label, "b.threshold", "b.loss")


def predict_by_ratio(
    near: DataFrame, model: DataFrame, key: str = "doc_id", label: str = "category",
    distance: str = "distance",
) -> DataFrame:
    """(key, predicted): nearby categories whose Gaussian ratio exceeds their threshold.

    ``near`` holds at most k rows per document, ``model`` (label, variance, threshold).
    """
    scored = near.join(model.select(label, "variance", "threshold"), label)
    passed = scored.filter(gaussian_ratio(F.col(distance), F.col("variance")) > F.col("threshold"))
    return passed.groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("predicted"))


def predict_by_distance(
    near: DataFrame, model: DataFrame, key: str = "doc_id", label: str = "category",
    distance: str = "distance",
) -> DataFrame:
    """(key, predicted): nearby categories no farther than their threshold."""
    passed = near.join(model.select(label, "threshold"), label).filter(
        F.col(distance) <= F.col("threshold")
    )
    return passed.groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("predicted"))


def label_losses(
    truth: DataFrame, predicted: DataFrame, key: str = "doc_id", categories: str = "categories",
    form: str = "second_term",
) -> DataFrame:
    """(key, predicted, loss) for every document; no prediction is the empty set."""
    joined = truth.select(key, categories).join(predicted.select(key, "predicted"), key, "left")
    empty = F.array().cast("array<string>")
    full = joined.withColumn("predicted", F.coalesce("predicted", empty))
    return full.select(
        key, "predicted", set_loss(F.col(categories), F.col("predicted"), form=form).alias("loss")
    )


def loss_by_category(near: DataFrame, losses: DataFrame, key: str, label: str = "category") -> DataFrame:
    """(label, n, loss): mean document loss over the documents that have the category nearby."""
    return near.select(key, label).join(losses.select(key, "loss"), key).groupBy(label).agg(
        F.count("*").alias("n"), F.avg("loss").alias("loss")
    )
