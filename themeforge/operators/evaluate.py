"""Summaries of predictions: relation matrices, histograms, spreads of accuracies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreeing(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two candidate lists are equal, order included."""
    return df.filter(F.col(left) == F.col(right))


def other_candidate(df: DataFrame, truth: str, candidates: str, out: str = "other") -> DataFrame:
    """Add the first candidate that is not the true class; rows without one drop out."""
    rest = F.array_remove(F.col(candidates), F.col(truth))
    return df.withColumn(out, F.try_element_at(rest, F.lit(1))).filter(F.col(out).isNotNull())


def relation_pairs(df: DataFrame, truth: str, other: str, classes: DataFrame, label: str) -> DataFrame:
    """(truth, other, n): co-candidate counts over all pairs of different classes, zeros included.

    ``classes`` has one row per class; the pairs are spread from its name list.
    """
    counts = df.groupBy(truth, other).agg(F.count("*").alias("n"))
    names = classes.agg(F.sort_array(F.collect_list(label))).scalar()
    grid = classes.select(F.col(label).alias(truth), F.explode(names).alias(other)).filter(
        F.col(truth) != F.col(other)
    )
    return grid.join(counts, [truth, other], "left").na.fill({"n": 0})


def relation_matrix(pairs: DataFrame, truth: str, other: str, names: Sequence[str]) -> DataFrame:
    """One row per true class, one column per other class."""
    return pairs.groupBy(truth).pivot(other, list(names)).agg(F.sum("n")).na.fill(0)


def equal_width_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n): ``bins`` equal bins between the extremes, the maximum in the last bin."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    x = F.col(value).cast("double")
    lo, hi = ends.getField("lo").cast("double"), ends.getField("hi").cast("double")
    place = F.when(lo == hi, F.lit(bins // 2 + 1)).otherwise(
        F.least(F.lit(bins), (F.floor((x - lo) / (hi - lo) * bins) + 1).cast("int"))
    )
    return df.filter(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def edge_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n): counts between consecutive edges, right-open but for the last bin."""
    x = F.col(value)
    steps = sum(((x >= e).cast("int") for e in edges), F.lit(0))
    place = F.when(x == edges[-1], F.lit(len(edges) - 1)).otherwise(steps)
    inside = (x >= edges[0]) & (x <= edges[-1])
    return df.filter(inside).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def accuracy_spread(runs: DataFrame) -> DataFrame:
    """Box-plot numbers of (scorer, accuracy) rows, one per scorer and run."""
    q = F.percentile("accuracy", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("minimum", "lower", "median", "upper", "maximum")
    return runs.groupBy("scorer").agg(
        F.count("*").alias("runs"), F.avg("accuracy").alias("mean"), q.alias("_q")
    ).select(
        "scorer", "runs", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    )
