"""Score columns and decisions over (document, class) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.functions.scores import exponential, gaussian, log_gaussian
from themeforge.operators.ordering import top_rows


def add_scores(
    distances: DataFrame,
    variances: DataFrame,
    label: str = "label",
    distance: str = "distance",
    variance: str = "variance",
    alpha: float = 1e-3,
) -> DataFrame:
    """Add ``gauss``, ``log_gauss`` and ``expo`` to each (document, class) row.

    ``variances`` has one row per class.
    """
    joined = distances.join(variances.select(label, variance), label, "left")
    d, v = F.col(distance), F.col(variance)
    return joined.select(
        *distances.columns,
        gaussian(d, v).alias("gauss"),
        log_gaussian(d, v).alias("log_gauss"),
        exponential(d, alpha).alias("expo"),
    )


def usable(value: Column) -> Column:
    """Null and NaN are left out of every ranking."""
    return F.when(~F.isnan(value), value)


def lowest(value: Column, label: Column) -> Column:
    """Aggregate: the label with the smallest value, the first label on ties."""
    v = usable(value)
    return F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), label.alias("l")))).getField("l")


def highest(value: Column, label: Column) -> Column:
    """Aggregate: the label with the largest value, the first label on ties."""
    return lowest(-value, label)


def top_labels(
    scores: DataFrame, key: str, label: str, value: str, k: int = 2,
    largest: bool = True, out: str = "candidates",
) -> DataFrame:
    """(key, out): the ``k`` best labels of each document, best first."""
    order = F.desc(value) if largest else F.asc(value)
    ranked = top_rows(
        scores.filter(usable(F.col(value)).isNotNull()), [key], [order, F.asc(label)], k
    )
    return ranked.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", label))), lambda r: r[label]
        ).alias(out)
    )


def candidates(
    scores: DataFrame, thresholds: DataFrame, key: str, label: str, value: str,
    k: int = 2, out: str = "candidates",
) -> DataFrame:
    """The ``k`` best labels whose score exceeds their class threshold, for every document.

    Documents where no class passes get an empty list.
    """
    passing = scores.join(thresholds.select(label, "threshold"), label).filter(
        F.col(value) > F.col("threshold")
    )
    found = top_labels(passing, key, label, value, k, True, out)
    empty = F.array().cast(found.schema[out].dataType)
    return scores.select(key).distinct().join(found, key, "left").withColumn(
        out, F.coalesce(F.col(out), empty)
    )


def nth_label(
    scores: DataFrame, key: str, label: str, value: str, n: int = 2, largest: bool = False,
) -> DataFrame:
    """(key, label) of the n-th best class, such as the second closest."""
    order = F.desc(value) if largest else F.asc(value)
    usable_rows = scores.filter(usable(F.col(value)).isNotNull())
    return top_rows(usable_rows, [key], [order, F.asc(label)], n).filter(
        F.col("rank") == n
    ).drop("rank")


def accept(
    scores: DataFrame, thresholds: DataFrame, key: str, label: str, value: str
) -> DataFrame:
    """(key, predicted, accepted, decision): the best class, kept when it reaches its threshold.

    A rejected prediction has a null decision rather than the true class.
    """
    best = top_rows(
        scores.filter(usable(F.col(value)).isNotNull()), [key],
        [F.desc(value), F.asc(label)], 1,
    )
    judged = best.join(thresholds.select(label, "threshold"), label, "left").withColumn(
        "accepted", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False))
    )
    return judged.select(
        key, F.col(label).alias("predicted"), "accepted",
        F.when(F.col("accepted"), F.col(label)).alias("decision"),
    )


def accuracy(predictions: DataFrame, truth: str, predicted: list[str]) -> DataFrame:
    """(scorer, n, accuracy): the share of rows where each prediction column equals the truth."""
    counted = predictions.agg(
        F.count("*").alias("n"),
        *[F.avg(F.coalesce(F.col(p) == F.col(truth), F.lit(False)).cast("int")).alias(p)
          for p in predicted],
    )
    return counted.unpivot(["n"], predicted, "scorer", "accuracy")
