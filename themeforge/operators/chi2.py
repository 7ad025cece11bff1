"""Chi-square association of token weights with classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.operators.ordering import group_positions, top_rows
from themeforge.session import stage


def _observed(sums: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """(token, total, label, share, observed) for every class, zero where a class lacks the token.

    Classes are spread inside each token's row, from a list with one entry per class.
    """
    by_token = sums.groupBy("token").agg(
        F.sum("weight").alias("total"),
        F.map_from_entries(F.collect_list(F.struct(label, "weight"))).alias("held"),
    )
    total_n = classes.agg(F.sum("n")).scalar()
    every = classes.withColumn("share", F.col("n") / total_n).agg(
        F.sort_array(F.collect_list(F.struct(label, "share")))
    ).scalar()
    return by_token.withColumn("k", F.explode(every)).select(
        "token", "total", f"k.{label}", "k.share",
        F.coalesce(F.try_element_at("held", F.col(f"k.{label}")), F.lit(0.0)).alias("observed"),
    )


def chi_square(
    sums: DataFrame, classes: DataFrame, label: str = "class"
) -> DataFrame:
    """(label, token, chi2) of each class against the rest.

    ``sums`` holds the summed weight per (label, token). One row for each class and token;
    ``strongest_tokens`` finds the strongest without them.
    """
    cells = _observed(sums, classes, label)
    statistic = _statistic(F.col("observed"), F.col("total"), F.col("share"))
    return cells.select(label, "token", statistic.alias("chi2"))


def _cells(sums: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """(label, token, total, share, observed) of the cells that exist."""
    total_n = classes.agg(F.sum("n")).scalar()
    shares = classes.select(label, (F.col("n") / total_n).alias("share"))
    totals = F.sum("weight").over(W.partitionBy("token"))
    known = sums.select(label, "token", F.col("weight").alias("observed"), totals.alias("total"))
    return known.join(shares, label)


def _statistic(observed: Column, total: Column, share: Column) -> Column:
    expected = share * total
    rest = total - expected
    gap = (observed - expected) * (observed - expected)
    return F.when(expected > 0, gap / expected).otherwise(0.0) + F.when(rest > 0, gap / rest).otherwise(0.0)


def _first_missing(cells: DataFrame, tokens: DataFrame, classes: DataFrame, n: int, label: str) -> DataFrame:
    """(label, token, length, total): of each class and length the ``n`` greatest totals it has not.

    ``tokens`` numbers the tokens of a length from 0 by falling total. Between two
    neighbouring numbers that a class has lie only such as it has not, so its own
    numbers, in order, show the first ones missing.
    """
    sizes = tokens.groupBy("length").agg(F.count("*").alias("size"))
    held = cells.join(tokens.select("token", "length", "place"), "token").select(label, "length", "place")
    # The end of the list closes the last gap; it also stands for classes without tokens.
    lengths = sizes.agg(F.collect_list(F.struct("length", "size"))).scalar()
    ends = classes.select(label, F.explode(lengths).alias("s")).select(
        label, F.col("s.length").alias("length"), F.col("s.size").alias("place")
    )
    own = W.partitionBy(label, "length").orderBy("place")
    gaps = held.unionByName(ends).select(
        label, "length", "place", F.coalesce(F.lag("place").over(own), F.lit(-1)).alias("before"),
        (F.row_number().over(own) - 1).alias("held"),
    )
    # Missing before this gap: the numbers up to ``before`` less those that are held.
    wanted = F.least(F.col("place") - F.col("before") - 1, n - (F.col("before") + 1 - F.col("held")))
    missing = gaps.withColumn("k", wanted).filter("k > 0").select(
        label, "length", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("k"))).alias("place")
    )
    return missing.join(tokens, ["length", "place"]).select(label, "token", "length", "total")


def strongest_tokens(
    sums: DataFrame, classes: DataFrame, n: int = 5, label: str = "class", digits: int = 9
) -> DataFrame:
    """(label, token, length, chi2, rank): the ``n`` strongest tokens per class and n-gram length.

    Equal to ``top_tokens`` over all classes and tokens, but only cells that exist are
    rows. A class without a token has the statistic total * share / (1 - share) for it, which
    grows with the total, so of these the ``n`` greatest totals are enough. Statistics
    are compared at ``digits`` places, ties by token.
    """
    length = F.size(F.split("token", " "))
    cells = stage(_cells(sums, classes, label), "chi2-cells")
    totals = cells.select("token", "total").distinct().select(
        "token", length.alias("length"), "total", (-F.round("total", digits)).alias("_by")
    )
    tokens = stage(group_positions(totals, ["length"], ["_by", "token"], "place").drop("group_rows", "_by"), "chi2-tokens")
    total_n = classes.agg(F.sum("n")).scalar()
    shares = classes.select(label, (F.col("n") / total_n).alias("share"))
    absent = _first_missing(cells, tokens, classes, n, label)
    empty = absent.join(shares.withColumnRenamed(label, "_label"), F.col(label).eqNullSafe(F.col("_label"))).select(
        label, "token", "length", _statistic(F.lit(0.0), F.col("total"), F.col("share")).alias("chi2")
    )
    present = cells.select(
        label, "token", length.alias("length"),
        _statistic(F.col("observed"), F.col("total"), F.col("share")).alias("chi2"),
    )
    both = present.unionByName(empty).withColumn("chi2", F.round("chi2", digits))
    return top_rows(both, [label, "length"], [F.desc("chi2"), F.asc("token")], n)


def top_tokens(chi2: DataFrame, n: int = 5, label: str = "class") -> DataFrame:
    """The ``n`` strongest tokens per class and n-gram length, ties by token."""
    sized = chi2.withColumn("length", F.size(F.split("token", " ")))
    return top_rows(sized, [label, "length"], [F.desc("chi2"), F.asc("token")], n)


def total_chi_square(
    sums: DataFrame, classes: DataFrame, label: str = "class"
) -> DataFrame:
    """One row (chi2): the statistic summed over all classes and tokens.

    Expectations over all cells add up to the totals, and so do the observations, hence
    the sum of (o - e)^2 / e is that of o^2 / e, over the cells that exist, less the totals.
    A single class gets an empty complementary class, which expects and adds nothing.
    """
    cells = _cells(sums, classes, label)
    expected = F.col("share") * F.col("total")
    squares = F.sum(F.when(expected > 0, F.col("observed") * F.col("observed") / expected))
    return cells.agg((squares - F.sum("observed")).alias("chi2"))
