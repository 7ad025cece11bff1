"""Multi-label steps: category lists, counts, filters and anchor similarities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.operators.dense import all_scores
from themeforge.operators.ordering import group_positions


def explode_categories(
    df: DataFrame, keys: Sequence[str] = ("doc_id",), categories: str = "categories"
) -> DataFrame:
    """One row (keys, category) per occurrence; null and empty lists give none."""
    return df.select(*keys, F.explode(categories).alias("category"))


def distinct_categories(df: DataFrame, categories: str = "categories") -> DataFrame:
    return explode_categories(df, (), categories).distinct()


def count_categories(
    df: DataFrame, wanted: DataFrame | None = None, categories: str = "categories"
) -> DataFrame:
    """(category, n): occurrences, repeats within a row included.

    With a ``wanted`` list, its categories that never occur get 0 and others drop out.
    """
    counts = explode_categories(df, (), categories).groupBy("category").agg(F.count("*").alias("n"))
    if wanted is None:
        return counts
    return (
        wanted.select("category").distinct().join(counts, "category", "left").na.fill({"n": 0})
    )


def unlisted_categories(
    df: DataFrame, wanted: DataFrame, categories: str = "categories"
) -> DataFrame:
    """(category, n) of the occurrences that a ``wanted`` list leaves out."""
    return count_categories(df, None, categories).join(wanted, "category", "left_anti")


def merge_counts(
    tables: Sequence[DataFrame], positive_only: bool = False, name: str = "category"
) -> DataFrame:
    """Add up several (name, n) tables."""
    stacked = reduce(DataFrame.unionByName, tables)
    summed = stacked.groupBy(name).agg(F.sum("n").alias("n"))
    if positive_only:
        summed = summed.filter(F.col("n") > 0)
    return summed


def ids_by_category(
    df: DataFrame, key: str = "doc_id", categories: str = "categories", list_rows: int = 10_000
) -> DataFrame:
    """(category, piece, ids): the documents of each category in ascending lists.

    A category with more than ``list_rows`` documents continues in further
    pieces, so no list grows with the corpus and none is cut short.
    """
    pairs = explode_categories(df, (key,), categories).distinct()
    placed = group_positions(pairs, ["category"], [key])
    piece = F.floor(F.col("position") / list_rows).cast("int")
    return placed.groupBy("category", piece.alias("piece")).agg(
        F.sort_array(F.collect_list(key)).alias("ids")
    )


def keep_any(df: DataFrame, wanted: Sequence[str], categories: str = "categories") -> DataFrame:
    """Rows whose categories contain any of a short list; an empty list keeps nothing."""
    if not wanted:
        return df.filter(F.lit(False))
    return df.filter(F.arrays_overlap(F.col(categories), F.array(*[F.lit(w) for w in wanted])))


def keep_listed(
    df: DataFrame, wanted: DataFrame, key: str = "doc_id", categories: str = "categories"
) -> DataFrame:
    """Rows whose categories contain any entry of a category table of any size."""
    hits = explode_categories(df, (key,), categories).join(
        wanted.select("category"), "category", "left_semi"
    )
    return df.join(hits.select(key).distinct(), key, "left_semi")


def above_any(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.215, name: str = "category"
) -> DataFrame:
    """Names for which at least one of the columns is strictly above the threshold."""
    passes = reduce(lambda a, b: a | b, [F.col(c) > threshold for c in columns])
    return df.filter(passes).select(name)


def share_removed(before: DataFrame, after: DataFrame, name: str = "category") -> DataFrame:
    """One row (total, kept, removed_pct) over distinct names."""
    kept = after.select(name).distinct().agg(F.count("*")).scalar()
    return before.select(name).distinct().agg(F.count("*").alias("total")).select(
        "total",
        kept.alias("kept"),
        (100 - kept / F.col("total") * 100).alias("removed_pct"),
    )


def anchor_similarity(
    vectors: DataFrame, anchors: DataFrame, names: Sequence[str],
    key: str, vector: str, anchor: str = "anchor", measure: str = "cosine",
) -> DataFrame:
    """(key, one column per anchor): similarity of each vector to a few named anchors."""
    scores = all_scores(vectors, anchors, key, vector, anchor, vector, measure, "similarity")
    return scores.groupBy(key).pivot(anchor, list(names)).agg(F.first("similarity"))


def set_by_id(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` where an update with the same key exists, keep it elsewhere."""
    new = updates.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
