"""Shuffles, holdouts, folds and samples in a reproducible hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.operators.ordering import (
    group_positions,
    hash_cuts,
    hash_cuts_by_seed,
    order_hash,
    row_positions,
    top_rows,
)


def holdout_part(
    docs: DataFrame, key: Column | str = "doc_id", seed: int = 42, ratio: float = 0.7
) -> Column:
    """``train`` for the first floor(ratio * n) rows of the shuffle of ``docs``, else ``test``.

    Every row belongs to one of the two; rows that repeat a key stay together.
    The expression holds for any table that carries the same key.
    """
    cuts = hash_cuts(docs, key, seed, {"train": F.floor(F.lit(ratio) * F.col("n"))})
    return F.when(order_hash(key, seed) <= cuts["train"], "train").otherwise("test")


def train_runs(
    docs: DataFrame, key: Column | str, seeds: Sequence[int], ratio: float = 0.7
) -> Column:
    """The numbers of the seeds in whose shuffle a row is a ``train`` row, see ``holdout_part``."""
    cuts = hash_cuts_by_seed(docs, key, seeds, F.floor(F.lit(ratio) * F.col("n")))
    inside = [F.when(order_hash(key, seed) <= cut, F.lit(i)) for i, (seed, cut) in enumerate(zip(seeds, cuts))]
    return F.array_compact(F.array(*inside))


def holdout(
    df: DataFrame, key: Column | str = "doc_id", seed: int = 42, ratio: float = 0.7
) -> DataFrame:
    """Add ``part`` as given by ``holdout_part``."""
    return df.withColumn("part", holdout_part(df, key, seed, ratio))


def three_way(
    df: DataFrame, key: Column | str = "doc_id", seed: int = 42,
    train: float = 0.6, validation: float = 0.2,
) -> DataFrame:
    """Add ``part`` in {train, validation, test}; the held-out rows round up, as two nested splits do."""
    n = F.col("n")
    held = F.ceil((1.0 - train) * n - 1e-9)
    test = F.ceil(held * (1.0 - validation / (1.0 - train)) - 1e-9)
    cuts = hash_cuts(df, key, seed, {"train": n - held, "validation": n - test})
    h = order_hash(key, seed)
    return df.withColumn(
        "part",
        F.when(h <= cuts["train"], "train")
        .when(h <= cuts["validation"], "validation")
        .otherwise("test"),
    )


def folds(df: DataFrame, k: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Add ``fold``: position in the shuffle modulo ``k``."""
    placed = row_positions(df.withColumn("_h", order_hash(key, seed)), ["_h"], "_p")
    return placed.withColumn("fold", (F.col("_p") % k).cast("int")).drop("_h", "_p")


def head_tail(
    df: DataFrame, ratio: float = 0.85, batch: str = "batch_id", order: str = "doc_id"
) -> DataFrame:
    """Add ``part``: the first int(n * ratio) rows of each batch are head, the others tail."""
    placed = group_positions(df, [batch], [order], "_p")
    head = F.floor(F.col("group_rows") * F.lit(ratio))
    part = F.when(F.col("_p") < head, "head").otherwise("tail")
    return placed.withColumn("part", part).drop("_p", "group_rows")


def sample_per_file(
    df: DataFrame, n: int = 100, file: str = "source", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """``n`` rows of every source file in hash order, with their place in the joint shuffle.

    ``shuffle_key`` sorts the union of the samples into random order.
    """
    hashed = df.withColumn("shuffle_key", order_hash(key, seed))
    return top_rows(hashed, [file], [F.col("shuffle_key"), F.col(key)], n).drop("rank")


def sample_batches(
    df: DataFrame, ratio: float = 0.1, batch: str = "source", seed: int = 42
) -> DataFrame:
    """All rows of int(batches * ratio) whole batches chosen in hash order."""
    batches = df.select(batch).distinct()
    cuts = hash_cuts(batches, batch, seed, {"take": F.floor(F.lit(ratio) * F.col("n") + 1e-9)})
    return df.filter(order_hash(batch, seed) <= cuts["take"])
