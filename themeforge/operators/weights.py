"""TF-IDF weights and corpus-level token scores as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_total(df: DataFrame) -> Column:
    """The number of rows of ``df`` as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def fit_idf(stats: DataFrame, n_docs: Column, min_df: int = 5) -> DataFrame:
    """(token, df, tf, idf) of tokens occurring at least ``min_df`` times in the corpus.

    idf = ln(N / (df + 1)) + 1. The cut is on occurrences (tf), not documents.
    """
    return stats.filter(F.col("tf") >= min_df).withColumn(
        "idf", F.log(n_docs / (F.col("df") + 1)) + 1
    )


def term_weight(count: Column, idf: Column, sublinear: bool = True) -> Column:
    """count * idf, or ln(count * idf + 1) when ``sublinear``."""
    product = count * idf
    return F.log(product + 1) if sublinear else product


def tf_idf(counts: DataFrame, vocabulary: DataFrame, sublinear: bool = True) -> DataFrame:
    """Replace ``c`` by ``weight``; tokens outside the vocabulary drop out.

    A task hashes its part of the vocabulary; the counts, many times as many, are not sorted.
    """
    weight = term_weight(F.col("c"), F.col("idf"), sublinear)
    return (
        counts.join(vocabulary.select("token", "idf").hint("shuffle_hash"), "token")
        .withColumn("weight", weight)
        .drop("c", "idf")
    )


def count_profile(counts: DataFrame, label: str) -> DataFrame:
    """(label, token, c, n): how many documents of a label hold a token exactly c times.

    Token statistics and per-label weight sums follow from this small table, so
    the documents are read once and never joined with the vocabulary.
    """
    return counts.groupBy(label, "token", "c").agg(F.count("*").alias("n"))


def profile_stats(profile: DataFrame) -> DataFrame:
    """(token, df, tf), equal to ``token_stats`` when each document has one label."""
    return profile.groupBy("token").agg(
        F.sum("n").alias("df"), F.sum(F.col("c") * F.col("n")).alias("tf")
    )


def profile_sums(
    profile: DataFrame, vocabulary: DataFrame, label: str, sublinear: bool = True
) -> DataFrame:
    """(label, token, weight, idf): summed TF-IDF weights of each label's documents."""
    fitted = profile.join(vocabulary.select("token", "idf"), "token")
    return fitted.groupBy(label, "token").agg(
        F.sum(F.col("n") * term_weight(F.col("c"), F.col("idf"), sublinear)).alias("weight"),
        F.first("idf").alias("idf"),
    )


def class_sums(weights: DataFrame, label: str, values: Sequence[str] = ("weight",)) -> DataFrame:
    """(label, token, values): summed document weights, combined before the shuffle."""
    return weights.groupBy(label, "token").agg(*[F.sum(v).alias(v) for v in values])


def normalise(
    weights: DataFrame, norm: str | None = "l2", key: str = "doc_id", value: str = "weight"
) -> DataFrame:
    """Divide each document's weights by their L2 or L1 norm; a zero norm gives null."""
    per_doc = W.partitionBy(key)
    w = F.col(value)
    if norm is None:
        return weights
    if norm == "l2":
        size = F.sqrt(F.sum(w * w).over(per_doc))
    elif norm == "l1":
        size = F.sum(F.abs(w)).over(per_doc)
    else:
        raise ValueError(f"unknown norm: {norm}")
    return weights.withColumn("_size", size).withColumn(
        value, F.when(F.col("_size") > 0, w / F.col("_size"))
    ).drop("_size")


def frequency_score(
    stats: DataFrame, n_docs: Column, minimum: float | None = None
) -> DataFrame:
    """Add tf = frequency / vocabulary size, idf = documents / files (no logarithm), tf_idf.

    ``stats`` comes from ``file_stats``; entries below ``minimum`` are dropped.
    """
    scored = (
        stats.withColumn("tf", F.col("frequency") / row_total(stats))
        .withColumn("idf", n_docs / F.col("count"))
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
    )
    return scored if minimum is None else scored.filter(F.col("tf_idf") >= minimum)


def batch_score(
    counts: DataFrame, n_docs: Column, batch: str, vocabulary: DataFrame | None = None
) -> DataFrame:
    """(token, tf, idf, tf_idf) from token sums per batch.

    tf = 0.5 + 0.5 * sum over batches of f_b / max_b f;
    idf = ln((documents + 1) / (batches holding the token + 1)).
    With a ``vocabulary``, its tokens that occur in no batch score tf 0.5.
    """
    per_batch = counts.groupBy("token", batch).agg(F.sum("c").alias("_f"))
    summary = per_batch.groupBy("token").agg(
        (F.sum("_f") / F.max("_f")).alias("_share"), F.count("*").alias("_batches")
    )
    if vocabulary is not None:
        summary = vocabulary.select("token").join(summary, "token", "left").na.fill(
            {"_share": 0.0, "_batches": 0}
        )
    return summary.select(
        "token",
        (0.5 + 0.5 * F.col("_share")).alias("tf"),
        F.log((n_docs + 1) / (F.col("_batches") + 1)).alias("idf"),
    ).withColumn("tf_idf", F.col("tf") * F.col("idf"))


def split_by_score(scores: DataFrame, threshold: float, value: str = "tf_idf") -> DataFrame:
    """Add ``kept``: true where the score is above the threshold, false at or below it."""
    return scores.withColumn("kept", F.col(value) > threshold)


def prune_tokens(weights: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove the dropped tokens from every document vector."""
    return weights.join(dropped.select("token"), "token", "left_anti")
