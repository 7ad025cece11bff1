"""Class and category centroids, their norms, and the spread of own-class distances."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.operators.weights import count_profile, profile_sums


def class_table(docs: DataFrame, label: str = "class") -> DataFrame:
    """(label, n, classid): classes with their document count and zero-based id in name order.

    The window sees one row per class name, never the documents.
    """
    sizes = docs.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.withColumn("classid", (F.row_number().over(W.orderBy(label)) - 1).cast("int"))


def class_centroids(
    sums: DataFrame,
    classes: DataFrame,
    label: str = "class",
    values: tuple[str, ...] = ("weight",),
    smoothing: int = 0,
) -> DataFrame:
    """(label, token, values): mean weight per class from the (label, token) sums.

    The divisor is the class size plus ``smoothing``, so documents without
    tokens count.
    """
    sized = sums.join(classes.select(label, "n"), label)
    return sized.select(
        label, "token", *[(F.col(v) / (F.col("n") + smoothing)).alias(v) for v in values]
    )


def centroid_norms(
    centroids: DataFrame, label: str = "class", values: tuple[str, ...] = ("weight",)
) -> DataFrame:
    """(label, sq_<value>): squared Euclidean norm of each centroid."""
    return centroids.groupBy(label).agg(
        *[F.sum(F.col(v) * F.col(v)).alias(f"sq_{v}") for v in values]
    )


def unit_centroids(centroids: DataFrame, label: str = "class", value: str = "weight") -> DataFrame:
    """Scale each centroid to norm 1; an all-zero centroid becomes null."""
    norms = centroid_norms(centroids, label, (value,)).withColumnRenamed(f"sq_{value}", "_sq")
    return centroids.join(norms, label).withColumn(
        value, F.when(F.col("_sq") > 0, F.col(value) / F.sqrt("_sq"))
    ).drop("_sq")


def supported(classes: DataFrame, minimum: int = 6) -> DataFrame:
    """Keep classes with at least ``minimum`` documents."""
    return classes.filter(F.col("n") >= minimum)


def category_table(labelled: DataFrame, category: str = "category", minimum: int = 1) -> DataFrame:
    """(category, n) from one row per (document, category), cut at ``minimum`` documents."""
    return supported(labelled.groupBy(category).agg(F.count("*").alias("n")), minimum)


def category_centroids(
    counts: DataFrame,
    vocabulary: DataFrame,
    sizes: DataFrame,
    denominator: str = "n_plus_1",
    categories: str = "categories",
) -> DataFrame:
    """(category, token, weight): centroid of the documents carrying each category.

    ``counts`` are term counts that carry the category list of their document; a
    document counts once for each of its categories. Rows are spread over
    categories only up to the map-side count. ``denominator`` is ``n`` or
    ``n_plus_1``.
    """
    spread = counts.select(F.explode(categories).alias("category"), "token", "c")
    sums = profile_sums(count_profile(spread, "category"), vocabulary, "category")
    return class_centroids(
        sums, sizes, "category", smoothing={"n": 0, "n_plus_1": 1}[denominator]
    )


def variance_by_class(
    distances: DataFrame, own: Column, label: str | list[str], values: tuple[str, ...] = ("distance",)
) -> DataFrame:
    """(label, var_<value>): population variance of the distances where ``own`` holds."""
    return distances.filter(own).groupBy(*([label] if isinstance(label, str) else label)).agg(
        *[F.var_pop(v).alias(f"var_{v}") for v in values]
    )


def to_own_centroid(
    labelled: DataFrame, centroids: DataFrame, label: str, key: str = "doc_id", salts: int = 16
) -> DataFrame:
    """Join every (document, label) row with its label's row of ``centroids``.

    Each label is dealt to ``salts`` parts by a hash of the document and its centroid
    is repeated for them, so a label with a large share of the rows meets its centroid
    in many tasks; sums by label are then combined before they are shuffled.
    """
    part = F.pmod(F.xxhash64(key), F.lit(salts))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    left = labelled.withColumn("_salt", part)
    right = centroids.withColumn("_salt", parts)
    return left.join(right, [label, "_salt"]).drop("_salt")


def dense_centroids(
    vectors: DataFrame,
    label: str = "label",
    vector: str = "embedding",
    smoothing: int = 0,
    minimum: int = 1,
) -> DataFrame:
    """(label, n, centroid): element-wise mean of dense vectors by label.

    With ``smoothing`` the sum is divided by n + smoothing. The vector sums are
    merged map-side, one vector per label and task.
    """
    packed = vectors.filter(F.col(vector).isNotNull()).select(
        label, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")
    )
    means = packed.groupBy(label).agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid")
    ).filter(F.col("n") >= minimum)
    if not smoothing:
        return means
    shrink = F.col("n") / (F.col("n") + smoothing)
    pair = F.array(F.struct(F.col("centroid").alias("v"), shrink.alias("s")))
    return means.withColumn(
        "centroid",
        F.element_at(F.transform(pair, lambda p: F.transform(p["v"], lambda x: x * p["s"])), 1),
    )
