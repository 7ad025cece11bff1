"""The batch operators on streamed documents.

Both functions are additions for convenience: they reuse the batch definitions
and keep no state of their own beyond a running count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from themeforge.operators.labels import explode_categories
from themeforge.operators.scoring import lowest
from themeforge.operators.vocab import term_counts
from themeforge.operators.weights import tf_idf
from themeforge.plans.holdout import CentroidModel, centroid_distances, centroid_model


def score_batch(
    docs: DataFrame, vocabulary: DataFrame, centroids: DataFrame, classes: DataFrame,
    model: CentroidModel | None = None,
) -> DataFrame:
    """(doc_id, predicted, distance): the nearest saved centroid of each document.

    ``vocabulary`` is (token, idf), ``centroids`` (label, token, weight), ``classes`` (class);
    ``model`` is their layout, if it was made before.
    """
    weights = tf_idf(term_counts(docs, ngram_range=(1, 2)), vocabulary)
    distances = centroid_distances(
        docs.select("doc_id"), weights, centroids, classes, ("raw",), model
    )
    return distances.groupBy("doc_id").agg(
        lowest(F.col("raw_distance"), F.col("label")).alias("predicted"),
        F.min("raw_distance").alias("distance"),
    )


def score_stream(
    docs: DataFrame, vocabulary: DataFrame, centroids: DataFrame, classes: DataFrame,
    target: str, checkpoint: str, **trigger,
) -> StreamingQuery:
    """Score each micro-batch of (doc_id, text) against a saved model, Parquet per batch id.

    A replayed batch overwrites its own folder, so results appear once. The model is
    laid out once, before the first batch.
    """
    model = centroid_model(centroids, classes, ("raw",), staged=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(batch, vocabulary, centroids, classes, model)
        scored.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_category_counts(docs: DataFrame, categories: str = "categories") -> DataFrame:
    """(category, n) so far, for a writer in update or complete mode."""
    return explode_categories(docs, (), categories).groupBy("category").agg(F.count("*").alias("n"))
