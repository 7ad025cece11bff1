"""Text categorisation on Spark: sparse TF-IDF tables, class centroids, scores and set losses."""

__version__ = "0.1.0"
