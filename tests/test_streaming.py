from pyspark.sql import functions as F

from themeforge.operators.centroids import class_centroids, class_table
from themeforge.operators.vocab import term_counts
from themeforge.operators.weights import count_profile, fit_idf, profile_stats, profile_sums, row_total
from themeforge.session import fresh_path
from themeforge.streaming.scoring import running_category_counts, score_batch, score_stream

ROWS = [(1, "a", "oil bank oil"), (2, "a", "bank oil growth"), (3, "b", "film award"), (4, "b", "film star")]


def test_stream_scores_equal_batch_scores(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, class string, text string")
    profile = count_profile(term_counts(docs, ("doc_id", "class"), ngram_range=(1, 2)), "class")
    vocabulary = fit_idf(profile_stats(profile), row_total(docs), 1).select("token", "idf")
    classes = class_table(docs)
    centroids = class_centroids(profile_sums(profile, vocabulary, "class"), classes).withColumnRenamed("class", "label")
    source, target, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    docs.select("doc_id", "text").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    query = score_stream(stream, vocabulary, centroids, classes, target, state)
    query.awaitTermination(120)
    streamed = spark.read.parquet(target).drop("batch_id")
    batch = score_batch(docs, vocabulary, centroids, classes)

    def rounded(df):
        return sorted((r["doc_id"], r["predicted"], round(r["distance"], 9)) for r in df.collect())

    assert rounded(streamed) == rounded(batch)
    assert {r["doc_id"]: r["predicted"] for r in batch.collect()} == {1: "a", 2: "a", 3: "b", 4: "b"}


def test_running_counts(spark):
    rows = [(1, ["x", "y"]), (2, ["x"]), (3, None)]
    source, state = fresh_path(spark, "in"), fresh_path(spark, "state")
    spark.createDataFrame(rows, "doc_id int, categories array<string>").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("doc_id int, categories array<string>").option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        running_category_counts(stream).writeStream.format("memory").queryName("category_counts")
        .outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert dict(map(tuple, spark.table("category_counts").select("category", F.col("n")).collect())) == {"x": 2, "y": 1}
