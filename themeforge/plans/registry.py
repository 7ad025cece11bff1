"""Named queries over the given tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeforge.functions.text import ENGLISH_STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled articles: the class is the language, the file is the source."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("class"), "source", "text"
    )


def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a category list: language, source, quality and toxicity where known."""
    labels = table(spark, sf_dir, "labels")
    names = F.array(
        "lang", "source", F.concat(F.lit("quality_"), F.col("quality").cast("string")),
        F.concat(F.lit("toxic_"), F.col("toxic").cast("string")),
    )
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "source", "text", F.array_compact(names).alias("categories")
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a dense vector: id, categories, embedding."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return multi_label(spark, sf_dir).drop("text").join(vectors, "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def r6(column: Column | str, name: str) -> Column:
    """Doubles are compared at six places; the sum turns -0.0 into 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)


def joined(column: str, name: str) -> Column:
    """Lists are compared as text."""
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(name)


def big(column: str) -> Column:
    return F.col(column).cast("long").alias(column)


# ---- SQL building blocks -------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS if w.isalpha())

SRC = "src AS (SELECT doc_id, lang AS class, source, text FROM documents)"
WORD_LIST = f"""wl AS (SELECT doc_id, class, source, list_filter(
    string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '),
    lambda x: x <> '' AND x NOT IN ({STOP})) AS w FROM src)"""
UNIGRAMS = "tok AS (SELECT doc_id, class, source, unnest(w) AS token FROM wl)"
BIGRAMS = """tok AS (SELECT doc_id, class, source, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM wl)"""
COUNTS = """cnt AS (SELECT doc_id, class, source, token, count(*) AS c
    FROM tok GROUP BY doc_id, class, source, token)"""
ONE = ", ".join([SRC, WORD_LIST, UNIGRAMS, COUNTS])
TWO = ", ".join([SRC, WORD_LIST, BIGRAMS, COUNTS])
IDF = """nd AS (SELECT count(*) AS n FROM src),
stats AS (SELECT token, count(*) AS df, sum(c) AS tf FROM cnt GROUP BY token),
voc AS (SELECT token, df, tf, ln(n / (df + 1)) + 1 AS idf FROM stats, nd WHERE tf >= 5)"""
WEIGHTS = """wt AS (SELECT doc_id, class, source, token, ln(c * idf + 1) AS weight
    FROM cnt JOIN voc USING (token))"""
TFIDF = ", ".join([TWO, IDF, WEIGHTS])
TFIDF_ONE = ", ".join([ONE, IDF, WEIGHTS])

CATEGORIES = """cats AS (SELECT doc_id, source, list_filter(
    [lang, source, 'quality_' || quality, 'toxic_' || toxic], lambda x: x IS NOT NULL) AS categories
    FROM documents LEFT JOIN labels USING (doc_id))"""
PAIRS = "pairs AS (SELECT doc_id, source, unnest(categories) AS category FROM cats)"


def holdout_sql(seed: int = 42, ratio: float = 0.7) -> str:
    return f"""ord AS (SELECT doc_id, class, row_number() OVER (ORDER BY md5('{seed}:' || doc_id)) AS rn,
    floor({ratio}::DOUBLE * count(*) OVER ()) AS cut FROM src),
pt AS (SELECT doc_id, class, CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS part FROM ord)"""
