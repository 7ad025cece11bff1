"""Word tables: counts per document, frequencies, vocabularies and their ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.functions.porter import stem
from themeforge.functions.text import ENGLISH_STOP_WORDS, ngrams, run_counts, words
from themeforge.operators.ordering import row_positions
from themeforge.session import ship_package, spread_texts, stage


def tokens(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    mode: str = "replace",
    stemming: bool = False,
) -> DataFrame:
    """One row (keys, token) per occurrence."""
    grams = gram_lists(docs, keys, text, ngram_range, stop_words, mode, stemming)
    return grams.select(*keys, F.explode("_g").alias("token"))


def gram_lists(
    docs: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    mode: str = "replace",
    stemming: bool = False,
) -> DataFrame:
    """(keys, _g): the array of n-grams of each document."""
    word_list = words(text, stop_words, mode)
    rows = spread_texts(docs.select(*keys, text), keys[0])
    if stemming:
        # Stems must be known before words are joined into n-grams.
        rows, word_list = stemmed_lists(rows.select(*keys, word_list.alias("_w")), keys), F.col("_w")
    grams = word_list if ngram_range == (1, 1) else ngrams(word_list, *ngram_range)
    return rows.select(*keys, grams.alias("_g"))


def stemmed_lists(rows: DataFrame, keys: Sequence[str], word_list: str = "_w") -> DataFrame:
    """(keys, word_list) with every word replaced by its stem.

    Only distinct words visit Python. Their stems are joined back to the occurrences and put
    in place by position. The stems are shuffled, never broadcast: how many words there are
    grows with the texts, and the file they are read from says little of their size in
    memory. Adaptive execution splits the occurrences of a frequent word.
    """
    ship_package(rows.sparkSession)
    held = stage(rows.select(*keys, word_list).withColumn("_row", F.monotonically_increasing_id()), "word-lists")
    each = held.select("_row", F.posexplode(word_list).alias("_at", "_word"))
    stems = each.select("_word").distinct().select("_word", stem("_word").alias("_stem"))
    joined = each.join(stage(stems, "stems").hint("shuffle_hash"), "_word")
    back = joined.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_stem"))).alias("_s"))
    whole = held.join(back, "_row", "left")
    empty = F.when(F.col(word_list).isNotNull(), F.array().cast("array<string>"))
    return whole.select(*keys, F.coalesce(F.col("_s._stem"), empty).alias(word_list))


def term_counts(docs: DataFrame, keys: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """(keys, token, c): how often each token occurs in each document.

    One row per document goes in, so the counts need no shuffle.
    """
    grams = gram_lists(docs, keys, **options)
    return grams.select(*keys, F.inline(run_counts(F.col("_g"))))


def distinct_words(docs: DataFrame, **options) -> DataFrame:
    """The distinct words of all texts."""
    return tokens(docs, **options).select("token").distinct()


def token_stats(counts: DataFrame) -> DataFrame:
    """(token, df, tf): documents holding the token, occurrences in all documents."""
    return counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("c").alias("tf"))


def file_stats(docs: DataFrame, file: str = "source", **options) -> DataFrame:
    """(token, count, frequency): files holding the token, occurrences in all files.

    Occurrences are summed per (token, file) first, which makes the distinct
    file count a plain count.
    """
    found = term_counts(docs, ("doc_id", file), **options)
    per_file = found.groupBy("token", file).agg(F.sum("c").alias("_f"))
    return per_file.groupBy("token").agg(
        F.count("*").alias("count"), F.sum("_f").alias("frequency")
    )


def frequent(stats: DataFrame, k: int = 20, by: str = "frequency") -> DataFrame:
    """Vocabulary entries whose ``frequency`` (or file ``count``) is at least ``k``."""
    if by not in ("frequency", "count"):
        raise ValueError(f"unknown measure: {by}")
    return stats.filter(F.col(by) >= k)


def index_vocabulary(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Add ``token_id``: the zero-based place of each distinct token in sorted order."""
    return row_positions(vocabulary, [token], "token_id")


def lookup(counts: DataFrame, indexed: DataFrame) -> DataFrame:
    """Replace tokens by their ids; tokens outside the vocabulary drop out."""
    return counts.join(indexed.select("token", "token_id"), "token").drop("token")


def bag_of_words(docs: DataFrame, indexed: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, token_ids, counts, n_words): one sparse count vector per document.

    Ids ascend. Documents without a known word keep empty vectors.
    """
    entries = lookup(term_counts(docs, (key,), **options), indexed)
    vectors = entries.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("token_id", "c"))).alias("_e"),
        F.sum("c").alias("n_words"),
    )
    return docs.select(key).join(vectors, key, "left").select(
        key,
        F.coalesce(F.col("_e.token_id"), F.array().cast("array<bigint>")).alias("token_ids"),
        F.coalesce(F.col("_e.c"), F.array().cast("array<bigint>")).alias("counts"),
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
    )


def corpus_frequency(counts: DataFrame, positive_only: bool = True) -> DataFrame:
    """(token, frequency) over the whole corpus."""
    summed = counts.groupBy("token").agg(F.sum("c").alias("frequency"))
    if positive_only:
        summed = summed.filter(F.col("frequency") > 0)
    return summed


def top_entries(table: DataFrame, value: str, name: str, n: int, ascending: bool = False) -> DataFrame:
    """The ``n`` entries with the largest (or smallest) value, ties by name."""
    order = F.asc(value) if ascending else F.desc(value)
    return table.orderBy(order, F.asc(name)).limit(n)
