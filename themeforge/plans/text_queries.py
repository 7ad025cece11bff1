"""Queries on words, vocabularies and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeforge.functions.text import line_pieces, ngrams, split_title, words
from themeforge.functions.porter import stem
from themeforge.functions.vectors import array_to_vector, vector_to_array
from themeforge.operators import vocab as V
from themeforge.operators import weights as X
from themeforge.plans.registry import (
    ONE,
    SRC,
    STOP,
    TFIDF,
    TFIDF_ONE,
    TWO,
    UNIGRAMS,
    WORD_LIST,
    articles,
    joined,
    query,
    r6,
    table,
)
from themeforge.plans.stem_sql import stem_ctes
from themeforge.session import ship_package, spread_texts, stage


@query("split_title", """
SELECT doc_id, split_part(text, chr(10), 1) AS title,
  md5(CASE WHEN split_part(text, chr(10), 1) = '' THEN text
      ELSE replace(text, split_part(text, chr(10), 1), '') END) AS body_md5
FROM documents""")
def _(spark, sf):
    docs = split_title(articles(spark, sf))
    return docs.select("doc_id", "title", F.md5("text").alias("body_md5"))


@query("words_of_documents", f"""
WITH {SRC}, {WORD_LIST} SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM wl""")
def _(spark, sf):
    w = words("text")
    return spread_texts(articles(spark, sf), "doc_id").select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5")
    )


@query("words_deleting_symbols", f"""
WITH wl AS (SELECT list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'),
  '\\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({STOP})) AS w FROM documents),
t AS (SELECT unnest(w) AS token FROM wl)
SELECT token, count(*)::BIGINT AS c FROM t GROUP BY token""")
def _(spark, sf):
    found = V.tokens(articles(spark, sf), mode="delete")
    return found.groupBy("token").agg(F.count("*").alias("c"))


@query("ngrams_of_documents", f"""
WITH {SRC}, {WORD_LIST},
g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM wl)
SELECT doc_id, len(g)::INT AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM g""")
def _(spark, sf):
    docs = spread_texts(articles(spark, sf), "doc_id")
    return docs.select("doc_id", ngrams(words("text"), 1, 3).alias("g")).select(
        "doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5")
    )


@query("stemmed_words", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}, words AS (SELECT token, count(*) AS n FROM tok GROUP BY token), {stem_ctes('words')}
SELECT stem AS token, sum(n)::BIGINT AS c FROM stems GROUP BY stem""")
def _(spark, sf):
    counts = V.token_stats(V.term_counts(articles(spark, sf)))
    ship_package(spark)
    # Every distinct word is stemmed once, after its occurrences were counted.
    return counts.groupBy(stem("token").alias("token")).agg(F.sum("tf").alias("c"))


@query("stemmed_ngrams", f"""
WITH {SRC}, {WORD_LIST}, occ AS (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM wl),
words AS (SELECT DISTINCT token, token AS n FROM occ), {stem_ctes('words')},
sw AS (SELECT doc_id, list(stem ORDER BY i) AS w FROM occ JOIN stems ON stems.n = occ.token GROUP BY doc_id),
g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM sw)
SELECT doc_id, coalesce(len(g), 0)::INT AS n_grams, md5(coalesce(array_to_string(g, '|'), '')) AS grams_md5
FROM src LEFT JOIN g USING (doc_id)""")
def _(spark, sf):
    """Words are stemmed before they are joined; the distinct words are stemmed once."""
    found = V.gram_lists(articles(spark, sf), ["doc_id"], ngram_range=(1, 2), stemming=True)
    grams = F.coalesce("_g", F.array().cast("array<string>"))
    return found.select("doc_id", F.size(grams).alias("n_grams"), F.md5(F.array_join(grams, "|")).alias("grams_md5"))


def _pieces_sql(n: int) -> str:
    return f"""
WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_split_to_array(trim(t), '\\s+') AS p FROM t),
n AS (SELECT *, unnest(range(0, greatest(1, ceil(len(p) / {n})::BIGINT))) AS piece FROM p),
s AS (SELECT doc_id, piece::INT AS piece, CASE WHEN len(p) <= {n} THEN t
  ELSE array_to_string(p[piece * {n} + 1:piece * {n} + {n}], ' ') END AS s FROM n)
SELECT doc_id, piece, md5(s) AS text_md5, length(s)::INT AS n_chars FROM s"""


def _pieces(spark, sf, n):
    pieces = articles(spark, sf).select(
        "doc_id", F.posexplode(line_pieces("text", n)).alias("piece", "t")
    )
    return pieces.select("doc_id", "piece", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("embedding_text", _pieces_sql(8000))
def _(spark, sf):
    return _pieces(spark, sf, 8000)


@query("embedding_text_in_short_pieces", _pieces_sql(500))
def _(spark, sf):
    return _pieces(spark, sf, 500)


@query("distinct_words", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS} SELECT DISTINCT token FROM tok""")
def _(spark, sf):
    return V.distinct_words(articles(spark, sf))


@query("file_word_stats", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}
SELECT token, count(DISTINCT source)::BIGINT AS "count", count(*)::BIGINT AS frequency FROM tok GROUP BY token""")
def _(spark, sf):
    return V.file_stats(articles(spark, sf))


@query("token_statistics", f"""
WITH {TWO} SELECT token, count(*)::BIGINT AS df, sum(c)::BIGINT AS tf FROM cnt GROUP BY token""")
def _(spark, sf):
    return V.token_stats(V.term_counts(articles(spark, sf), ngram_range=(1, 2)))


@query("vocabulary_ids", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}, d AS (SELECT DISTINCT token FROM tok)
SELECT token, (row_number() OVER (ORDER BY token) - 1)::BIGINT AS token_id, count(*) OVER ()::BIGINT AS output_dim FROM d""")
def _(spark, sf):
    found = V.tokens(articles(spark, sf)).select("token").distinct()
    indexed = V.index_vocabulary(found)
    return indexed.withColumn("output_dim", X.row_total(indexed))


@query("inverse_vocabulary", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}, d AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 20)
SELECT (row_number() OVER (ORDER BY token) - 1)::BIGINT AS token_id, token FROM d""")
def _(spark, sf):
    kept = V.frequent(V.file_stats(articles(spark, sf)), 20)
    return V.index_vocabulary(kept.select("token")).select("token_id", "token")


@query("frequent_vocabulary", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}
SELECT token, count(DISTINCT source)::BIGINT AS "count", count(*)::BIGINT AS frequency
FROM tok GROUP BY token HAVING count(*) >= 20""")
def _(spark, sf):
    return V.frequent(V.file_stats(articles(spark, sf)), 20)


@query("vocabulary_by_file_count", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}
SELECT token, count(DISTINCT source)::BIGINT AS "count", count(*)::BIGINT AS frequency
FROM tok GROUP BY token HAVING count(DISTINCT source) >= 3""")
def _(spark, sf):
    return V.frequent(V.file_stats(articles(spark, sf)), 3, by="count")


@query("vocabulary_lookup", f"""
WITH {ONE}, s AS (SELECT token FROM cnt GROUP BY token HAVING sum(c) >= 20),
i AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM s)
SELECT doc_id, count(*)::BIGINT AS n_known, sum(c)::BIGINT AS n_words, sum(token_id)::BIGINT AS id_sum
FROM cnt JOIN i USING (token) GROUP BY doc_id""")
def _(spark, sf):
    counts = V.term_counts(articles(spark, sf))
    kept = V.token_stats(counts).filter("tf >= 20").select("token")
    found = V.lookup(counts, V.index_vocabulary(kept))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_known"), F.sum("c").alias("n_words"), F.sum("token_id").alias("id_sum")
    )


@query("bag_of_words", f"""
WITH {ONE}, s AS (SELECT token FROM cnt GROUP BY token HAVING sum(c) >= 20),
i AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM s),
e AS (SELECT doc_id, string_agg(token_id::VARCHAR, ',' ORDER BY token_id) AS ids,
  string_agg(c::VARCHAR, ',' ORDER BY token_id) AS cs, sum(c)::BIGINT AS n FROM cnt JOIN i USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS token_ids, coalesce(cs, '') AS counts, coalesce(n, 0)::BIGINT AS n_words
FROM src LEFT JOIN e USING (doc_id)""")
def _(spark, sf):
    docs = articles(spark, sf)
    kept = V.token_stats(V.term_counts(docs)).filter("tf >= 20").select("token")
    bag = V.bag_of_words(docs, V.index_vocabulary(kept))
    return bag.select("doc_id", joined("token_ids", "token_ids"), joined("counts", "counts"), "n_words")


@query("corpus_frequency", f"""
WITH {ONE} SELECT token, sum(c)::BIGINT AS frequency FROM cnt GROUP BY token HAVING sum(c) > 0""")
def _(spark, sf):
    return V.corpus_frequency(V.term_counts(articles(spark, sf)))


@query("top_tokens_by_frequency", f"""
WITH {ONE} SELECT token, sum(c)::BIGINT AS frequency FROM cnt GROUP BY token ORDER BY frequency DESC, token LIMIT 100""")
def _(spark, sf):
    counts = V.term_counts(articles(spark, sf))
    return V.top_entries(V.corpus_frequency(counts), "frequency", "token", 100)


@query("rarest_tokens", f"""
WITH {ONE} SELECT token, sum(c)::BIGINT AS frequency FROM cnt GROUP BY token ORDER BY frequency, token LIMIT 1000""")
def _(spark, sf):
    counts = V.term_counts(articles(spark, sf))
    return V.top_entries(V.corpus_frequency(counts), "frequency", "token", 1000, ascending=True)


def _fitted(spark, sf, ngram_range=(1, 2), sublinear=True):
    docs = articles(spark, sf)
    # The texts are taken apart once: fitting and weighing read the same files.
    counts = stage(V.term_counts(docs, ("doc_id", "class"), ngram_range=ngram_range), "counts")
    vocabulary = X.fit_idf(V.token_stats(counts), X.row_total(docs))
    return X.tf_idf(counts, vocabulary, sublinear)


@query("idf_vocabulary", f"""
WITH {TFIDF} SELECT token, df::BIGINT AS df, tf::BIGINT AS tf, round(idf, 6) AS idf FROM voc""")
def _(spark, sf):
    docs = articles(spark, sf)
    counts = V.term_counts(docs, ngram_range=(1, 2))
    return X.fit_idf(V.token_stats(counts), X.row_total(docs)).withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", f"WITH {TFIDF} SELECT doc_id, token, round(weight, 6) AS weight FROM wt")
def _(spark, sf):
    return _fitted(spark, sf).select("doc_id", "token", r6("weight", "weight"))


@query("tfidf_linear_l1", f"""
WITH {TFIDF_ONE}, lin AS (SELECT doc_id, token, c * idf AS weight FROM cnt JOIN voc USING (token))
SELECT doc_id, token, round(weight / sum(abs(weight)) OVER (PARTITION BY doc_id), 6) AS weight FROM lin""")
def _(spark, sf):
    linear = _fitted(spark, sf, (1, 1), sublinear=False)
    return X.normalise(linear, "l1").select("doc_id", "token", r6("weight", "weight"))


@query("tfidf_unit_weights", f"""
WITH {TFIDF} SELECT doc_id, token,
  round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM wt""")
def _(spark, sf):
    return X.normalise(_fitted(spark, sf), "l2").select("doc_id", "token", r6("weight", "weight"))


@query("frequency_scores", f"""
WITH {SRC}, {WORD_LIST}, {UNIGRAMS}, nd AS (SELECT count(*) AS n FROM src),
s AS (SELECT token, count(DISTINCT source) AS c, count(*) AS f FROM tok GROUP BY token),
v AS (SELECT count(*) AS v FROM s)
SELECT token, round(f / v, 6) AS tf, round(n / c, 6) AS idf, round((f / v) * (n / c), 6) AS tf_idf FROM s, v, nd
WHERE (f / v) * (n / c) >= 0.1""")
def _(spark, sf):
    docs = articles(spark, sf)
    scored = X.frequency_score(V.file_stats(docs), X.row_total(docs), 0.1)
    return scored.select("token", r6("tf", "tf"), r6("idf", "idf"), r6("tf_idf", "tf_idf"))


_BATCH_SCORE = f"""{ONE}, nd AS (SELECT count(*) AS n FROM src),
b AS (SELECT token, source, sum(c) AS f FROM cnt GROUP BY token, source),
sc AS (SELECT token, 0.5::DOUBLE + 0.5::DOUBLE * (sum(f) / max(f)) AS tf, ln((any_value(n) + 1) / (count(*) + 1)) AS idf
  FROM b, nd GROUP BY token)"""


def _batch_scores(spark, sf):
    docs = articles(spark, sf)
    counts = V.term_counts(docs, ("doc_id", "source"))
    return X.batch_score(counts, X.row_total(docs), "source"), counts


@query("batch_scores", f"""
WITH {_BATCH_SCORE} SELECT token, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM sc""")
def _(spark, sf):
    scores, _counts = _batch_scores(spark, sf)
    return scores.select("token", r6("tf", "tf"), r6("idf", "idf"), r6("tf_idf", "tf_idf"))


@query("tokens_kept_by_score", f"""
WITH {_BATCH_SCORE}
SELECT round(tf * idf, 9) > 8 AS kept, count(*)::BIGINT AS n, min(token) AS first_token, max(token) AS last_token
FROM sc GROUP BY 1""")
def _(spark, sf):
    scores, _counts = _batch_scores(spark, sf)
    marked = X.split_by_score(scores.withColumn("tf_idf", F.round("tf_idf", 9)), 8)
    return marked.groupBy("kept").agg(
        F.count("*").alias("n"), F.min("token").alias("first_token"), F.max("token").alias("last_token")
    )


@query("pruned_documents", f"""
WITH {_BATCH_SCORE}
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(c)::BIGINT AS n_words FROM cnt
WHERE token NOT IN (SELECT token FROM sc WHERE round(tf * idf, 9) <= 8) GROUP BY doc_id""")
def _(spark, sf):
    scores, counts = _batch_scores(spark, sf)
    marked = X.split_by_score(scores.withColumn("tf_idf", F.round("tf_idf", 9)), 8)
    kept = X.prune_tokens(counts, marked.filter(~F.col("kept")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("c").alias("n_words"))


@query("vector_conversion", """
SELECT vec_id, label, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 6) AS first_value,
  round(embedding[len(embedding)]::DOUBLE, 6) AS last_value FROM embeddings""")
def _(spark, sf):
    packed = table(spark, sf, "embeddings").withColumn(
        "v", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    back = packed.withColumn("v", vector_to_array("v"))
    return back.select(
        "vec_id", "label", F.size("v").alias("dims"), r6(F.element_at("v", 1), "first_value"),
        r6(F.element_at("v", -1), "last_value"),
    )
