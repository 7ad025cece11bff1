"""Queries on multi-label documents: categories, category models, thresholds, label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeforge.functions.scores import gaussian_ratio
from themeforge.functions.sets import label_recall, overlap_parts, set_loss
from themeforge.functions.vectors import euclidean
from themeforge.operators import centroids as C
from themeforge.operators import evaluate as E
from themeforge.operators import labels as L
from themeforge.operators import thresholds as T
from themeforge.operators.dense import nearest
from themeforge.operators.similarity import own_distances
from themeforge.operators.splits import head_tail
from themeforge.operators.vocab import corpus_frequency, term_counts, token_stats, top_entries
from themeforge.operators.weights import fit_idf, row_total, tf_idf
from themeforge.plans.registry import (
    CATEGORIES,
    ONE,
    PAIRS,
    TFIDF_ONE,
    articles,
    embedded,
    joined,
    multi_label,
    query,
    r6,
    table,
)
from themeforge.session import stage

_LISTED = "('en', 'es', 'src3', 'src7', 'toxic_1', 'quality_0', 'src999')"


def _listed(spark):
    names = ["en", "es", "src3", "src7", "toxic_1", "quality_0", "src999"]
    return spark.createDataFrame([(n,) for n in names], "category string")


@query("distinct_categories", f"WITH {CATEGORIES}, {PAIRS} SELECT DISTINCT category FROM pairs")
def _(spark, sf):
    return L.distinct_categories(multi_label(spark, sf))


@query("category_counts", f"""
WITH {CATEGORIES}, {PAIRS} SELECT category, count(*)::BIGINT AS n FROM pairs GROUP BY category""")
def _(spark, sf):
    return L.count_categories(multi_label(spark, sf))


@query("listed_category_counts", f"""
WITH {CATEGORIES}, {PAIRS}, want AS (SELECT unnest([{_LISTED[1:-1]}]) AS category)
SELECT want.category, count(pairs.category)::BIGINT AS n FROM want LEFT JOIN pairs USING (category) GROUP BY want.category""")
def _(spark, sf):
    return L.count_categories(multi_label(spark, sf), _listed(spark))


@query("unlisted_category_counts", f"""
WITH {CATEGORIES}, {PAIRS} SELECT category, count(*)::BIGINT AS n FROM pairs
WHERE category NOT IN {_LISTED} GROUP BY category""")
def _(spark, sf):
    return L.unlisted_categories(multi_label(spark, sf), _listed(spark))


@query("top_categories", f"""
WITH {CATEGORIES}, {PAIRS} SELECT category, count(*)::BIGINT AS n FROM pairs GROUP BY category
ORDER BY n DESC, category LIMIT 10""")
def _(spark, sf):
    return top_entries(L.count_categories(multi_label(spark, sf)), "n", "category", 10)


@query("merged_category_counts", f"""
WITH {CATEGORIES}, {PAIRS}, p AS (SELECT unnest(string_split(p_name, ' ')) AS category FROM part),
m AS (SELECT category, count(*) AS n FROM pairs GROUP BY category UNION ALL SELECT category, count(*) FROM p GROUP BY category
  UNION ALL SELECT category, -count(*) FROM p WHERE category = 'ring' GROUP BY category)
SELECT category, sum(n)::BIGINT AS n FROM m GROUP BY category HAVING sum(n) > 0""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.split("p_name", " ").alias("categories"))
    documents, names = L.count_categories(multi_label(spark, sf)), L.count_categories(parts)
    removed = names.filter("category = 'ring'").withColumn("n", -F.col("n"))
    return L.merge_counts([documents, names, removed], positive_only=True)


@query("documents_by_category", f"""
WITH {CATEGORIES}, {PAIRS}, o AS (SELECT category, doc_id,
  floor((row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1) / 100)::INT AS piece FROM pairs)
SELECT category, piece, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM o GROUP BY category, piece""")
def _(spark, sf):
    found = L.ids_by_category(multi_label(spark, sf), list_rows=100)
    return found.select("category", "piece", joined("ids", "ids"))


@query("documents_with_any_category", f"""
WITH {CATEGORIES} SELECT doc_id, source FROM cats WHERE list_has_any(categories, ['es', 'src3', 'toxic_1'])""")
def _(spark, sf):
    return L.keep_any(multi_label(spark, sf), ["es", "src3", "toxic_1"]).select("doc_id", "source")


@query("documents_with_frequent_category", f"""
WITH {CATEGORIES}, {PAIRS}, k AS (SELECT category FROM pairs GROUP BY category HAVING count(*) BETWEEN 6 AND 150)
SELECT DISTINCT doc_id, source FROM pairs WHERE category IN (SELECT category FROM k)""")
def _(spark, sf):
    docs = multi_label(spark, sf)
    wanted = L.count_categories(docs).filter(F.col("n").between(6, 150))
    return L.keep_listed(docs, wanted).select("doc_id", "source")


@query("supported_categories", f"""
WITH {CATEGORIES}, {PAIRS} SELECT category, count(*)::BIGINT AS n FROM pairs GROUP BY category HAVING count(*) >= 6""")
def _(spark, sf):
    return C.category_table(L.explode_categories(multi_label(spark, sf)), minimum=6)


@query("category_histogram", """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS category FROM part),
n AS (SELECT category, count(*) AS n FROM w GROUP BY category),
e AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM n)
SELECT (CASE WHEN lo = hi THEN 16 ELSE least(30, floor((n - lo) / (hi - lo) * 30) + 1) END)::INT AS bin, count(*)::BIGINT AS n
FROM n, e GROUP BY 1""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.split("p_name", " ").alias("categories"))
    return E.equal_width_histogram(L.count_categories(parts), "n", 30)


_EDGES = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1_000, 10_000, 100_000, 1_000_000_000)


@query("word_frequency_histogram", f"""
WITH {ONE}, f AS (SELECT token, sum(c) AS n FROM cnt GROUP BY token)
SELECT (list_sum(list_transform({list(_EDGES)}, lambda e: (n >= e)::INT)))::INT AS bin, count(*)::BIGINT AS n FROM f GROUP BY 1""")
def _(spark, sf):
    """How many words occur once, two to four times, and so on."""
    frequency = corpus_frequency(term_counts(articles(spark, sf)))
    return E.edge_histogram(frequency, "frequency", _EDGES)


# ---- sparse category model -----------------------------------------------------------

_MODEL = f"""{TFIDF_ONE}, {CATEGORIES}, hp AS (SELECT doc_id, source AS s2, categories,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 < floor(count(*) OVER (PARTITION BY source) * 0.85::DOUBLE) AS head
  FROM cats),
pairs AS (SELECT doc_id, unnest(categories) AS category FROM hp WHERE head),
ct AS (SELECT category, count(*) AS n FROM pairs GROUP BY category HAVING count(*) >= 6),
cen AS (SELECT category, token, sum(weight) / (any_value(n) + 1) AS v
  FROM wt JOIN pairs USING (doc_id) JOIN ct USING (category) GROUP BY category, token)"""


def _sparse_model(spark, sf):
    """Head counts with their category lists, vocabulary, head labels, and centroids."""
    docs = multi_label(spark, sf)
    # The text is tokenised once; splits and models read ids, categories and counts.
    all_counts = stage(term_counts(table(spark, sf, "documents"), ("doc_id",)), "counts")
    vocabulary = stage(fit_idf(token_stats(all_counts), row_total(docs)), "vocabulary")
    split = head_tail(docs.select("doc_id", "source", "categories"), 0.85, "source", "doc_id")
    head = stage(split.filter(F.col("part") == "head").select("doc_id", "categories"), "head")
    labelled = L.explode_categories(head)
    sizes = C.category_table(labelled, minimum=6)
    counts = all_counts.join(head, "doc_id")
    return counts, vocabulary, labelled, C.category_centroids(counts, vocabulary, sizes)


@query("category_centroids", f"""
WITH {_MODEL} SELECT category, count(*)::BIGINT AS n_tokens, round(sum(v), 6) AS total,
  round(sqrt(sum(v * v)), 6) AS norm FROM cen GROUP BY category""")
def _(spark, sf):
    *_rest, centroids = _sparse_model(spark, sf)
    return centroids.groupBy("category").agg(
        F.count("*").alias("n_tokens"), r6(F.sum("weight"), "total"),
        r6(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), "norm"),
    )


@query("category_variances", f"""
WITH {_MODEL}, csq AS (SELECT category, sum(v * v) AS c FROM cen GROUP BY category),
dsq AS (SELECT doc_id, sum(weight * weight) AS d FROM wt GROUP BY doc_id),
dots AS (SELECT doc_id, category, sum(weight * v) AS x FROM wt JOIN pairs USING (doc_id) JOIN cen USING (category, token)
  GROUP BY doc_id, category),
dist AS (SELECT doc_id, category, sqrt(greatest(0, coalesce(d, 0) - 2 * coalesce(x, 0) + c)) AS distance
  FROM pairs JOIN csq USING (category) LEFT JOIN dsq USING (doc_id) LEFT JOIN dots USING (doc_id, category))
SELECT category, count(*)::BIGINT AS n, round(var_pop(distance), 6) AS variance FROM dist GROUP BY category""")
def _(spark, sf):
    counts, vocabulary, labelled, centroids = _sparse_model(spark, sf)
    weights = tf_idf(counts, vocabulary)
    distances = own_distances(weights, labelled, stage(centroids, "centroids"))
    return distances.groupBy("category").agg(
        F.count("*").alias("n"), r6(F.var_pop("distance"), "variance")
    )


# ---- dense category model ------------------------------------------------------------

_DENSE = f"""{CATEGORIES}, ed AS (SELECT doc_id, source, categories, embedding FROM cats JOIN embeddings ON vec_id = doc_id),
hd AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1
  < floor(count(*) OVER (PARTITION BY source) * 0.85::DOUBLE) AS head FROM ed),
lx AS (SELECT doc_id, unnest(categories) AS category, embedding FROM hd WHERE head),
ct AS (SELECT category, count(*) AS n FROM lx GROUP BY category HAVING count(*) > 5),
el AS (SELECT category, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i
  FROM lx JOIN ct USING (category)),
cv AS (SELECT category, i, sum(x) / (count(*) + 1) AS x FROM el GROUP BY category, i),
cm AS (SELECT category, array_agg(x ORDER BY i) AS centroid FROM cv GROUP BY category),
vr AS (SELECT category, var_pop(list_distance(embedding::DOUBLE[], centroid)) AS variance
  FROM lx JOIN cm USING (category) GROUP BY category)"""


def _dense_model(spark, sf):
    """Split vectors, their head labels, and the model (category, n, centroid, variance)."""
    split = stage(head_tail(embedded(spark, sf), 0.85, "source", "doc_id"), "embedded")
    labelled = split.filter(F.col("part") == "head").select(
        "doc_id", F.explode("categories").alias("category"), "embedding"
    )
    centroids = stage(C.dense_centroids(labelled, "category", smoothing=1, minimum=6), "centroids")
    own = C.to_own_centroid(labelled, centroids, "category").select(
        "category", euclidean(F.col("embedding"), F.col("centroid")).alias("distance")
    )
    variances = own.groupBy("category").agg(F.var_pop("distance").alias("variance"))
    return split, labelled, stage(centroids.join(variances, "category"), "model")


@query("dense_category_model", f"""
WITH {_DENSE} SELECT category, n::BIGINT AS n, round(centroid[1], 6) AS first_value,
  round(list_inner_product(centroid, centroid), 6) AS sq_norm, round(variance, 6) AS variance
FROM cm JOIN ct USING (category) JOIN vr USING (category)""")
def _(spark, sf):
    *_rest, model = _dense_model(spark, sf)
    sq = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    return model.select(
        "category", "n", r6(F.col("centroid")[0], "first_value"), r6(sq, "sq_norm"),
        r6("variance", "variance"),
    )


@query("categories_outside_model", f"""
WITH {_DENSE}, a AS (SELECT DISTINCT unnest(categories) AS category FROM ed)
SELECT category, category IN (SELECT category FROM ct) AS in_model FROM a""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    every = L.distinct_categories(split)
    inside = every.join(model.select("category"), "category", "left_semi")
    outside = every.join(model.select("category"), "category", "left_anti")
    return inside.withColumn("in_model", F.lit(True)).unionByName(
        outside.withColumn("in_model", F.lit(False))
    )


def _near_sql(k: int, part: str) -> str:
    return f"""nr AS (SELECT doc_id, categories, category, list_distance(embedding::DOUBLE[], centroid) AS distance,
  row_number() OVER (PARTITION BY doc_id ORDER BY round(list_distance(embedding::DOUBLE[], centroid), 12), category) AS k
  FROM hd CROSS JOIN cm WHERE {part} QUALIFY k <= {k})"""


def _near(split, model, k: int, part: str):
    docs = split.filter(F.col("part") == part)
    return nearest(docs, model, k, "doc_id", "embedding", "category", "centroid")


@query("nearest_categories", f"""
WITH {_DENSE}, {_near_sql(10, 'NOT head')}
SELECT doc_id, category, round(distance, 6) AS distance, k::INT AS rank FROM nr""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    return _near(split, model, 10, "tail").select(
        "doc_id", "category", r6("distance", "distance"), "rank"
    )


@query("label_recall", f"""
WITH {_DENSE}, {_near_sql(10, 'NOT head')}, g AS (SELECT doc_id, any_value(categories) AS c, array_agg(category) AS f FROM nr GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(f, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(c, lambda x: list_contains(f, x))), ',') AS found,
  len(list_filter(c, lambda x: list_contains(f, x)))::INT AS n_found FROM g""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    lists = _near(split, model, 10, "tail").groupBy("doc_id").agg(F.collect_list("category").alias("f"))
    both = split.select("doc_id", "categories").join(lists, "doc_id")
    both = both.select("doc_id", label_recall(F.col("categories"), F.col("f")).alias("r"))
    return both.select(
        "doc_id", F.array_join(F.sort_array("r.missing"), ",").alias("missing"),
        F.array_join(F.sort_array("r.found"), ",").alias("found"), "r.n_found",
    )


@query("gaussian_ratio_scores", f"""
WITH {_DENSE}, {_near_sql(10, 'NOT head')}, g AS (SELECT doc_id, category, exp(-0.5 * (distance / (variance + 1e-4)) ** 2) AS g
  FROM nr JOIN vr USING (category)) SELECT doc_id, category, round(g / (g + 1e-4), 6) AS score FROM g""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    near = _near(split, model, 10, "tail").join(model.select("category", "variance"), "category")
    score = gaussian_ratio(F.col("distance"), F.col("variance"))
    return near.select("doc_id", "category", r6(score, "score"))


_STEPS = tuple(round(0.05 * i, 2) for i in range(16))
_LEARN_NEAR, _PREDICT_NEAR, _RATIO = 500, 50, 0.5
_SET_SWEEP = f"""{_near_sql(_LEARN_NEAR, 'head')},
g AS (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in _STEPS)}]) AS threshold),
gr AS (SELECT doc_id, categories, category, exp(-0.5 * (distance / (variance + 1e-4)) ** 2) AS g
  FROM nr JOIN vr USING (category)),
sc AS (SELECT doc_id, categories, category, round(g / (g + 1e-4), 9) AS s FROM gr),
ls AS (SELECT category, threshold, CASE WHEN s > threshold THEN
  CASE WHEN list_contains(categories, category) THEN len(categories) - 1.0::DOUBLE
    ELSE len(categories) + 1.0::DOUBLE / (len(categories) + 1) END
  ELSE len(categories) END AS loss FROM sc CROSS JOIN g),
lo AS (SELECT category, threshold, avg(loss) AS loss FROM ls GROUP BY category, threshold),
th AS (SELECT category, arg_min(threshold, (round(loss, 9), threshold)) AS threshold FROM lo GROUP BY category)"""


def _category_thresholds(split, model, near_categories=_LEARN_NEAR):
    near = _near(split, model, near_categories, "head").join(
        model.select("category", "variance"), "category"
    )
    ratio = F.round(gaussian_ratio(F.col("distance"), F.col("variance")), 9)
    scored = near.join(split.select("doc_id", "categories"), "doc_id").select(
        "categories", "category", ratio.alias("s")
    )
    return T.sweep(scored, F.col("categories"), "category", "s", _STEPS)


@query("category_threshold_losses", f"""
WITH {_DENSE}, {_SET_SWEEP} SELECT category, threshold, round(loss, 6) AS loss FROM lo""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    return _category_thresholds(split, model).select("category", "threshold", r6("loss", "loss"))


@query("category_thresholds", f"WITH {_DENSE}, {_SET_SWEEP} SELECT category, threshold FROM th")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    return T.best_threshold(_category_thresholds(split, model), "category").select(
        "category", "threshold"
    )


_SET_LOSS = """ev AS (SELECT h.doc_id, h.categories AS c, coalesce(p.predicted, []) AS p FROM hd h
  LEFT JOIN pd p ON p.doc_id = h.doc_id WHERE NOT head),
el2 AS (SELECT doc_id, p, len(list_filter(c, lambda x: NOT list_contains(p, x)))::DOUBLE AS miss,
  len(list_filter(p, lambda x: NOT list_contains(c, x)))::DOUBLE AS extra, len(list_distinct(list_concat(c, p))) AS u FROM ev),
ll AS (SELECT doc_id, array_to_string(p, ',') AS predicted, CASE WHEN u = 0 THEN 0 ELSE miss + extra / u END AS loss FROM el2)"""


@query("label_sets_by_ratio", f"""
WITH {_DENSE}, {_near_sql(_PREDICT_NEAR, 'NOT head')},
g AS (SELECT doc_id, category, exp(-0.5 * (distance / (variance + 1e-4)) ** 2) AS g FROM nr JOIN vr USING (category)),
pd AS (SELECT doc_id, list_sort(array_agg(category)) AS predicted FROM g WHERE g / (g + 1e-4) > {_RATIO} GROUP BY doc_id),
{_SET_LOSS} SELECT doc_id, predicted, round(loss, 6) AS loss FROM ll""")
def _(spark, sf):
    split, _labelled, model = _dense_model(spark, sf)
    limits = model.select("category", "variance", F.lit(_RATIO).alias("threshold"))
    predicted = T.predict_by_ratio(_near(split, model, _PREDICT_NEAR, "tail"), limits)
    tail = split.filter(F.col("part") == "tail")
    return T.label_losses(tail, predicted).select("doc_id", joined("predicted", "predicted"), r6("loss", "loss"))


_BY_DISTANCE = f"""{_near_sql(1000, 'NOT head')},
cut AS (SELECT category, avg(list_distance(embedding::DOUBLE[], centroid)) AS threshold FROM lx JOIN cm USING (category) GROUP BY category),
pd AS (SELECT doc_id, list_sort(array_agg(category)) AS predicted FROM nr JOIN cut USING (category)
  WHERE distance <= threshold GROUP BY doc_id), {_SET_LOSS}"""


def _by_distance(spark, sf):
    split, labelled, model = _dense_model(spark, sf)
    cuts = C.to_own_centroid(labelled, model, "category").groupBy("category").agg(
        F.avg(euclidean(F.col("embedding"), F.col("centroid"))).alias("threshold")
    )
    near = _near(split, model, 1000, "tail")
    predicted = T.predict_by_distance(near, cuts)
    return near, T.label_losses(split.filter(F.col("part") == "tail"), predicted)


@query("label_sets_by_distance", f"""
WITH {_DENSE}, {_BY_DISTANCE} SELECT doc_id, predicted, round(loss, 6) AS loss FROM ll""")
def _(spark, sf):
    _near_rows, losses = _by_distance(spark, sf)
    return losses.select("doc_id", joined("predicted", "predicted"), r6("loss", "loss"))


@query("loss_by_category", f"""
WITH {_DENSE}, {_BY_DISTANCE}
SELECT category, count(*)::BIGINT AS n, round(avg(loss), 6) AS loss FROM nr JOIN ll USING (doc_id) GROUP BY category""")
def _(spark, sf):
    near, losses = _by_distance(spark, sf)
    return T.loss_by_category(near, losses, "doc_id").select("category", "n", r6("loss", "loss"))


# ---- set arithmetic ------------------------------------------------------------------

_SETS = f"""{CATEGORIES}, w AS (SELECT p_partkey AS doc_id, string_split(p_name || ' ' || lower(p_type), ' ') AS b FROM part),
s AS (SELECT doc_id, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ' || lower(p_brand) || ' '
  || split_part(p_name, ' ', 1), ' ')) AS b FROM part JOIN w ON doc_id = p_partkey),
m AS (SELECT doc_id, a, b, len(list_filter(a, lambda x: NOT list_contains(b, x)))::DOUBLE AS miss,
  len(list_filter(b, lambda x: NOT list_contains(a, x)))::DOUBLE AS extra,
  len(list_distinct(list_concat(a, b)))::DOUBLE AS u FROM s)"""


def _part_sets(spark, sf):
    brand = F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"), F.substring_index("p_name", " ", 1))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("a"),
        F.array_distinct(F.split(brand, " ")).alias("b"),
    )


@query("set_losses", f"""
WITH {_SETS} SELECT doc_id, round(miss + extra, 6) AS plain, round((miss * 2 + extra) / u, 6) AS normalized,
  round(miss + extra / u, 6) AS second_term FROM m""")
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _part_sets(spark, sf).select(
        "doc_id", r6(set_loss(a, b, form="plain"), "plain"),
        r6(set_loss(a, b, 1.0, 2.0, "normalized"), "normalized"),
        r6(set_loss(a, b, form="second_term"), "second_term"),
    )


@query("set_parts", f"""
WITH {_SETS} SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_left,
  array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS shared,
  array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either FROM m""")
def _(spark, sf):
    parts = _part_sets(spark, sf).select("doc_id", overlap_parts(F.col("a"), F.col("b")).alias("p"))
    return parts.select(
        "doc_id", *[F.array_join(F.sort_array(f"p.{n}"), ",").alias(n) for n in ("only_left", "shared", "either")]
    )


@query("union_of_lists", f"""
WITH {CATEGORIES}, {PAIRS} SELECT category FROM pairs UNION SELECT unnest(string_split(p_name, ' ')) FROM part
UNION SELECT lower(n_name) FROM nation""")
def _(spark, sf):
    documents = L.distinct_categories(multi_label(spark, sf))
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("category"))
    nations = table(spark, sf, "nation").select(F.lower("n_name").alias("category"))
    return documents.unionByName(names).unionByName(nations).distinct()
