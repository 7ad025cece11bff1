"""Queries on splits, class centroids, scores, decisions and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from themeforge.operators import centroids as C
from themeforge.operators import chi2 as K
from themeforge.operators import evaluate as E
from themeforge.operators import scoring as S
from themeforge.operators import splits as P
from themeforge.operators import thresholds as T
from themeforge.operators.vocab import term_counts, token_stats
from themeforge.operators.weights import (
    class_sums,
    count_profile,
    fit_idf,
    normalise,
    profile_stats,
    profile_sums,
    row_total,
    tf_idf,
)
from themeforge.plans import holdout as H
from themeforge.plans.registry import (
    SRC,
    TFIDF,
    TWO,
    WEIGHTS,
    articles,
    holdout_sql,
    joined,
    query,
    r6,
    table,
)
from themeforge.session import stage, unstage

# ---- splits and samples --------------------------------------------------------------


@query("holdout_split", f"WITH {SRC}, {holdout_sql()} SELECT doc_id, part FROM pt")
def _(spark, sf):
    return P.holdout(articles(spark, sf)).select("doc_id", "part")


@query("three_way_split", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn, count(*) OVER () AS n FROM documents),
c AS (SELECT doc_id, rn, n, ceil(0.4::DOUBLE * n - 1e-9) AS held FROM o)
SELECT doc_id, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - ceil(held * 0.5::DOUBLE - 1e-9) THEN 'validation'
  ELSE 'test' END AS part FROM c""")
def _(spark, sf):
    return P.three_way(articles(spark, sf)).select("doc_id", "part")


@query("sample_rows_per_file", """
WITH o AS (SELECT doc_id, source, md5('42:' || doc_id) AS shuffle_key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffle_key) AS k FROM o)
SELECT doc_id, source, shuffle_key FROM r WHERE k <= 100""")
def _(spark, sf):
    return P.sample_per_file(articles(spark, sf), 100).select("doc_id", "source", "shuffle_key")


@query("sample_whole_batches", """
WITH b AS (SELECT DISTINCT source FROM documents),
o AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source)) AS k, count(*) OVER () AS n FROM b)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM o WHERE k <= floor(0.1::DOUBLE * n + 1e-9))""")
def _(spark, sf):
    return P.sample_batches(articles(spark, sf), 0.1).select("doc_id", "source")


@query("folds", """
SELECT doc_id, ((row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1) % 5)::INT AS fold FROM documents""")
def _(spark, sf):
    return P.folds(articles(spark, sf).select("doc_id"), 5)


@query("head_tail_split", """
WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN p < floor(n * 0.85::DOUBLE) THEN 'head' ELSE 'tail' END AS part FROM o""")
def _(spark, sf):
    docs = articles(spark, sf).select("doc_id", "source")
    return P.head_tail(docs, 0.85, "source", "doc_id").select("doc_id", "source", "part")


# ---- chi-square ----------------------------------------------------------------------


def _sums(spark, sf):
    """Classes and the summed raw weights per (class, token), from one pass over the text."""
    docs = articles(spark, sf)
    # Sums of no class are not asked for; dropped here, both uses of the profile are one.
    known = docs.filter(F.col("class").isNotNull())
    profile = count_profile(term_counts(known, ("doc_id", "class"), ngram_range=(1, 2)), "class")
    vocabulary = fit_idf(profile_stats(profile), row_total(docs))
    return C.class_table(docs), profile_sums(profile, vocabulary, "class")


def _unit_sums(spark, sf):
    docs = articles(spark, sf)
    counts = stage(term_counts(docs, ("doc_id", "class"), ngram_range=(1, 2)), "counts")
    weights = tf_idf(counts, fit_idf(token_stats(counts), row_total(docs)))
    return C.class_table(docs), class_sums(normalise(weights), "class")


_CHI2 = """cls AS (SELECT class, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM src GROUP BY class),
tot AS (SELECT token, sum(weight) AS total FROM {w} GROUP BY token),
ob AS (SELECT class, token, sum(weight) AS o FROM {w} GROUP BY class, token),
cell AS (SELECT cls.class, token, share * total AS e, total, coalesce(o, 0) AS o
  FROM cls CROSS JOIN tot LEFT JOIN ob USING (class, token)),
chi AS (SELECT class, token, (o - e) ** 2 / e + CASE WHEN total - e > 0 THEN (o - e) ** 2 / (total - e) ELSE 0 END AS chi2
  FROM cell)"""
_UNIT = "un AS (SELECT doc_id, class, token, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM wt)"


@query("chi_square_by_class", f"""
WITH {TFIDF}, {_CHI2.format(w='wt')} SELECT class, token, round(chi2, 6) AS chi2 FROM chi""")
def _(spark, sf):
    classes, sums = _sums(spark, sf)
    return K.chi_square(sums, classes).select("class", "token", r6("chi2", "chi2"))


_TOP = """r AS (SELECT class, token, len(string_split(token, ' '))::INT AS length, round(chi2, 9) AS chi2 FROM chi),
t AS (SELECT *, row_number() OVER (PARTITION BY class, length ORDER BY chi2 DESC, token)::INT AS rank FROM r)
SELECT class, token, length, rank, round(chi2, 6) AS chi2 FROM t WHERE rank <= 5"""


@query("top_chi_square_tokens", f"WITH {TFIDF}, {_CHI2.format(w='wt')}, {_TOP}")
def _(spark, sf):
    classes, sums = _sums(spark, sf)
    found = K.strongest_tokens(sums, classes, 5)
    return found.select("class", "token", "length", "rank", r6("chi2", "chi2"))


@query("top_chi_square_tokens_unit", f"WITH {TFIDF}, {_UNIT}, {_CHI2.format(w='un')}, {_TOP}")
def _(spark, sf):
    classes, sums = _unit_sums(spark, sf)
    found = K.strongest_tokens(sums, classes, 5)
    return found.select("class", "token", "length", "rank", r6("chi2", "chi2"))


@query("total_chi_square", f"""
WITH {TFIDF}, {_CHI2.format(w='wt')} SELECT round(sum((o - e) ** 2 / e), 4) AS chi2 FROM cell WHERE e > 0""")
def _(spark, sf):
    classes, sums = _sums(spark, sf)
    total = K.total_chi_square(sums, classes)
    return total.select(F.round("chi2", 4).alias("chi2"))


# ---- centroids -----------------------------------------------------------------------

_CEN = """cls AS (SELECT class, count(*) AS n FROM src GROUP BY class),
cen AS (SELECT class, token, sum(weight) / any_value(n) AS v FROM wt JOIN cls USING (class) GROUP BY class, token)"""


@query("class_ids", """
SELECT lang AS class, count(*)::BIGINT AS n, (row_number() OVER (ORDER BY lang) - 1)::INT AS classid
FROM documents GROUP BY lang""")
def _(spark, sf):
    return C.class_table(articles(spark, sf))


@query("class_centroids", f"""
WITH {TFIDF}, {_CEN} SELECT class, token, round(v, 6) AS weight FROM cen""")
def _(spark, sf):
    classes, sums = _sums(spark, sf)
    found = C.class_centroids(sums, classes)
    return found.select("class", "token", r6("weight", "weight"))


@query("unit_class_centroids", f"""
WITH {TFIDF}, {_UNIT}, cls AS (SELECT class, count(*) AS n FROM src GROUP BY class),
cen AS (SELECT class, token, sum(weight) / any_value(n) AS v FROM un JOIN cls USING (class) GROUP BY class, token)
SELECT class, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY class)), 6) AS weight FROM cen""")
def _(spark, sf):
    classes, sums = _unit_sums(spark, sf)
    found = C.unit_centroids(C.class_centroids(sums, classes))
    return found.select("class", "token", r6("weight", "weight"))


# ---- holdout: distances, scores, decisions -------------------------------------------


def _holdout_sql(
    ratio: float = 0.7, fit: str = "part = 'train'", seed: int = 42, parts: str | None = None
) -> str:
    return f"""{TWO}, {parts or holdout_sql(seed, ratio)},
fd AS (SELECT doc_id FROM pt WHERE {fit}), nd AS (SELECT count(*) AS n FROM fd),
stats AS (SELECT token, count(*) AS df, sum(c) AS tf FROM cnt WHERE doc_id IN (SELECT doc_id FROM fd) GROUP BY token),
voc AS (SELECT token, ln(n / (df + 1)) + 1 AS idf FROM stats, nd WHERE tf >= 5),
{WEIGHTS},
un AS (SELECT wt.doc_id, wt.class, part, token, weight,
  weight / sqrt(sum(weight * weight) OVER (PARTITION BY wt.doc_id)) AS unit FROM wt JOIN pt USING (doc_id)),
cls AS (SELECT class AS label, count(*) AS n FROM pt WHERE part = 'train' GROUP BY class),
cen AS (SELECT class AS label, token, sum(weight) / any_value(n) AS raw, sum(unit) / any_value(n) AS unit
  FROM un JOIN cls ON label = class WHERE part = 'train' GROUP BY class, token),
csq AS (SELECT label, sum(raw * raw) AS raw, sum(unit * unit) AS unit FROM cen GROUP BY label),
dsq AS (SELECT doc_id, sum(weight * weight) AS raw, sum(unit * unit) AS unit FROM un GROUP BY doc_id),
dots AS (SELECT doc_id, label, sum(weight * raw) AS raw, sum(un.unit * cen.unit) AS unit
  FROM un JOIN cen USING (token) GROUP BY doc_id, label),
dist AS (SELECT pt.doc_id, class, part, cls.label,
  sqrt(greatest(0, coalesce(dsq.raw, 0) - 2 * coalesce(dots.raw, 0) + csq.raw)) AS raw_distance,
  CASE WHEN dsq.unit * csq.unit > 0 THEN coalesce(dots.unit, 0) / (sqrt(dsq.unit) * sqrt(csq.unit)) END AS cos
  FROM pt CROSS JOIN cls JOIN csq ON csq.label = cls.label LEFT JOIN dsq ON dsq.doc_id = pt.doc_id
  LEFT JOIN dots ON dots.doc_id = pt.doc_id AND dots.label = cls.label),
dis AS (SELECT *, CASE WHEN cos = 0 THEN 'inf'::DOUBLE ELSE 1 / cos END AS unit_distance FROM dist)"""


_SCORES = """var AS (SELECT label, var_pop(raw_distance) AS rv, var_pop(unit_distance) AS uv FROM dis
  WHERE part = 'train' AND class = label GROUP BY label),
vv AS (SELECT label, CASE WHEN rv < 1e-10 THEN rv + 1e-10 ELSE rv END AS rv,
  CASE WHEN uv < 1e-10 THEN uv + 1e-10 ELSE uv END AS uv FROM var),
sc AS (SELECT dis.*, exp(-0.5 * raw_distance * raw_distance / rv) / sqrt(2 * pi() * rv) AS raw_gauss,
  exp(-0.001::DOUBLE * raw_distance) AS raw_expo,
  exp(-0.5 * unit_distance * unit_distance / uv) / sqrt(2 * pi() * uv) AS unit_gauss,
  exp(-0.001::DOUBLE * unit_distance) AS unit_expo FROM dis LEFT JOIN vv USING (label))"""
_PRED = """pr AS (SELECT doc_id, class, part,
  arg_min(label, (raw_distance, label)) FILTER (raw_distance IS NOT NULL) AS distance_raw,
  arg_min(label, (-raw_gauss, label)) FILTER (raw_gauss IS NOT NULL) AS gauss_raw,
  arg_min(label, (-raw_expo, label)) FILTER (raw_expo IS NOT NULL) AS expo_raw,
  arg_min(label, (unit_distance, label)) FILTER (unit_distance IS NOT NULL) AS distance_unit,
  arg_min(label, (-unit_gauss, label)) FILTER (unit_gauss IS NOT NULL) AS gauss_unit,
  arg_min(label, (-unit_expo, label)) FILTER (unit_expo IS NOT NULL) AS expo_unit
  FROM sc GROUP BY doc_id, class, part)"""


def _accuracy_sql(scorers=H.SCORERS) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{s}' AS scorer, count(*)::BIGINT AS n,
  round(avg((coalesce({s} = class, false))::INT), 6) AS accuracy FROM pr WHERE part = 'test'"""
        for s in scorers
    )


def _distances(spark, sf, spaces=H.SPACES):
    split = H.split_documents(articles(spark, sf))
    weights = H.weigh(split)
    unstage(split.counts)
    return H.class_distances(split.docs, weights, spaces)


def _scores(spark, sf):
    return H.class_scores(_distances(spark, sf))


@query("nearest_centroid_accuracy", f"""
WITH {_holdout_sql()}, p AS (SELECT doc_id, class, arg_min(label, (raw_distance, label)) AS predicted
  FROM dis WHERE part = 'test' GROUP BY doc_id, class)
SELECT class, count(*)::BIGINT AS n, round(avg((predicted = class)::INT), 6) AS accuracy FROM p GROUP BY class""")
def _(spark, sf):
    found = H.nearest_centroid_by_class(articles(spark, sf))
    return found.select("class", "n", r6("accuracy", "accuracy"))


_FINE_SRC = "src AS (SELECT doc_id, lang || '/' || source AS class, source, text FROM documents)"


@query("fine_class_accuracy", f"""
WITH {_holdout_sql().replace(SRC, _FINE_SRC)}, p AS (SELECT doc_id, class, arg_min(label, (round(raw_distance, 9), label)) AS predicted
  FROM dis WHERE part = 'test' GROUP BY doc_id, class)
SELECT class, count(*)::BIGINT AS n, round(avg((predicted = class)::INT), 6) AS accuracy FROM p GROUP BY class""")
def _(spark, sf):
    """More than 64 classes: every language within every source."""
    docs = articles(spark, sf).withColumn("class", F.concat_ws("/", "class", "source"))
    found = H.nearest_centroid_by_class(docs)
    return found.select("class", "n", r6("accuracy", "accuracy"))


@query("class_distances", f"""
WITH {_holdout_sql()} SELECT doc_id, label, round(raw_distance, 6) AS raw_distance,
  round(unit_distance, 6) AS unit_distance FROM dis""")
def _(spark, sf):
    return _distances(spark, sf).select(
        "doc_id", "label", r6("raw_distance", "raw_distance"), r6("unit_distance", "unit_distance")
    )


@query("cosine_to_centroids", f"""
WITH {_holdout_sql()} SELECT doc_id, label, round(cos, 6) AS cosine FROM dis""")
def _(spark, sf):
    found = _distances(spark, sf, ("unit",))
    d = F.col("unit_distance")
    back = F.when(d == float("inf"), F.lit(0.0)).otherwise(1 / d)
    return found.select("doc_id", "label", r6(back, "cosine"))


@query("class_variances", f"""
WITH {_holdout_sql()}, {_SCORES} SELECT label, round(rv, 6) AS raw_variance, round(uv, 6) AS unit_variance FROM var""")
def _(spark, sf):
    own = (F.col("part") == "train") & (F.col("class") == F.col("label"))
    found = C.variance_by_class(
        _distances(spark, sf), own, "label", ("raw_distance", "unit_distance")
    )
    return found.select(
        "label", r6("var_raw_distance", "raw_variance"), r6("var_unit_distance", "unit_variance")
    )


@query("class_scores", f"""
WITH {_holdout_sql()}, {_SCORES} SELECT doc_id, label, round(raw_gauss, 6) AS raw_gauss,
  round(raw_expo, 6) AS raw_expo, round(unit_gauss, 6) AS unit_gauss, round(unit_expo, 6) AS unit_expo FROM sc""")
def _(spark, sf):
    return _scores(spark, sf).select(
        "doc_id", "label", *[r6(c, c) for c in ("raw_gauss", "raw_expo", "unit_gauss", "unit_expo")]
    )


@query("holdout_predictions", f"""
WITH {_holdout_sql()}, {_SCORES}, {_PRED} SELECT doc_id, class, part, {', '.join(H.SCORERS)} FROM pr""")
def _(spark, sf):
    return H.predictions(_scores(spark, sf))


@query("holdout_accuracy", f"WITH {_holdout_sql()}, {_SCORES}, {_PRED} {_accuracy_sql()}")
def _(spark, sf):
    found = H.evaluate_holdout(articles(spark, sf))
    return found.select("scorer", "n", r6("accuracy", "accuracy"))


@query("holdout_accuracy_fit_on_all", f"""
WITH {_holdout_sql(0.8, 'true')}, {_SCORES}, {_PRED} {_accuracy_sql()}""")
def _(spark, sf):
    found = H.evaluate_holdout(articles(spark, sf), ratio=0.8, fit_on="all")
    return found.select("scorer", "n", r6("accuracy", "accuracy"))


_SEEDS = (7, 42)
_RUNS = "\nUNION ALL ".join(
    f"""SELECT * FROM (WITH {_holdout_sql(0.7, 'true', seed)}, {_SCORES}, {_PRED} {_accuracy_sql()})"""
    for seed in _SEEDS
)


@query("repeated_holdout", f"""
WITH runs AS ({_RUNS}) SELECT scorer, count(*)::BIGINT AS runs, round(avg(accuracy), 4) AS mean,
  round(min(accuracy), 4) AS minimum, round(quantile_cont(accuracy, 0.25), 4) AS lower,
  round(median(accuracy), 4) AS median, round(quantile_cont(accuracy, 0.75), 4) AS upper,
  round(max(accuracy), 4) AS maximum FROM runs GROUP BY scorer""")
def _(spark, sf):
    runs = H.repeated_holdout(articles(spark, sf), _SEEDS)
    spread = E.accuracy_spread(runs)
    return spread.select(
        "scorer", "runs",
        *[F.round(c, 4).alias(c) for c in ("mean", "minimum", "lower", "median", "upper", "maximum")],
    )


def _fold_sql(fold: int) -> str:
    parts = f"""ord AS (SELECT doc_id, class, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS p FROM src),
pt AS (SELECT doc_id, class, CASE WHEN p % 3 = {fold} THEN 'test' ELSE 'train' END AS part FROM ord)"""
    return f"""SELECT {fold}::INT AS fold, * FROM (WITH {_holdout_sql(fit='true', parts=parts)}, {_SCORES}, {_PRED}
{_accuracy_sql()})"""


@query("fold_accuracy", "\nUNION ALL ".join(_fold_sql(i) for i in range(3)))
def _(spark, sf):
    runs = H.fold_accuracy(articles(spark, sf), 3)
    return runs.select("fold", "scorer", "n", r6("accuracy", "accuracy"))


@query("two_closest_classes", f"""
WITH {_holdout_sql()}, {_SCORES},
d AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY raw_distance, label) AS k FROM sc),
g AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY raw_expo DESC, label) AS k FROM sc)
SELECT doc_id, string_agg(d.label, ',' ORDER BY k) AS by_distance, any_value(by_score) AS by_score FROM d
JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY k) AS by_score FROM g WHERE k <= 2 GROUP BY doc_id) USING (doc_id)
WHERE k <= 2 GROUP BY doc_id""")
def _(spark, sf):
    scores = _scores(spark, sf)
    near = S.top_labels(scores, "doc_id", "label", "raw_distance", 2, False, "near")
    best = S.top_labels(scores, "doc_id", "label", "raw_expo", 2, True, "best")
    return near.join(best, "doc_id").select(
        "doc_id", joined("near", "by_distance"), joined("best", "by_score")
    )


@query("second_closest_class", f"""
WITH {_holdout_sql()}, d AS (SELECT doc_id, label, raw_distance,
  row_number() OVER (PARTITION BY doc_id ORDER BY raw_distance, label) AS k FROM dis)
SELECT doc_id, label, round(raw_distance, 6) AS raw_distance FROM d WHERE k = 2""")
def _(spark, sf):
    found = S.nth_label(_distances(spark, sf, ("raw",)), "doc_id", "label", "raw_distance", 2)
    return found.select("doc_id", "label", r6("raw_distance", "raw_distance"))


# Thresholds on the raw exponential score. Scores are rounded where a comparison decides.
_GRID = tuple(round(0.95 + 0.0025 * i, 4) for i in range(21))
_GRID_SQL = "g AS (SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in _GRID) + "]) AS threshold)"
_SWEEP = f"""{_GRID_SQL},
ts AS (SELECT doc_id, class, part, label, round(raw_expo, 9) AS s FROM sc),
lo AS (SELECT label, threshold, avg(CASE WHEN s > threshold THEN (CASE WHEN class = label THEN 0.0 ELSE 1.5 END)
  ELSE 1.0 END::DOUBLE) AS loss FROM ts CROSS JOIN g WHERE part = 'train' GROUP BY label, threshold),
th AS (SELECT label, arg_min(threshold, (round(loss, 9), threshold)) AS threshold, min(round(loss, 9)) AS loss
  FROM lo GROUP BY label)"""


def _rounded(spark, sf):
    return _scores(spark, sf).withColumn("s", F.round("raw_expo", 9))


def _learned(scores):
    train = scores.filter(F.col("part") == "train")
    losses = T.sweep(train, F.array("class"), "label", "s", _GRID)
    return losses, T.best_threshold(losses, "label")


@query("threshold_losses", f"""
WITH {_holdout_sql()}, {_SCORES}, {_SWEEP} SELECT label, threshold, round(loss, 6) AS loss FROM lo""")
def _(spark, sf):
    losses, _best = _learned(_rounded(spark, sf))
    return losses.select("label", "threshold", r6("loss", "loss"))


@query("class_thresholds", f"""
WITH {_holdout_sql()}, {_SCORES}, {_SWEEP} SELECT label, threshold, round(loss, 6) AS loss FROM th""")
def _(spark, sf):
    _losses, best = _learned(_rounded(spark, sf))
    return best.select("label", "threshold", r6("loss", "loss"))


_DENSITIES = ("raw_gauss", "raw_expo", "unit_gauss", "unit_expo")


def _density_sql(score: str) -> str:
    return f"""SELECT '{score}' AS score, label, threshold, loss FROM (
WITH s AS (SELECT class, label, round({score}, 9) AS s FROM sc WHERE part = 'train' AND {score} IS NOT NULL),
r AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY s) AS k, count(*) OVER (PARTITION BY label) AS n FROM s),
g AS (SELECT DISTINCT label, s AS threshold FROM r, (SELECT unnest(range(0, 21)) AS q)
  WHERE k = greatest(1, ceil(q / 20 * n)::BIGINT)),
lo AS (SELECT label, threshold, avg(CASE WHEN s > threshold THEN (CASE WHEN class = label THEN 0.0 ELSE 1.5 END)
  ELSE 1.0 END::DOUBLE) AS loss FROM s JOIN g USING (label) GROUP BY label, threshold)
SELECT label, arg_min(threshold, (round(loss, 9), threshold)) AS threshold, round(min(round(loss, 9)), 6) AS loss
FROM lo GROUP BY label)"""


@query("density_thresholds", f"""
WITH {_holdout_sql()}, {_SCORES} {' UNION ALL '.join(_density_sql(s) for s in _DENSITIES)}""")
def _(spark, sf):
    """Thresholds of all four scores, each searched over the quantiles of its class."""
    scores = stage(_scores(spark, sf), "scores")
    found = []
    for name in _DENSITIES:
        train = scores.filter((F.col("part") == "train") & F.col(name).isNotNull()).select(
            "class", "label", F.round(name, 9).alias("s")
        )
        losses = T.sweep_grid(train, T.quantile_grid(train, "label", "s"), F.array("class"), "label", "s")
        best = T.best_threshold(losses, "label")
        found.append(best.select(F.lit(name).alias("score"), "label", "threshold", r6("loss", "loss")))
    return reduce(lambda a, b: a.unionByName(b), found)


_CAND = """pass AS (SELECT doc_id, label, {s} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY {s} DESC, label) AS k
  FROM {t} JOIN th USING (label) WHERE {s} > threshold),
{n} AS (SELECT d.doc_id, coalesce(string_agg(label, ',' ORDER BY k) FILTER (k <= 2), '') AS {n}
  FROM (SELECT DISTINCT doc_id FROM ts) d LEFT JOIN pass ON pass.doc_id = d.doc_id GROUP BY d.doc_id)"""


@query("candidate_classes", f"""
WITH {_holdout_sql()}, {_SCORES}, {_SWEEP}, {_CAND.format(s='s', t='ts', n='candidates')}
SELECT doc_id, candidates FROM candidates""")
def _(spark, sf):
    scores = _rounded(spark, sf)
    _losses, best = _learned(scores)
    found = S.candidates(scores, best, "doc_id", "label", "s")
    return found.select("doc_id", joined("candidates", "candidates"))


@query("accepted_predictions", f"""
WITH {_holdout_sql()}, {_SCORES}, {_SWEEP},
b AS (SELECT doc_id, label, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS k FROM ts)
SELECT doc_id, label AS predicted, coalesce(s >= threshold, false) AS accepted,
  CASE WHEN s >= threshold THEN label END AS decision FROM b LEFT JOIN th USING (label) WHERE k = 1""")
def _(spark, sf):
    scores = _rounded(spark, sf)
    _losses, best = _learned(scores)
    return S.accept(scores, best, "doc_id", "label", "s")


# Two candidate lists per test document: nearest two classes by distance and by unit distance.
_LISTS = """ls AS (SELECT doc_id, class, array_agg(label ORDER BY k) FILTER (k <= 2) AS a,
  array_agg(label ORDER BY u) FILTER (u <= 2) AS b FROM (SELECT doc_id, class, label,
  row_number() OVER (PARTITION BY doc_id ORDER BY raw_distance, label) AS k,
  row_number() OVER (PARTITION BY doc_id ORDER BY unit_distance, label) AS u
  FROM dis WHERE part = 'test' AND unit_distance IS NOT NULL) GROUP BY doc_id, class)"""


def _lists(spark, sf):
    test = _distances(spark, sf).filter(
        (F.col("part") == "test") & F.col("unit_distance").isNotNull()
    )
    # Both lists and the true classes read the distances.
    test = stage(test, "distances")
    a = S.top_labels(test, "doc_id", "label", "raw_distance", 2, False, "a")
    b = S.top_labels(test, "doc_id", "label", "unit_distance", 2, False, "b")
    truth = test.select("doc_id", "class").distinct()
    return truth.join(a, "doc_id").join(b, "doc_id")


@query("agreeing_candidates", f"""
WITH {_holdout_sql()}, {_LISTS} SELECT doc_id, class, array_to_string(a, ',') AS candidates FROM ls WHERE a = b""")
def _(spark, sf):
    same = E.agreeing(_lists(spark, sf), "a", "b")
    return same.select("doc_id", "class", joined("a", "candidates"))


_OTHER = "oc AS (SELECT class, list_filter(a, lambda x: x <> class)[1] AS other FROM ls WHERE a = b)"
_RELATION = """rel AS (SELECT x.label AS class, y.label AS other, count(oc.class)::BIGINT AS n
  FROM cls x JOIN cls y ON x.label <> y.label LEFT JOIN oc ON oc.class = x.label AND oc.other = y.label
  GROUP BY x.label, y.label)"""


def _relation(spark, sf):
    same = E.agreeing(_lists(spark, sf), "a", "b")
    others = E.other_candidate(same, "class", "a")
    classes = C.class_table(articles(spark, sf))
    return E.relation_pairs(others, "class", "other", classes, "class")


@query("class_relation", f"""
WITH {_holdout_sql()}, {_LISTS}, {_OTHER}, {_RELATION} SELECT class, other, n FROM rel""")
def _(spark, sf):
    return _relation(spark, sf)


@query("class_relation_matrix", f"""
WITH {_holdout_sql()}, {_LISTS}, {_OTHER}, {_RELATION}
SELECT class, coalesce(sum(n) FILTER (other = 'de'), 0)::BIGINT AS de, coalesce(sum(n) FILTER (other = 'en'), 0)::BIGINT AS en,
  coalesce(sum(n) FILTER (other = 'es'), 0)::BIGINT AS es, coalesce(sum(n) FILTER (other = 'fr'), 0)::BIGINT AS fr
FROM rel GROUP BY class""")
def _(spark, sf):
    return E.relation_matrix(_relation(spark, sf), "class", "other", ("de", "en", "es", "fr"))


@query("role_classifier", f"""
WITH src AS (SELECT conv_id || '/' || turn AS doc_id, role AS class, '' AS source, text FROM conversations),
{_holdout_sql().split('documents), ', 1)[1]}, {_SCORES}, {_PRED} {_accuracy_sql()}""")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.col("role").alias("class"), "text"
    )
    found = H.evaluate_holdout(turns)
    return found.select("scorer", "n", r6("accuracy", "accuracy"))
