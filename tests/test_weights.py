import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeforge.operators import centroids as C
from themeforge.operators import chi2 as K
from themeforge.operators import vocab as V
from themeforge.operators import weights as X

DOCS = [
    (1, "a", "s1", "oil bank oil growth"), (2, "a", "s1", "bank growth oil"), (3, "b", "s2", "film award"),
    (4, "b", "s2", "film star film oil"), (5, "b", "s3", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, class string, source string, text string")


def plain_weights(min_df, sublinear=True):
    counts = {d: Counter(t.split()) for d, _, _, t in DOCS}
    df, tf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        tf.update(c)
    idf = {t: math.log(len(DOCS) / (df[t] + 1)) + 1 for t in df if tf[t] >= min_df}
    out = {}
    for d, c in counts.items():
        for t, n in c.items():
            if t in idf:
                w = n * idf[t]
                out[d, t] = math.log(w + 1) if sublinear else w
    return out


@pytest.mark.parametrize("min_df,sublinear", [(1, True), (2, True), (2, False)])
def test_tf_idf_restated(docs, min_df, sublinear):
    counts = V.term_counts(docs)
    vocabulary = X.fit_idf(V.token_stats(counts), X.row_total(docs), min_df)
    found = {(r["doc_id"], r["token"]): r["weight"] for r in X.tf_idf(counts, vocabulary, sublinear).collect()}
    assert found == pytest.approx(plain_weights(min_df, sublinear))


def test_profile_gives_the_same_sums(docs):
    counts = V.term_counts(docs, ("doc_id", "class"))
    profile = X.count_profile(counts, "class")
    by_token = sorted(map(tuple, X.profile_stats(profile).collect()))
    assert by_token == sorted(map(tuple, V.token_stats(counts).collect()))
    vocabulary = X.fit_idf(X.profile_stats(profile), X.row_total(docs), 1)
    sums = {(r["class"], r["token"]): r["weight"] for r in X.profile_sums(profile, vocabulary, "class").collect()}
    direct = X.class_sums(X.tf_idf(counts, vocabulary), "class")
    assert sums == pytest.approx({(r["class"], r["token"]): r["weight"] for r in direct.collect()})


def test_unit_vectors_and_zero_vector(spark):
    rows = [(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, token string, weight double")
    l2 = {(r["doc_id"], r["token"]): r["weight"] for r in X.normalise(df).collect()}
    assert l2[1, "a"] == pytest.approx(0.6) and l2[1, "b"] == pytest.approx(0.8) and l2[2, "a"] is None
    l1 = {(r["doc_id"], r["token"]): r["weight"] for r in X.normalise(df, "l1").collect()}
    assert l1[1, "b"] == pytest.approx(4 / 7)
    assert X.normalise(df, None) is df


def test_batch_score_restated(docs):
    counts = V.term_counts(docs, ("doc_id", "source"))
    extra = docs.sparkSession.createDataFrame([("oil",), ("absent",)], "token string")
    found = {r["token"]: r for r in X.batch_score(counts, X.row_total(docs), "source", extra).collect()}
    # oil: 3 occurrences in s1, 1 in s2
    assert found["oil"]["tf"] == pytest.approx(0.5 + 0.5 * (3 / 3 + 1 / 3))
    assert found["oil"]["idf"] == pytest.approx(math.log(6 / 3))
    assert found["absent"]["tf"] == 0.5 and found["absent"]["idf"] == pytest.approx(math.log(6))


def test_chi_square_restated(docs):
    counts = V.term_counts(docs, ("doc_id", "class"))
    sums = counts.groupBy("class", "token").agg(F.sum("c").cast("double").alias("weight"))
    classes = C.class_table(docs)
    found = {(r["class"], r["token"]): r["chi2"] for r in K.chi_square(sums, classes).collect()}
    observed, total = 3.0, 4.0  # oil in class a
    e = 2 / 5 * total
    expected = (observed - e) ** 2 / e + (observed - e) ** 2 / (total - e)
    assert found["a", "oil"] == pytest.approx(expected) == pytest.approx(found["b", "oil"])
    assert found["a", "film"] > 0  # zero observed in the class still counts
    whole = K.total_chi_square(sums, classes).first()["chi2"]
    # With two classes, class against rest covers both cells of the table.
    assert whole == pytest.approx(sum(v for (c, _), v in found.items() if c == "a"))


def test_single_class_chi_square_is_zero(docs):
    only = docs.filter("class = 'a'")
    counts = V.term_counts(only, ("doc_id", "class"))
    sums = counts.groupBy("class", "token").agg(F.sum("c").cast("double").alias("weight"))
    assert K.total_chi_square(sums, C.class_table(only)).first()["chi2"] == 0.0


def test_pruning_keeps_both_sides(docs):
    counts = V.term_counts(docs)
    scores = X.split_by_score(V.token_stats(counts).withColumnRenamed("tf", "tf_idf"), 2)
    assert {r["token"]: r["kept"] for r in scores.collect()}["bank"] is False  # equal is dropped
    left = X.prune_tokens(counts, scores.filter("not kept")).select("token").distinct()
    assert sorted(r["token"] for r in left.collect()) == ["film", "oil"]


@pytest.mark.parametrize("n_classes, n_tokens, n", [(3, 8, 5), (6, 40, 4), (2, 5, 9), (1, 6, 3)])
def test_strongest_tokens_equal_those_of_the_grid(spark, n_classes, n_tokens, n):
    import numpy as np

    rng = np.random.default_rng(n_tokens)
    names = [f"w{t}" if t % 2 else f"w{t} v" for t in range(n_tokens)]
    cells = [
        (f"c{c}", names[t], float(rng.integers(1, 5)))
        for c in range(n_classes) for t in range(n_tokens) if rng.random() < (0.2 if c else 1.0)
    ]
    sums = spark.createDataFrame(cells, "class string, token string, weight double")
    # One class without a token, and documents without a class.
    sizes = [(f"c{c}", 3 + c) for c in range(n_classes)] + ([("empty", 2), (None, 4)] if n_classes > 1 else [])
    classes = spark.createDataFrame(sizes, "class string, n long")
    grid = K.chi_square(sums, classes).withColumn("chi2", F.round("chi2", 9))
    key = lambda r: (str(r["class"]), r["length"], r["rank"], r["token"], r["chi2"])
    wanted = sorted(key(r) for r in K.top_tokens(grid, n).collect())
    found = sorted(key(r) for r in K.strongest_tokens(sums, classes, n).collect())
    assert [f[:4] for f in found] == [w[:4] for w in wanted]
    assert [f[4] for f in found] == pytest.approx([w[4] for w in wanted])
    expected = 0.0
    total_n = sum(x for _, x in sizes)
    totals = {t: sum(w for _, s, w in cells if s == t) for t in {c[1] for c in cells}}
    held = {(c, t): w for c, t, w in cells}
    for c, size in sizes:
        for t, total in totals.items():
            e = size / total_n * total
            expected += (held.get((c, t), 0.0) - e) ** 2 / e
    assert K.total_chi_square(sums, classes).first()["chi2"] == pytest.approx(expected)
