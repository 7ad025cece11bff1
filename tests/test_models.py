import numpy as np
import pytest
from pyspark.sql import functions as F

from themeforge.operators import centroids as C
from themeforge.operators import evaluate as E
from themeforge.operators import labels as L
from themeforge.operators.similarity import (
    cosine_from_dot, euclidean_from_dot, own_distances, sparse_dots,
)
from themeforge.operators.vocab import term_counts, token_stats
from themeforge.operators.weights import class_sums, fit_idf, row_total, tf_idf
from themeforge.plans.holdout import evaluate_holdout
from themeforge.streaming.scoring import score_batch

RNG = np.random.default_rng(11)


def to_long(matrix, key="doc_id"):
    return [(int(i), f"t{j}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]


@pytest.mark.parametrize("block", [64, 4, 3, 1])
def test_sparse_distances_equal_dense(spark, block):
    docs = np.where(RNG.random((12, 9)) < 0.4, RNG.random((12, 9)), 0.0)
    docs[5] = 0.0  # a document without tokens
    centres = np.where(RNG.random((4, 9)) < 0.5, RNG.random((4, 9)), 0.0)
    weights = spark.createDataFrame(to_long(docs), "doc_id int, token string, weight double")
    cents = spark.createDataFrame(
        [(f"c{i}", t, v) for i, t, v in to_long(centres)], "label string, token string, value double"
    )
    names = spark.createDataFrame([(f"c{i}",) for i in range(4)], "label string")
    frame = spark.createDataFrame([(i,) for i in range(12)], "doc_id int")
    # both sides call their values ``weight``, as the callers do
    dots = sparse_dots(
        frame, weights, cents.withColumnRenamed("value", "weight"), names, {"x": ("weight", "weight")},
        block_classes=block,
    )
    met = sparse_dots(
        frame, weights, cents, names, {"x": ("weight", "value")}, complete=False, block_classes=block
    )
    shared = (docs @ centres.T) > 0
    assert {(r["doc_id"], int(r["label"][1:])) for r in met.collect()} == set(zip(*map(list, np.nonzero(shared))))
    rows = dots.collect()
    assert len(rows) == 48
    csq = (centres**2).sum(axis=1)
    sized = dots.join(
        spark.createDataFrame([(f"c{i}", float(csq[i])) for i in range(4)], "label string, c double"), "label"
    ).select(
        "doc_id", "label",
        euclidean_from_dot(F.col("dot_x"), F.col("sq_x"), F.col("c")).alias("d"),
        cosine_from_dot(F.col("dot_x"), F.col("sq_x"), F.col("c")).alias("s"),
    )
    for r in sized.collect():
        x, c = docs[r["doc_id"]], centres[int(r["label"][1:])]
        assert r["d"] == pytest.approx(np.linalg.norm(x - c), abs=1e-7)
        if not x.any():
            assert r["s"] is None
        else:
            assert r["s"] == pytest.approx(x @ c / (np.linalg.norm(x) * np.linalg.norm(c)))


def test_seventy_classes_through_evaluation_and_streaming(spark):
    letters = "bcdfghjklm"
    word = [f"{a}{b}{'o' * 3}" for a in letters for b in letters]
    rows = [(i, f"c{i % 70:02d}", f"{word[i % 70]} {word[i % 70]} {word[(i * 7) % 70]}") for i in range(420)]
    frame = spark.createDataFrame([*rows, (999, None, word[3])], "doc_id long, class string, text string")
    found = {r["scorer"]: r for r in evaluate_holdout(frame.filter("class IS NOT NULL"), min_df=1).collect()}
    assert found["distance_raw"]["n"] == 126 and found["distance_unit"]["accuracy"] > 0.9
    counts = term_counts(frame, ("doc_id", "class"), ngram_range=(1, 2))
    vocabulary = fit_idf(token_stats(counts), row_total(frame), 1)
    classes = C.class_table(frame)
    sums = class_sums(tf_idf(counts, vocabulary), "class")
    cents = C.class_centroids(sums, classes).withColumnRenamed("class", "label")
    scored = score_batch(frame.select("doc_id", "text"), vocabulary, cents, classes)
    truth = {i: c for i, c, _ in rows}
    hits = [r["predicted"] == truth[r["doc_id"]] for r in scored.collect() if r["doc_id"] != 999]
    assert len(hits) == 420 and sum(hits) > 400


TEXTS = [(1, ["p", "q"], "oil oil bank"), (2, ["p"], "film oil"), (3, ["q"], ""), (4, ["p", "p2"], "bank")]


def test_category_model_equals_plain_python(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, categories array<string>, text string")
    counts = term_counts(docs, ("doc_id", "categories"))
    vocabulary = fit_idf(token_stats(counts), row_total(docs), 1)
    labelled = L.explode_categories(docs)
    sizes = C.category_table(labelled, minimum=2)
    for denominator, extra in (("n", 0), ("n_plus_1", 1)):
        cents = C.category_centroids(counts, vocabulary, sizes, denominator)
        weights = tf_idf(counts, vocabulary)
        w = {(r["doc_id"], r["token"]): r["weight"] for r in weights.collect()}
        tokens = sorted({t for _, t in w})
        vec = {d: np.array([w.get((d, t), 0.0) for t in tokens]) for d, _, _ in TEXTS}
        found = {(r["category"], r["token"]): r["weight"] for r in cents.collect()}
        assert {c for c, _ in found} == {"p", "q"}  # p2 has one document only
        for cat in ("p", "q"):
            members = [d for d, cs, _ in TEXTS if cat in cs]
            centre = sum(vec[d] for d in members) / (len(members) + extra)
            assert [found.get((cat, t), 0.0) for t in tokens] == pytest.approx(centre.tolist())
            own = {(r["doc_id"], r["category"]): r["distance"] for r in own_distances(weights, labelled, cents).collect()}
            for d in members:
                assert own[d, cat] == pytest.approx(np.linalg.norm(vec[d] - centre), abs=1e-7)


def test_variance_of_a_single_member_is_zero(spark):
    df = spark.createDataFrame([("a", "a", 2.0), ("b", "a", 9.0)], "class string, label string, distance double")
    row = C.variance_by_class(df, F.col("class") == F.col("label"), "label").first()
    assert row["var_distance"] == 0.0


CATS = [(1, ["x", "y", "x"]), (2, []), (3, None), (4, ["z"])]


def test_category_steps(spark):
    df = spark.createDataFrame(CATS, "doc_id int, categories array<string>")
    wanted = spark.createDataFrame([("x",), ("w",)], "category string")
    assert dict(map(tuple, L.count_categories(df).collect())) == {"x": 2, "y": 1, "z": 1}
    assert dict(map(tuple, L.count_categories(df, wanted).collect())) == {"x": 2, "w": 0}
    assert dict(map(tuple, L.unlisted_categories(df, wanted).collect())) == {"y": 1, "z": 1}
    assert [r["doc_id"] for r in L.keep_any(df, ["x", "w"]).collect()] == [1]
    assert L.keep_any(df, []).count() == 0
    assert [r["doc_id"] for r in L.keep_listed(df, wanted).collect()] == [1]
    pieces = L.ids_by_category(df, list_rows=1).collect()
    assert sorted((r["category"], r["piece"], r["ids"]) for r in pieces) == [("x", 0, [1]), ("y", 0, [1]), ("z", 0, [4])]


def test_merge_drops_non_positive(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "category string, n long")
    b = spark.createDataFrame([("y", -1), ("z", 5)], "category string, n long")
    assert sorted(tuple(r) for r in L.merge_counts([a, b], True).collect()) == [("x", 2), ("z", 5)]
    assert len(L.merge_counts([a, b]).collect()) == 3


def test_share_and_threshold_are_strict(spark):
    df = spark.createDataFrame([("a", 0.215, 0.1), ("b", 0.3, 0.0), ("b", 0.0, 0.4)], "category string, u double, v double")
    kept = L.above_any(df, ["u", "v"])
    row = L.share_removed(df, kept).first()
    assert (row["total"], row["kept"], row["removed_pct"]) == (2, 1, 50.0)


def test_relation_and_histograms(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), ("a", ["b", "a"]), ("b", ["b"]), ("c", ["a", "c"])], "t string, k array<string>")
    others = E.other_candidate(df, "t", "k")
    assert others.count() == 3  # the row with no other class drops out
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    pairs = {(r["t"], r["other"]): r["n"] for r in E.relation_pairs(others, "t", "other", classes, "t").collect()}
    assert len(pairs) == 6 and pairs["a", "b"] == 2 and pairs["c", "a"] == 1 and pairs["b", "a"] == 0
    values = [0, 1, 5, 9, 10, 10]
    numbers = spark.createDataFrame([(v,) for v in values], "n int")
    counts, _edges = np.histogram(values, bins=30)
    found = {r["bin"]: r["n"] for r in E.equal_width_histogram(numbers, "n").collect()}
    assert found == {i + 1: c for i, c in enumerate(counts) if c}
    edges = [0, 5, 9, 10]
    found = {r["bin"]: r["n"] for r in E.edge_histogram(numbers, "n", edges).collect()}
    assert found == {i + 1: c for i, c in enumerate(np.histogram(values, edges)[0]) if c}


def test_accuracy_spread(spark):
    df = spark.createDataFrame([("s", a) for a in (0.5, 0.7, 0.9)], "scorer string, accuracy double")
    r = E.accuracy_spread(df).first()
    assert (r["minimum"], r["median"], r["maximum"]) == (0.5, 0.7, 0.9) and r["lower"] == pytest.approx(0.6)


def test_all_runs_in_one_pass_equal_one_after_another(spark):
    from themeforge.operators.splits import holdout_part
    from themeforge.plans import holdout as H

    rng = np.random.default_rng(5)
    words = [[f"{c}{'abcdefgh'[i]}word" for i in range(8)] for c in "xyz"]
    rows = []
    for i in range(90):
        c = i % 3
        own = list(rng.choice(words[c], 12)) + list(rng.choice(words[(c + 1) % 3], 5))
        rows.append((i, "pqr"[c], " ".join(own) if i % 17 else ""))
    rows.append((90, "rare", "xaword xaword"))
    docs = spark.createDataFrame(rows, "doc_id long, class string, text string")
    seeds = (1, 2, 5)
    found = {(r["seed"], r["scorer"]): (r["n"], r["accuracy"]) for r in H.repeated_holdout(docs, seeds, min_df=2).collect()}
    whole = docs.withColumn("part", F.lit("all"))
    split = H.Split(whole.select("doc_id", "class", "part"), term_counts(whole, ("doc_id", "class", "part"), ngram_range=(1, 2)))
    weights = H.weigh(split, "all", 2).drop("part")
    for seed in seeds:
        part = holdout_part(docs, "doc_id", seed, 0.7)
        base = docs.select("doc_id", "class").withColumn("part", part)
        scores = H.class_scores(H.class_distances(base, weights.withColumn("part", part)))
        for r in H.accuracies(H.predictions(scores)).collect():
            assert found[seed, r["scorer"]] == (r["n"], pytest.approx(r["accuracy"]))
    assert len(found) == 18
    folds = {(r["fold"], r["scorer"]): r["n"] for r in H.fold_accuracy(docs, 4, min_df=2).collect()}
    assert len(folds) == 24 and sum(n for (_, s), n in folds.items() if s == "distance_raw") == 91
