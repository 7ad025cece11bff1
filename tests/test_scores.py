import math

import pytest
from pyspark.sql import functions as F

from themeforge.functions import scores as S
from themeforge.functions import vectors as V
from themeforge.functions.sets import label_recall, set_loss
from themeforge.operators import scoring as D
from themeforge.operators import thresholds as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_gaussian_values(spark):
    d, v = F.lit(2.0), F.lit(4.0)
    expected = math.exp(-0.5 * 4 / 4) / math.sqrt(2 * math.pi * 4)
    assert value(spark, S.gaussian(d, v)) == pytest.approx(expected)
    assert value(spark, S.log_gaussian(d, v)) == pytest.approx(math.log(expected))
    tiny = value(spark, S.gaussian(F.lit(0.0), F.lit(0.0)))
    assert tiny == pytest.approx(1 / math.sqrt(2 * math.pi * 1e-10))
    shifted = math.exp(-0.5 * 4 / (4 + 1e-5)) / math.sqrt(2 * math.pi * 4)
    assert value(spark, S.gaussian(d, v, "shifted_exponent")) == pytest.approx(shifted)


def test_ratio_and_exponential(spark):
    g = math.exp(-0.5 * (1.0 / (2.0 + 1e-4)) ** 2)
    assert value(spark, S.gaussian_ratio(F.lit(1.0), F.lit(2.0))) == pytest.approx(g / (g + 1e-4))
    assert value(spark, S.exponential(F.lit(3.0))) == pytest.approx(math.exp(-1.5))


def test_vector_measures(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, V.dot(a, b)) == 4.0 and value(spark, V.norm(a)) == 5.0
    assert value(spark, V.euclidean(a, b)) == pytest.approx(math.sqrt(18))
    assert value(spark, V.cosine(a, b)) == pytest.approx(0.8) and value(spark, V.cosine(a, zero)) is None
    assert value(spark, V.inverse_cosine(F.lit(0.0))) == math.inf
    assert value(spark, V.unit(a)) == pytest.approx([0.6, 0.8]) and value(spark, V.unit(zero)) is None
    assert value(spark, V.drop_positions(a, F.array(F.lit(0)))) == [4.0]


LOSSES = [
    (["x"], ["x"], 0.0, 0.0, 0.0), (["x"], ["y"], 2.0, 1.0, 1.5), (["x", "y"], ["x"], 1.0, 0.5, 1.0),
    (["x"], ["x", "y"], 1.0, 0.5, 0.5), ([], [], 0.0, 0.0, 0.0), (["x"], [], 1.0, 1.0, 1.0),
]


def test_set_losses(spark):
    df = spark.createDataFrame(LOSSES, "a array<string>, b array<string>, p double, n double, s double")
    for form, column in (("plain", "p"), ("normalized", "n"), ("second_term", "s")):
        for row in df.withColumn("l", set_loss(F.col("a"), F.col("b"), form=form)).collect():
            assert row["l"] == pytest.approx(row[column]), (form, row)


def test_loss_weights(spark):
    df = spark.createDataFrame([(["x", "y"], ["x", "z", "w"])], "a array<string>, b array<string>")
    loss = df.select(set_loss(F.col("a"), F.col("b"), 2.0, 3.0).alias("l")).first()["l"]
    assert loss == pytest.approx((2 * 2 + 3 * 1) / 4)


def test_label_recall(spark):
    df = spark.createDataFrame([(["x", "y"], ["y", "q"])], "a array<string>, b array<string>")
    r = df.select(label_recall(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert r["missing"] == ["x"] and r["found"] == ["y"] and r["n_found"] == 1


SCORES = [
    (1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.1), (2, "a", float("nan")), (2, "b", 0.2), (2, "c", None),
    (3, "a", None), (3, "b", None), (3, "c", None),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORES, "doc_id int, label string, s double")


def test_ties_and_missing_scores(scored):
    best = scored.groupBy("doc_id").agg(
        D.highest(F.col("s"), F.col("label")).alias("hi"), D.lowest(F.col("s"), F.col("label")).alias("lo")
    )
    assert {r["doc_id"]: (r["hi"], r["lo"]) for r in best.collect()} == {
        1: ("a", "c"), 2: ("b", "b"), 3: (None, None)
    }


def test_top_and_nth(scored):
    top = {r["doc_id"]: r["candidates"] for r in D.top_labels(scored, "doc_id", "label", "s").collect()}
    assert top == {1: ["a", "b"], 2: ["b"]}
    second = D.nth_label(scored, "doc_id", "label", "s", 2, largest=True).collect()
    assert [(r["doc_id"], r["label"]) for r in second] == [(1, "b")]


def test_candidates_and_acceptance(spark, scored):
    thresholds = spark.createDataFrame([("a", 0.6), ("b", 0.2), ("c", 0.0)], "label string, threshold double")
    found = {r["doc_id"]: r["candidates"] for r in D.candidates(scored, thresholds, "doc_id", "label", "s").collect()}
    assert found == {1: ["b", "c"], 2: [], 3: []}
    accepted = {r["doc_id"]: r for r in D.accept(scored, thresholds, "doc_id", "label", "s").collect()}
    assert accepted[1]["predicted"] == "a" and not accepted[1]["accepted"] and accepted[1]["decision"] is None
    assert accepted[2]["decision"] == "b"


def test_sweep_equals_brute_force(spark):
    rows = [(i, ["x", "y"] if i % 3 else ["z"], c, (i * 7 + len(c) * k) % 10 / 10)
            for i in range(20) for k, c in enumerate(("x", "yy", "z"))]
    df = spark.createDataFrame(rows, "doc_id int, truth array<string>, label string, s double")
    grid = [0.0, 0.2, 0.5, 0.9]
    found = {(r["label"], r["threshold"]): r["loss"] for r in T.sweep(df, F.col("truth"), "label", "s", grid).collect()}

    def loss(a, b):
        a, b = set(a), set(b)
        return len(a - b) + len(b - a) / len(a | b)

    for label in ("x", "yy", "z"):
        for t in grid:
            mine = [loss(truth, [c] if s > t else []) for _, truth, c, s in rows if c == label]
            assert found[label, t] == pytest.approx(sum(mine) / len(mine))
    best = {r["label"]: r for r in T.best_threshold(T.sweep(df, F.col("truth"), "label", "s", grid), "label").collect()}
    for label in ("x", "yy", "z"):
        least = min(round(found[label, t], 9) for t in grid)
        assert best[label]["threshold"] == min(t for t in grid if round(found[label, t], 9) == least)


def test_quantiles_are_exact_for_large_labels(spark):
    from themeforge.operators.thresholds import quantile_grid

    n = 150_000
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 7
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("label"), value.alias("s"))
    held = {}
    for r in rows.toPandas().itertuples():
        held.setdefault(r.label, []).append(r.s)
    odd = spark.createDataFrame([("one", 2.5), ("one", None), ("none", None), (None, 1.0)], "label string, s double")
    found = {r["label"]: r["grid"] for r in quantile_grid(rows.unionByName(odd), "label", "s").collect()}
    for label, values in held.items():
        values.sort()
        ranks = {max(1, math.ceil(i / 20 * len(values))) for i in range(21)}
        assert found[label] == sorted({values[k - 1] for k in ranks})
    assert found["one"] == [2.5] and "none" not in found and found[None] == [1.0]
