"""CUR per batch equals CUR of each batch alone; errors equal those of the product and fall with the rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeforge.operators import batch_cur as BC
from themeforge.operators import reduce as R

RNG = np.random.default_rng(4)
BASIS = np.where(RNG.random((60, 25)) < 0.4, RNG.random((60, 25)), 0.0)


def sparse(spark, matrix, first=0):
    rows = [(first + int(i), f"t{j}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, "doc_id long, token string, weight double")


def values(df, *columns):
    return {tuple(r[c] for c in columns): r["value"] for r in df.collect()}


def test_each_batch_has_the_factors_it_has_alone(spark):
    whole = sparse(spark, BASIS).withColumn("batch", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")))
    found = BC.cur_by_batch(whole.repartition(5), 6).cache()
    for b in range(3):
        own = found.filter(F.col("batch") == f"b{b}")
        alone = R.cur(sparse(spark, BASIS[20 * b : 20 * b + 20], 20 * b), 6)
        part = lambda name: own.filter(F.col("part") == name)
        assert values(part("c"), "doc_id", "j") == pytest.approx(values(alone.c, "doc_id", "j"))
        assert values(part("r"), "i", "token") == pytest.approx(values(alone.r, "i", "token"))
        u, w = np.zeros((6, 6)), np.zeros((6, 6))
        for (i, j), x in values(part("u"), "i", "j").items():
            u[i, j] = x
        w = alone.intersection
        assert w @ u @ w @ w.T @ w @ u @ w == pytest.approx(w, abs=1e-8)
    docs = whole.select("batch", "doc_id").distinct()
    vectors = {r["doc_id"]: r["vector"] for r in BC.batch_vectors(found, docs, 6).collect()}
    c = values(found.filter("part = 'c'"), "doc_id", "j")
    assert all(vectors[d] == pytest.approx([c.get((d, j), 0.0) for j in range(6)]) for d in range(60))


def test_batches_are_bounded_and_disjoint(spark):
    docs = spark.range(45).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "a").otherwise("b").alias("source"))
    found = BC.batches_of(docs, "doc_id", "source", 20)
    sizes = {r["batch"]: r["count"] for r in found.groupBy("batch").count().collect()}
    assert sizes == {"a-0": 20, "a-1": 10, "b-0": 15} and found.count() == 45


def test_resuming_adds_only_new_batches(spark, tmp_path):
    whole = sparse(spark, BASIS).withColumn("batch", F.floor(F.col("doc_id") / 20))
    path = f"{tmp_path}/cur"
    first = BC.resume_cur(whole.filter("batch < 2"), 4, path)
    before = sorted(map(str, first.collect()))
    both = BC.resume_cur(whole, 4, path)
    assert sorted(map(str, both.filter("batch < 2").collect())) == before
    assert sorted(map(str, both.collect())) == sorted(map(str, BC.cur_by_batch(whole, 4).collect()))


def test_odd_weights(spark):
    whole = spark.createDataFrame(
        [("x", 1, "a", 2.0), ("x", 1, None, 2.0), (None, 1, "a", 1.0), ("y", 2, "a", 0.0), ("z", 3, "b", None)],
        "batch string, doc_id long, token string, weight double",
    )
    found = BC.cur_by_batch(whole.filter("batch = 'x'"), 3)
    assert {r["part"] for r in found.collect()} == {"column", "row", "c", "r", "u"}
    assert BC.cur_by_batch(whole.filter("false"), 3).count() == 0
    with pytest.raises(ValueError):
        BC.cur_by_batch(whole, 0)


@pytest.mark.parametrize("matrix", [BASIS, np.abs(RNG.normal(size=(30, 3))) @ np.abs(RNG.normal(size=(3, 12)))], ids=["full", "low rank"])
def test_errors_equal_those_of_the_product_and_fall(spark, matrix):
    ranks = (1, 3, 6, 12)
    found = {r["rank"]: r["error"] for r in BC.rebuilding_errors(sparse(spark, matrix), ranks).collect()}
    f = R.cur(sparse(spark, matrix), max(ranks))
    cols = [int(x["token"][1:]) for x in f.columns.orderBy("j").collect()]
    rows = [x["doc_id"] for x in f.rows.orderBy("i").collect()]
    for n in ranks:
        c, r = matrix[:, cols[:n]], matrix[rows[:n]]
        rebuilt = c @ np.linalg.pinv(c) @ matrix @ np.linalg.pinv(r) @ r
        wanted = np.linalg.norm(matrix - rebuilt) / np.linalg.norm(matrix)
        assert found[n] == pytest.approx(wanted, abs=1e-6)
    assert all(found[a] >= found[b] - 1e-6 for a, b in zip(ranks, ranks[1:]))
