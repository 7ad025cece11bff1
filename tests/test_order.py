import hashlib

import pytest
from pyspark.sql import functions as F

from themeforge.operators import ordering as O
from themeforge.operators import splits as P
from themeforge.sources import batches as B


def shuffled(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def test_row_positions(spark):
    df = spark.range(1000).withColumn("k", F.reverse(F.col("id").cast("string")))
    found = {r["k"]: r["position"] for r in O.row_positions(df, ["k"]).collect()}
    assert found == {k: i for i, k in enumerate(sorted(found))} and len(found) == 1000


def test_group_positions_with_a_hot_group(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    rows = O.group_positions(df, ["g"], ["id"]).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        groups.setdefault(r["g"], []).append(r)
    for members in groups.values():
        assert [m["position"] for m in members] == list(range(len(members)))
        assert {m["group_rows"] for m in members} == {len(members)}


@pytest.mark.parametrize("n", [1, 3, 10, 257])
def test_hash_cuts(spark, n):
    df = spark.range(n)
    order = shuffled(range(n), 5)
    cuts = O.hash_cuts(df, "id", 5, {"none": F.lit(0), "half": F.floor(F.col("n") / 2), "all": F.col("n")})
    for name, size in (("none", 0), ("half", n // 2), ("all", n)):
        kept = df.filter(O.order_hash("id", 5) <= cuts[name]).collect()
        assert {r["id"] for r in kept} == set(order[:size]), name


@pytest.mark.parametrize("n", [1, 7, 100])
def test_holdout_is_disjoint_and_complete(spark, n):
    parts = {r["id"]: r["part"] for r in P.holdout(spark.range(n), "id").collect()}
    order, cut = shuffled(range(n), 42), int(0.7 * n)
    assert [parts[i] for i in order] == ["train"] * cut + ["test"] * (n - cut)


REPEATED = [(i % 4, i // 8, f"v{i % 3}") for i in range(40)] + [(None, 0, "n")] * 3 + [(1, None, "g")] * 2


def test_repeated_keys_keep_every_row(spark):
    df = spark.createDataFrame(REPEATED, "id long, source_file long, v string")
    for found in (
        B.assign_batch(df, "id", 6), B.rebatch_files(df, "id", rows=3),
        P.head_tail(df, 0.85, "source_file", "id"), P.folds(df, 3, "id"), P.holdout(df, "id"),
    ):
        rows = found.select("id", "source_file", "v").collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, REPEATED))
    sizes = [r["count"] for r in B.assign_batch(df, "id", 6).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [6] * 7 + [3]
    sides = P.holdout(df, "id").select("id", "part").distinct()
    assert sides.count() == df.select("id").distinct().count()


def test_three_way_sizes(spark):
    for n, sizes in ((100, (60, 20, 20)), (10, (6, 2, 2)), (11, (6, 2, 3))):
        rows = [r["part"] for r in P.three_way(spark.range(n), "id").collect()]
        assert tuple(rows.count(p) for p in ("train", "validation", "test")) == sizes


def test_folds_balance(spark):
    rows = P.folds(spark.range(23).withColumnRenamed("id", "doc_id"), 5).collect()
    sizes = [sum(r["fold"] == f for r in rows) for f in range(5)]
    assert sorted(sizes) == [4, 4, 5, 5, 5]


def test_samples(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 12).cast("string").alias("source"))
    few = P.sample_per_file(df, 2)
    assert {(r["source"], r["count"]) for r in few.groupBy("source").count().collect()} == {
        (str(i), 2) for i in range(12)
    }
    batches = P.sample_batches(df, 0.25)
    assert batches.count() == 15 and batches.select("source").distinct().count() == 3


@pytest.mark.parametrize("n,rows,expected", [(10, 5, [5, 5]), (11, 5, [5, 5, 1]), (3, 5, [3])])
def test_batches_partition_the_rows(spark, n, rows, expected):
    found = B.assign_batch(spark.range(n), "id", rows).collect()
    for b, size in enumerate(expected):
        assert sorted(r["id"] for r in found if r["batch_id"] == b) == list(range(b * rows, b * rows + size))


def test_rebatch_and_head_tail(spark):
    df = spark.range(25).withColumn("source_file", F.when(F.col("id") < 19, "a").otherwise("b"))
    sizes = B.rebatch_files(df, "id", rows=10).groupBy("source_file", "batch_id").count().collect()
    assert sorted(map(tuple, sizes)) == [("a", 0, 10), ("a", 1, 9), ("b", 0, 6)]
    parts = P.head_tail(df, 0.85, "source_file", "id").collect()
    head = {f: sorted(r["id"] for r in parts if r["source_file"] == f and r["part"] == "head") for f in "ab"}
    assert head == {"a": list(range(16)), "b": list(range(19, 24))}


def test_pending_and_progress(spark):
    todo = spark.range(10).withColumnRenamed("id", "batch_id")
    left = B.pending(todo, todo.filter("batch_id < 7"), ["batch_id"])
    assert sorted(r["batch_id"] for r in left.collect()) == [7, 8, 9]
    row = B.progress(todo, F.col("batch_id") < 7).first()
    assert (row["done"], row["total"], row["percent"]) == (7, 10, 70.0)
