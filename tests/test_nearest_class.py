"""The nearest class by bounds equals the nearest of all, and looks into few blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeforge.operators import nearest_class as N

RNG = np.random.default_rng(21)


def frames(spark, docs, centres):
    weights = [(int(i), f"t{j}", float(docs[i, j])) for i, j in zip(*np.nonzero(docs))]
    cells = [(f"c{i:03d}", f"t{j}", float(centres[i, j])) for i, j in zip(*np.nonzero(centres))]
    return (
        spark.createDataFrame([(i,) for i in range(len(docs))], "doc_id long"),
        spark.createDataFrame(weights, "doc_id long, token string, weight double"),
        spark.createDataFrame(cells, "label string, token string, weight double"),
        spark.createDataFrame([(f"c{i:03d}",) for i in range(len(centres))], "label string"),
    )


def plain(docs, centres):
    out = {}
    for i, d in enumerate(docs):
        gaps = np.round(np.sqrt(((centres - d) ** 2).sum(1)), 9)
        k = int(np.lexsort((np.arange(len(centres)), gaps))[0])
        out[i] = (f"c{k:03d}", gaps[k])
    return out


def topics(n, m, n_topics=30, width=240):
    """Classes and documents that each use the words of a topic and a few common ones."""
    words = width // n_topics
    centres, docs = np.zeros((m, width)), np.zeros((n, width))
    for rows, scale in ((centres, 1.0), (docs, 1.5)):
        for i in range(len(rows)):
            t = int(RNG.integers(n_topics))
            own = slice(t * words, (t + 1) * words)
            rows[i, own] = RNG.random(words) * scale * (RNG.random(words) < 0.7)
            rows[i, RNG.integers(0, width, 2)] += 0.05
    return docs, centres


@pytest.mark.parametrize("n_classes, fanout", [(5, 64), (40, 8), (90, 4), (17, 2), (64, 64), (65, 64)])
def test_equals_brute_force(spark, n_classes, fanout):
    docs, centres = topics(40, n_classes)
    docs[7] = 0.0  # without tokens
    docs[8] = 0.0
    docs[8, 0] = 5.0
    centres[3] = centres[1]  # equal distances rank by label
    centres[2] = 0.0 if n_classes > 20 else centres[2]
    found = N.nearest_class(*frames(spark, docs, centres), fanout=fanout)
    got = {r["doc_id"]: (r["label"], round(r["distance"], 9)) for r in found.collect()}
    wanted = plain(docs, centres)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(got[k][1] == pytest.approx(wanted[k][1], abs=1e-7) for k in got)


def test_few_blocks_are_looked_into(spark):
    docs, centres = topics(50, 400)
    frame, weights, cells, names = frames(spark, docs, centres)
    tree = N.class_tree(cells, names, fanout=8)
    assert len(tree.tops) == 2
    slim = weights.select("doc_id", "token", F.col("weight").alias("w"))
    sizes = slim.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    first, second = N.looked_into(slim, sizes, tree, "doc_id")
    assert first.count() == 50
    assert first.count() + second.count() < 0.2 * 50 * 50


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "doc_id long, part string")
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "q", 3.0)], "doc_id long, token string, weight double")
    cells = spark.createDataFrame([("k", "a", 2.0), ("l", "b", 1.0), (None, "a", 1.0)], "label string, token string, weight double")
    names = spark.createDataFrame([("k",), ("l",), (None,)], "label string")
    found = {r["doc_id"]: (r["part"], r["label"], r["distance"]) for r in N.nearest_class(docs, weights, cells, names).collect()}
    assert found[1] == ("x", "k", 1.0) and found[2] == ("y", "l", pytest.approx(10**0.5)) and found[None] == ("z", "l", 1.0)
    none = N.nearest_class(docs, weights, cells.filter("false"), names.filter("false"))
    assert {r["label"] for r in none.collect()} == {None}
    assert N.nearest_class(docs.filter("false"), weights, cells, names).count() == 0
