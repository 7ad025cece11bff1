"""Neighbours by cells: exact, few cells visited where vectors form clusters, recall by learned probes."""

import numpy as np
import pytest

from themeforge.operators import cells as K
from themeforge.operators import dense as D

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(12, 8)) * 20
CLUSTERED = CENTRES[RNG.integers(0, 12, 600)] + RNG.normal(size=(600, 8))
EVEN = RNG.normal(size=(400, 8))


def frame(spark, matrix, id, first=0):
    rows = [(first + i, v.tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{id} long, v array<double>").repartition(4)


def found(df, score="distance"):
    return sorted((r["q"], r["rank"], r["r"], round(r[score], 9)) for r in df.collect())


@pytest.mark.parametrize("matrix", [CLUSTERED, EVEN], ids=["clustered", "even"])
@pytest.mark.parametrize("cells, block_rows", [(12, 20_000), (30, 16), (1, 50)])
def test_search_is_exact(spark, matrix, cells, block_rows):
    q, r = frame(spark, matrix[:60] + 0.1, "q"), frame(spark, matrix, "r")
    index = K.build_cells(r, "r", "v", cells)
    got = found(K.search(q, index, 7, "q", "v", block_rows=block_rows))
    assert got == found(D.nearest(q, r, 7, "q", "v", "r", "v"))


def test_few_cells_are_visited_where_vectors_cluster(spark):
    q, r = frame(spark, CLUSTERED[:60], "q"), frame(spark, CLUSTERED, "r")
    index = K.build_cells(r, "r", "v", 12)
    _, first, _, second = K.visited(q, index, 5, "q", "v")
    assert first.count() + second.count() < 0.25 * 60 * 12
    assert K.learn_probes(q, index, 5, "q", "v") <= 3


def test_more_neighbours_than_a_cell_or_all_cells_hold(spark):
    q, r = frame(spark, EVEN[:9], "q"), frame(spark, EVEN[:40], "r")
    index = K.build_cells(r, "r", "v", 10)
    for k in (15, 40, 100):
        assert found(K.search(q, index, k, "q", "v")) == found(D.nearest(q, r, k, "q", "v", "r", "v"))
        assert K.search_probed(q, index, k, "q", "v", 1).count() == 9 * min(k, 40)


@pytest.mark.parametrize("matrix", [CLUSTERED, EVEN], ids=["clustered", "even"])
def test_learned_probes_reach_the_recall(spark, matrix):
    q, r = frame(spark, matrix[:200], "q"), frame(spark, matrix, "r")
    index = K.build_cells(r, "r", "v", 16)
    probes = K.learn_probes(q, index, 10, "q", "v", recall=0.95, sample_queries=100)
    exact = {(a, c) for a, _, c, _ in found(D.nearest(q, r, 10, "q", "v", "r", "v"))}
    probed = {(a, c) for a, _, c, _ in found(K.search_probed(q, index, 10, "q", "v", probes))}
    assert len(exact & probed) >= 0.9 * len(exact)
    every = K.search_probed(q, index, 10, "q", "v", 16)
    assert {(a, c) for a, _, c, _ in found(every)} == exact


def test_sample_is_bounded_and_every_row_assigned(spark):
    r = frame(spark, CLUSTERED, "r")
    index = K.build_cells(r, "r", "v", 12, sample_rows=50)
    assert index.rows == 600 == index.members.count() and len(index.centres) <= 12
    q = frame(spark, CLUSTERED[:30], "q")
    assert found(K.search(q, index, 4, "q", "v")) == found(D.nearest(q, r, 4, "q", "v", "r", "v"))


def test_nulls_ties_and_empty_tables(spark):
    r = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [5.0, 5.0])], "r long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "q long, v array<double>")
    index = K.build_cells(r, "r", "v", 3)
    assert found(K.search(q, index, 3, "q", "v")) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 4, round(41**0.5, 9))]
    none = K.build_cells(r.filter("r > 9"), "r", "v", 3)
    assert K.search(q, none, 3, "q", "v").count() == 0 == K.search_probed(q, none, 3, "q", "v", 2).count()
    assert K.search(q.filter("q > 5"), index, 3, "q", "v").count() == 0
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "r long, v array<double>")
    with pytest.raises(ValueError, match="components"):
        K.build_cells(ragged, "r", "v", 2)


@pytest.mark.parametrize("matrix, sigma", [(CLUSTERED, 2.0), (EVEN, 1.0), (CLUSTERED, 200.0)], ids=["far cells", "even", "flat"])
@pytest.mark.parametrize("tolerance", [1e-9, 1e-2])
def test_kernel_mass_is_right_within_its_error(spark, matrix, sigma, tolerance):
    q, r = frame(spark, matrix[:40] + 0.05, "q"), frame(spark, matrix, "r")
    groups = r.selectExpr("r", "r % 3 AS g")
    index = K.build_cells(r, "r", "v", 24)
    got = {(x["q"], x["g"]): x for x in K.kernel_mass(q, groups, index, "q", "g", "v", sigma, tolerance).collect()}
    values = np.exp(-0.5 * (D.compare(matrix[:40] + 0.05, matrix, "euclidean") / sigma) ** 2)
    used = 0
    for i in range(40):
        for g in range(3):
            x, mine = got[i, g], values[i, g::3]
            assert x["n"] == len(mine) and x["error"] <= tolerance * x["n"]
            assert abs(x["mass"] - mine.sum()) <= x["error"] + 1e-9 * x["n"]
            used += x["error"] > 0
    assert len(got) == 120 and (used > 0 or matrix is EVEN or sigma * tolerance < 1e-6)
