import random

import numpy as np
import pytest
from helpers import SF, rows

from themeforge.llm import topk


def plain(vectors: dict[int, list[float]], k: int = 5, every: int = 50):
    whole = {i: np.floor(256 * np.array(v, float)).astype(int).tolist() for i, v in vectors.items()}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        scored = sorted(
            (-sum(a * b for a, b in zip(whole[q], c)), i) for i, c in whole.items() if i != q
        )
        out += [
            {"query_id": q, "rank": r + 1, "vec_id": i, "score": -s} for r, (s, i) in enumerate(scored[:k])
        ]
    return out


def ordered(df):
    return sorted(rows(df), key=lambda r: (r["query_id"], r["rank"]))


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_table_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows(table)}
    assert ordered(topk.top_k(table)) == plain(vectors)


@pytest.mark.parametrize("rows_of_block", [7, 1024])
def test_ties_copies_and_clusters(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", rows_of_block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "FIRST_STEP", 2)
    rng = random.Random(3)
    centre = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(3)]
    vectors = {
        i: [np.float32(round(x + (i % 4 == 0) * rng.uniform(-0.02, 0.02), 3)).item() for x in centre[i % 3]]
        for i in range(220)
    }
    found = ordered(topk.top_k(frame(spark, list(vectors.items()))))
    assert found == plain(vectors)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(0)
    centre = rng.integers(-200, 200, (8, 4))
    c = centre[rng.integers(0, 8, 2000)] + rng.integers(-3, 4, (2000, 4))
    norm = float((c.astype(float) ** 2).sum(1).max())
    pivots = centre.astype(float)
    own = (pivots**2).sum(1)
    dots = c @ pivots.T
    q_table = np.sqrt(np.maximum((c.astype(float) ** 2).sum(1)[:, None] + own - 2 * dots, 0))
    c_table = np.sqrt(np.maximum(own - 2 * dots + norm, 0))
    ids = np.arange(2000)
    found = topk.search_block(ids[:20], c[:20], q_table[:20], ids, c, c_table, norm, 5, True)
    for q in range(20):
        scores = c @ c[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert [(-x[2], x[1]) for x in found if x[0] == q] == best


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [0.5, 0.5]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, []),
        (1, [1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [9.0, 9.0]), (3, [0.25, 0.0, 4.0]),
    ]
    table = frame(spark, data).selectExpr("*", "1 AS v", "2 AS rank", "3 AS score", "4 AS qb")
    assert ordered(topk.top_k(table)) == plain({0: [0.5, 0.5], 250: [0, 0], 1: [1.0, 0], 2: [1.0, 1.0], 3: [0.25, 0.0]})


def test_wide_values_use_integers(spark):
    big = 2.0**19
    data = [(0, [big, big]), (1, [big, big]), (2, [big, -big]), (3, [big, big * 0.5])]
    found = ordered(topk.top_k(frame(spark, data)))
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 2**55), (3, 3 * 2**53), (2, 0)]


def test_empty_and_single(spark):
    assert rows(topk.top_k(frame(spark, []))) == []
    assert rows(topk.top_k(frame(spark, [(0, [1.0])]))) == []
