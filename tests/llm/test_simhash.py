import random

import numpy as np
import pytest
from helpers import docs_of, documents, odd_docs, rows, simhash_of, smallest_reachable

from themeforge.llm import simhash
from themeforge.llm.components import components


def as_unsigned(x: int) -> int:
    return x & (1 << 64) - 1


@pytest.mark.parametrize("text", ["", None, "One", "one two", "A b c d e f g", "x\ty\n z " * 50])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == simhash_of(text)


def test_documents_match_brute_force(spark):
    found = rows(simhash.near_duplicates(documents(spark)))
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    keys = sorted(texts)
    prints = np.array([simhash_of(texts[k]) for k in keys], np.uint64)
    label = smallest_reachable(keys, prints, 3)
    assert {r["doc_id"]: as_unsigned(r["fp"]) for r in found} == dict(zip(keys, prints.tolist()))
    assert {r["doc_id"]: r["component_id"] for r in found} == label


def planted(seed: int, n: int) -> list[int]:
    """Chains and balls of fingerprints at distances one to five."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(base)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << bit
    return sorted(set(out[:n]))


@pytest.mark.parametrize("limit", [4096, 1])
def test_every_link_is_found(spark, limit):
    values = planted(7, 150)
    near = sum(((np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)) > 0).sum(1))
    assert near
    signed = [simhash._signed(v) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["component"] for r in rows(simhash.linked_fingerprints(frame, limit))}
    signed.sort()
    label = smallest_reachable(signed, np.array(signed, np.int64).view(np.uint64), 3)
    groups = list(label.values())
    assert found == {k: v for k, v in label.items() if groups.count(v) > 1}


@pytest.mark.parametrize("limit", [4096, 1])
def test_shared_blocks_find_every_link(spark, limit):
    signed = sorted(simhash._signed(v) for v in planted(8, 150))
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["component"] for r in rows(simhash.linked_fingerprints(frame, limit, simhash.shared_blocks))}
    label = smallest_reachable(signed, np.array(signed, np.int64).view(np.uint64), 3)
    groups = list(label.values())
    assert found == {k: v for k, v in label.items() if groups.count(v) > 1}


def test_links_at_each_distance(spark):
    for distance in range(1, 6):
        for bits in (range(distance), range(20, 20 + distance), range(64 - distance, 64), (0, 22, 45, 63, 30)[:distance]):
            other = simhash._signed(sum(1 << b for b in bits) ^ 0x5555555555555555)
            base = simhash._signed(0x5555555555555555)
            values = np.array([base, other], np.int64).view(np.uint64)
            assert len(simhash.forest(values)) == (distance <= 3)
    frame = spark.createDataFrame(
        [(simhash._signed(1 << 60 ^ sum(1 << b for b in bits)),) for bits in ((), (0, 30, 63), (0, 1, 2, 3))],
        "fp long",
    )
    assert len(rows(simhash.linked_fingerprints(frame))) == 2


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(6, 40)]
    frame = spark.createDataFrame(chain + star + [(9, 9)], "a long, b long")
    found = {r["node"]: r["component"] for r in rows(components(frame))}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}}


def test_odd_rows(spark):
    found = rows(simhash.near_duplicates(odd_docs(spark)))
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r["component_id"])
    assert by_id == {1: [1], 2: [1], 3: [1], 4: [4], 5: [5, 5], 6: [6], None: [None]}
    kept = simhash.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 4, 5, 6]


def test_empty_table(spark):
    assert rows(simhash.near_duplicates(docs_of(spark, []))) == []
    assert rows(simhash.keep_one(docs_of(spark, []))) == []


def test_rows_that_repeat_an_id_are_copies(spark):
    frame = spark.createDataFrame([(1, "b b b b"), (1, "a a a a"), (2, "c d e f")], "doc_id long, text string")
    assert sorted(rows(simhash.keep_one(frame)), key=str) == [
        {"doc_id": 1, "text": "a a a a"}, {"doc_id": 2, "text": "c d e f"}
    ]
