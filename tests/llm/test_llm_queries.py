"""Registered queries over whole tables, next to their SQL or to plain versions."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest
from helpers import SF, documents, odd_docs, rows

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from themeforge.llm.queries import oracles, registered  # noqa: E402


OTHER_TABLES = ("op1_top_k", "op7_chat", "op12_prefix_trie")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_all_are_registered():
    assert {n.split("_")[0] for n in registered()} == {f"op{i}" for i in range(1, 14)}
    assert set(registered()) | {"pipeline"} <= set(entry.queries())
    assert set(oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, duck, name):
    found = registered()[name](spark, SF).toArrow()
    assert compare.differences(found, duck.sql(oracles()[name]).to_arrow_table()) == []


def by_id(spark, name):
    return {r["doc_id"]: r for r in rows(registered()[name](spark, SF))}


def texts(spark):
    return {r["doc_id"]: r["text"] for r in rows(documents(spark))}


def test_tokens(spark):
    from test_bpe import digests

    found = by_id(spark, "op3_byte_bpe")
    assert found == {k: {"doc_id": k, **digests(t)} for k, t in texts(spark).items()}


def test_personal_data(spark):
    from test_pii import PATTERNS, plain_base, plain_found

    found, whole = by_id(spark, "op5_personal_data"), texts(spark)
    extra = plain_found(list(whole.values()))
    for (k, text), added in zip(whole.items(), extra.values()):
        base, names = plain_base(text), [*PATTERNS, "id"]
        shown = lambda spans: ",".join(f"{names[n]}:{a}:{b}" for a, n, b in sorted(spans))
        assert found[k] == {
            "doc_id": k, **{f"n_{x}": sum(s[1] == i for s in base) for i, x in enumerate(PATTERNS)},
            "base_sha256": hashlib.sha256(shown(base).encode()).hexdigest(),
            "spans": shown(base + [(a, 4, b) for a, b in added]),
        }


def test_licenses(spark):
    found = by_id(spark, "op6_licenses")
    for k, text in texts(spark).items():
        assert found[k]["n_paragraphs"] == sum(bool(line.strip()) for line in text.split("\n"))
        for span in filter(None, found[k]["spans"].split(",")):
            family, a, b = span.split(":")
            assert family in found[k]["families"] and "licens" in text[int(a) : int(b)].lower()


def test_shards(spark):
    found, whole = by_id(spark, "op8_shards"), texts(spark)
    sizes = [0] * 8
    for k, r in found.items():
        raw = whole[k].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found.values())


def test_fingerprints(spark):
    from helpers import simhash_of

    found, whole = by_id(spark, "op9_simhash"), texts(spark)
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{simhash_of(t):016x}" for k, t in whole.items()}


def test_languages(spark):
    found = by_id(spark, "op10_language")
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    assert list(found[0]) == ["doc_id", "held_out", "lang_pred", "score"]


def test_every_document_is_answered(spark):
    for name in registered():
        if name not in OTHER_TABLES:
            assert set(by_id(spark, name)) == set(texts(spark)), name


def test_odd_documents_pass_the_queries(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "here and there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, run in registered().items():
        if name not in OTHER_TABLES:
            assert run(spark, str(tmp_path)).count() == odd_docs(spark).count(), name
