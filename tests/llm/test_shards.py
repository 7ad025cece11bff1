import zlib

import pytest
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import shards


def check(found, texts, n):
    """Contiguous shards, gapless slots, and sizes within one row of the target."""
    assert len(found) == len(texts)
    ordered = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    for s in {r["shard"] for r in found}:
        own = [r["slot"] for r in ordered if r["shard"] == s]
        assert own == list(range(len(own))) and 0 <= s < n
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(n)]
    largest = max(r["size"] for r in found)
    assert max(abs(x - sum(sizes) / n) for x in sizes) <= largest
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == expected


def test_documents(spark):
    check(rows(shards.byte_shards(documents(spark))), [r["text"] for r in rows(documents(spark))], 8)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_odd_rows(spark, n):
    check(rows(shards.byte_shards(odd_docs(spark), n)), [r["text"] for r in rows(odd_docs(spark))], n)


def test_empty_table_and_equal_ids(spark):
    assert rows(shards.byte_shards(docs_of(spark, []))) == []
    frame = spark.createDataFrame([(1, "x" * (i % 7)) for i in range(500)], "doc_id long, text string")
    check(rows(shards.byte_shards(frame, 4)), ["x" * (i % 7) for i in range(500)], 4)


def test_plan_has_no_python(spark):
    plan = shards.byte_shards(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
