import re

import pytest
from helpers import SF, docs_of, documents, odd_docs, rows

from themeforge.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(texts, items, n=10):
    """Per text: number of words, hit words, found items, by looking everywhere."""
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - n + 1)):
                named = windows.setdefault(tuple(w[i : i + n]), set())
                named |= set() if item is None else {str(item)}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i : i + size]))
                if names is not None:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def benchmark(spark, data):
    return spark.createDataFrame(data, "item_id long, text string")


def shown(r):
    return r["n_words"], [i for x in r["ranges"] for i in range(x["first"], x["end"])], r["items"]


def test_documents_match_brute_force(spark):
    table = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    expected = dict(zip(docs, plain(docs.values(), [(r["item_id"], r["text"]) for r in rows(table)])))
    found = {r["doc_id"]: shown(r) for r in rows(decontaminate.scan(documents(spark), table))}
    assert found == expected
    assert any(e[2] for e in expected.values())


ITEMS = [
    (1, "alpha beta gamma"), (2, "Beta, GAMMA"), (2, "one more text of item two"), (3, None), (4, "  ,.! "),
    (None, "no id here"), (5, " ".join(f"w{i}" for i in range(25))), (6, "ÄB ñ Ⅷ"), (7, "beta gamma"),
]
TEXTS = [
    "ALPHA-beta\n\ngamma delta", "beta gamma beta gamma", None, "", "w3 w4", "x " + " ".join(f"W{i}" for i in range(4, 20)) + " y",
    "no id here", "Äb ñ Ⅷ and äb ñ ⅷ", "one more text of item two" + " filler" * 5000,
]


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_odd_items_and_texts(spark, most):
    found = rows(decontaminate.scan(docs_of(spark, TEXTS), benchmark(spark, ITEMS), max_windows=most))
    assert [shown(r) for r in sorted(found, key=lambda r: r["doc_id"])] == plain(TEXTS, ITEMS)
    for r in found:
        text = TEXTS[r["doc_id"]] or ""
        for span, place in zip(r["spans"], r["ranges"]):
            assert words(text[span["start"] : span["end"]]) == words(text)[place["first"] : place["end"]]


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_clean_rows_stay_unchanged(spark, most):
    kept = rows(decontaminate.keep_clean(docs_of(spark, TEXTS), benchmark(spark, ITEMS), max_windows=most))
    dirty = [bool(e[1]) for e in plain(TEXTS, ITEMS)]
    assert {r["doc_id"] for r in kept} == {i for i, d in enumerate(dirty) if not d}
    assert all(r["text"] == TEXTS[r["doc_id"]] for r in kept)


def test_items_without_an_id_hit_too(spark):
    found = {r["doc_id"]: shown(r) for r in rows(decontaminate.scan(docs_of(spark, TEXTS), benchmark(spark, ITEMS)))}
    assert found[6] == (3, [0, 1, 2], [])
    kept = rows(decontaminate.keep_clean(docs_of(spark, TEXTS), benchmark(spark, ITEMS)))
    assert 6 not in {r["doc_id"] for r in kept}


def test_empty_tables_and_clashing_columns(spark):
    none = benchmark(spark, [])
    assert all(not r["items"] for r in rows(decontaminate.scan(odd_docs(spark), none)))
    assert len(rows(decontaminate.keep_clean(odd_docs(spark), none))) == odd_docs(spark).count()
    assert rows(decontaminate.scan(docs_of(spark, []), benchmark(spark, ITEMS))) == []
    found = decontaminate.scan(odd_docs(spark), benchmark(spark, [(1, "here and there")]))
    assert sorted((r["doc_id"] or 0) for r in rows(found) if r["items"]) == [5, 5]
