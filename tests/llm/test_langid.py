import itertools
import random
import zlib

import numpy as np
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import langid

EN = "the cat and the dog were in the house with three things that they thought were theirs"
DE = "der hund und die katze waren im haus mit drei dingen die sie schon lange hatten"
RU = "кошка и собака были в доме с тремя вещами которые они любили"


def model(spark):
    data = [(i, t, l) for i, (t, l) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)]
    return langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))


def best_by_trying_all(scores, penalty):
    n, k = scores.shape
    value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 7, 5)
        scores = rng.normal(0, 3, (counts.sum(), 3))
        labels = langid.viterbi(scores, counts, 4.0) if counts.sum() else []
        at = 0
        for n in counts:
            part, own = scores[at : at + n], labels[at : at + n]
            if n:
                top, value = best_by_trying_all(part, 4.0)
                assert abs(value(tuple(own)) - top) < 1e-6
            at += n


def test_held_out_documents(spark):
    docs = documents(spark)
    found = langid.identify(docs, langid.train(docs.filter(~langid.in_fold("doc_id"))))
    truth = {r["doc_id"]: r["lang"] for r in rows(docs)}
    held = [r for r in rows(found) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows(found))


def test_spans_of_mixed_text(spark):
    text = f"{EN}. {RU} 123 {DE}!"
    (r,) = rows(langid.identify(docs_of(spark, [text]), model(spark)))
    assert [s["lang"] for s in r["spans"]] == ["en", "ru", "de"]
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == [EN, RU, DE]


def test_scripts_narrow_the_candidates(spark):
    m = model(spark)
    cyrillic = langid.SCRIPTS.index("cyrillic")
    assert [l for l, k in zip(m["langs"], m["known"][cyrillic]) if k] == ["ru"]
    (r,) = rows(langid.identify(docs_of(spark, ["мир"]), m))
    assert (r["lang_pred"], r["score"]) == ("ru", 1.0)


def test_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice([EN, DE, RU]) for _ in range(8)) for _ in range(5)]
    m = model(spark)
    whole = [langid._label([t], m, 12.0, True) for t in texts]
    monkeypatch.setattr(langid, "PIECE_CHARS", 37)
    monkeypatch.setattr(langid._pieces, "__defaults__", (37,))
    assert [langid._label([t], m, 12.0, True) for t in texts] == whole


def test_odd_rows(spark):
    m = model(spark)
    found = {r["doc_id"]: r for r in rows(langid.identify(odd_docs(spark), m))}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and not found[i]["spans"] for i in (1, 2, 3))
    assert found[4]["lang_pred"] == "de" and found[None]["lang_pred"] == "en"
    kept = langid.keep_identified(odd_docs(spark), m)
    assert kept.schema == odd_docs(spark).schema
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 4, 5, 5, 6]


def test_untrained_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = langid.train(empty)
    assert rows(langid.identify(docs_of(spark, [EN]), m))[0]["lang_pred"] == "und"
    assert rows(langid.identify(empty, model(spark))) == []
    nulls = spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    assert langid.train(nulls)["langs"] == []


def test_folds(spark):
    frame = spark.range(50).selectExpr("IF(id = 7, NULL, id) AS doc_id").select("doc_id", langid.in_fold("doc_id").alias("f"))
    for r in rows(frame):
        expected = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["f"] == expected
