import re

import corpus_pipeline
from helpers import SF, documents, odd_docs, rows
from test_bpe import digests
from test_decontaminate import plain
from test_near_copies import plain_kept
from test_secrets import plain_base, plain_entropy

from themeforge.llm import langid


def masked(text):
    spans = sorted(
        [s for own in plain_base(text).values() for s in own] + plain_entropy(text)
    )
    united = []
    for a, b in spans:
        if united and a < united[-1][1]:
            united[-1][1] = max(b, united[-1][1])
        else:
            united.append([a, b])
    out, at = [], 0
    for a, b in united:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def expected(spark, docs, items):
    """The stages one after another on lists of (id, text)."""
    model = langid.train(docs.filter(~langid.in_fold("doc_id")))
    labels = {r["doc_id"]: r for r in rows(langid.identify(docs, model))}
    kept = sorted(
        (r["doc_id"], r["text"]) for r in rows(docs)
        if labels[r["doc_id"]]["lang_pred"] != "und" and labels[r["doc_id"]]["score"] >= 1 / 3
    )
    alone = plain_kept(dict(kept))
    kept = [(k, t) for k, t in kept if k in alone]
    hits = plain([t for _, t in kept], items)
    kept = [(k, t) for (k, t), h in zip(kept, hits) if not h[1]]
    return {k: {"doc_id": k, **digests(masked(t))} for k, t in kept}


def test_run_equals_the_plain_stages(spark):
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    found = {r["doc_id"]: r for r in rows(corpus_pipeline.run(spark, SF))}
    assert found == expected(spark, documents(spark), items)
    assert 0 < len(found) < documents(spark).count()


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, docs, SF)
        assert after.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"
    ]


def test_odd_and_empty_documents(spark):
    columns = documents(spark).columns
    for docs in (odd_docs(spark).select(*columns, "score", "fp"), documents(spark).limit(0)):
        for _, apply in corpus_pipeline.STAGES:
            docs = apply(spark, docs, SF)
        docs.count()


def test_masking_is_whole(spark):
    docs = corpus_pipeline.secret_scan(spark, documents(spark), SF)
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    for r in rows(docs):
        assert r["text"] == masked(texts[r["doc_id"]])
        assert not re.search("AKIA[A-Z0-9]{12,}", r["text"]) and r["n_chars"] == len(r["text"])
