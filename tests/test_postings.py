import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeforge.operators import postings as P
from themeforge.operators.vocab import term_counts, token_stats
from themeforge.operators.weights import fit_idf, row_total
from themeforge.plans import holdout as H
from themeforge.session import shared_dir, stage, unstage

TEXTS = [
    (1, "a", "Oil oil bank, the bank of oil"), (2, "a", "don't film-oil"), (3, "b", ""), (4, "b", None),
    (5, None, "bank film bank"), (6, "b", "İstanbul café oil Kilo x"), (7, "a", "the of and"),
    (8, "b", "z"), (1, "b", "film bank oil"), (1, "a", "oil oil"), (None, "a", "oil film"), (None, "b", "bank"),
]


@pytest.fixture(scope="module", params=["long", "string"])
def docs(spark, request):
    rows = spark.createDataFrame(TEXTS, "doc_id long, class string, text string")
    part = F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 2, "test").otherwise("train")
    return rows.withColumn("part", part).withColumn("doc_id", F.col("doc_id").cast(request.param))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("grams", [(1, 1), (1, 2), (2, 3)])
def test_postings_hold_what_counts_hold(docs, grams):
    counts = term_counts(docs, ("doc_id", "class", "part"), ngram_range=grams)
    packed = P.term_postings(docs, ngram_range=grams)
    stats = P.postings_stats(packed)
    assert rows_of(stats, "token", "df", "tf") == rows_of(token_stats(counts), "token", "df", "tf")
    known = stats.withColumn("other", P.bucket("token", F.lit(4)))
    assert known.filter("other <> bucket").count() == 0


@pytest.mark.parametrize("texts", [2000, 3])
def test_packed_evaluation_equals_rows(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_DOCS", texts)
    keys = ("doc_id", "class", "part")
    long = H.Split(docs.select(*keys), term_counts(docs, keys, ngram_range=(1, 2)))
    packed = H.Split(docs.select(*keys), P.term_postings(docs, keys[1:], ngram_range=(1, 2)))
    for fit in ("train", "all"):
        a, b = (H.class_distances(s.docs, H.weigh(s, fit, 1)).collect() for s in (long, packed))
        order = lambda r: repr((*r[:4], round(r[4], 6)))
        a, b = sorted(a, key=order), sorted(b, key=order)
        assert len(a) == len(b) == 24
        for x, y in zip(a, b):
            assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-6) and x[5] == pytest.approx(y[5])


def test_without_a_known_token(spark, docs):
    keys = ("doc_id", "class", "part")
    split = H.Split(docs.select(*keys), P.term_postings(docs, keys[1:]))
    found = H.class_distances(split.docs, H.weigh(split, "all", 99)).collect()
    assert found == [] or all(r["unit_distance"] is None for r in found)
    assert fit_idf(P.postings_stats(split.counts), row_total(docs), 99).count() == 0


def test_a_split_keeps_few_rows(spark):
    """What is shuffled grows by chunk and bucket, not by document and token."""
    texts = [(i, "ab"[i % 2], " ".join(f"{'abcdefgh'[j % 8]}{'xyz'[(i + j) % 3]}word" for j in range(60))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, class string, text string")
    split = H.split_documents(docs)
    pairs = term_counts(docs, ngram_range=(1, 2)).count()
    assert split.counts.count() * 50 < pairs
    assert split.counts.agg(F.sum(F.size(F.split("tokens", "\n")))).first()[0] * 10 < pairs


def size_of(table):
    files = Path(table._themeforge_path.removeprefix("file:")).rglob("*.parquet")
    return sum(f.stat().st_size for f in files)


@pytest.fixture(scope="module")
def prose(spark):
    """Texts in which half of the word pairs are rare."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (3000, 7))])
    texts = [(i, "xy"[i % 2], " ".join(words[np.minimum(rng.zipf(1.3, 300), 3000) - 1])) for i in range(600)]
    return spark.createDataFrame(texts, "doc_id long, class string, text string").repartition(8).cache()


def test_counts_and_weights_take_less_room_than_their_texts(prose):
    text = prose.agg(F.sum(F.length("text"))).first()[0]
    split = H.split_documents(prose)
    weights = H.weigh(split)
    assert size_of(split.counts) < 0.6 * text and size_of(weights) < 0.8 * text


def test_a_holdout_drops_what_it_has_read(spark, prose):
    kept = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = kept()
    H.evaluate_holdout(prose)
    left = {name.rsplit("-", 1)[0] for name in kept() - before}
    assert "weights" in left and not left & {"counts", "vocabulary", "chunk-vocabularies"}


def test_a_written_table_leaves_no_shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in held for f in Path(d).rglob("shuffle_*.data")}
    spark.range(9).repartition(3).groupBy("id").count().collect()
    before = files()
    assert before
    table = stage(spark.range(100_000).repartition(7).groupBy(F.col("id") % 999).count(), "sums")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 999
    unstage(table, spark.range(3))
    assert not Path(table._themeforge_path.removeprefix("file:")).exists()


def test_rounds_give_what_one_pass_gives(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_DOCS", 2)
    keys = ("doc_id", "class", "part")
    split = H.Split(docs.select(*keys), P.term_postings(docs, keys[1:], ngram_range=(1, 2)))
    weights = H.weigh(split, "all", 1)
    one = rows_of(H.class_distances(split.docs, weights), "*")
    monkeypatch.setattr(P, "ROUND_CHUNKS", 1)
    many = rows_of(H.class_distances(split.docs, weights), "*")
    assert len(one) == len(many) == 24
    for x, y in zip(one, many):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-9) and x[5] == pytest.approx(y[5])


def test_weights_of_repeated_ids_count_in_each_of_their_folds(spark, docs):
    runs = range(3)
    members = docs.select("doc_id", "class").withColumn("train_in", F.array(*[F.lit(i) for i in runs]))
    members = members.withColumn("train_in", F.array_remove("train_in", F.length("class") % 3)).localCheckpoint()
    times = F.concat_ws(",", *[F.count_if(F.array_contains("train_in", i)).cast("string") for i in runs])
    by_id = members.groupBy("doc_id").agg(times.alias("times"), F.count("*").cast("int").alias("copies"))
    packed = H._weighed_once(docs.join(by_id, "doc_id", "left"), 1)
    assert P.is_packed(packed)
    keys = ("doc_id", "class", "part")
    whole = docs.withColumn("part", F.lit("all"))
    plain = H.weigh(H.Split(whole.select(*keys), term_counts(whole, keys, ngram_range=(1, 2))), "all", 1)
    each = plain.join(members.select("doc_id", "train_in"), "doc_id")
    for i in runs:
        want = each.filter(F.array_contains("train_in", i)).groupBy("class", "token").agg(F.sum("weight"), F.sum("unit"))
        n = F.split("times", ",")[i].cast("double")
        have = P.token_weights(packed).filter(n > 0).groupBy("class", "token").agg(F.sum(n * F.col("weight")), F.sum(n * F.col("unit")))
        want, have = (sorted(map(tuple, t.collect()), key=repr) for t in (want, have))
        assert [r[:2] for r in want] == [r[:2] for r in have]
        assert [x for r in want for x in r[2:]] == pytest.approx([x for r in have for x in r[2:]])
