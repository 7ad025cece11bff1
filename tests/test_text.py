import pytest
from pyspark.sql import functions as F

from themeforge.functions.porter import porter_stem, stem
from themeforge.functions.text import line_pieces, ngrams, run_counts, split_title, words
from themeforge.operators import vocab as V

ROWS = [
    (1, ""), (2, "The of and"), (3, "Banks"), (4, "Rates rise.\nBanks don't raise rates; Rates rise."),
    (5, "x2y  z-z\t\nQuick"), (6, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id int, text string")


def one(df, key, column):
    return {r[key]: r[column] for r in df.collect()}


def test_words_replace(docs):
    found = one(docs.select("doc_id", words("text").alias("w")), "doc_id", "w")
    assert found[1] == [] and found[2] == [] and found[6] is None
    assert found[3] == ["banks"]
    assert found[4] == ["rates", "rise", "banks", "raise", "rates", "rates", "rise"]
    assert found[5] == ["x", "z", "z", "quick"]


def test_words_delete(docs):
    found = one(docs.select("doc_id", words("text", (), "delete").alias("w")), "doc_id", "w")
    assert found[4][3] == "dont"
    assert found[5] == ["xy", "zz", "quick"]


def test_unknown_mode():
    with pytest.raises(ValueError):
        words("text", mode="other")


def test_ngrams_match_plain_python(docs):
    def plain(ws, low, high):
        return [" ".join(ws[i:i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]

    for low, high in ((1, 1), (1, 2), (2, 3), (1, 4)):
        both = docs.select("doc_id", words("text").alias("w"), ngrams(words("text"), low, high).alias("g"))
        for row in both.collect():
            assert row["g"] == plain(row["w"] or [], low, high)


def test_run_counts(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["z"]), (4, ["q"] * 5)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    found = df.select("id", F.inline(run_counts(F.col("t"))))
    assert sorted(map(tuple, found.collect())) == [
        (1, "a", 1), (1, "b", 2), (3, "z", 1), (4, "q", 5)
    ]


def test_title_is_removed_everywhere(spark):
    rows = [(1, "Cup\nThe Cup final. Cup"), (2, "\nno title"), (3, "single")]
    found = split_title(spark.createDataFrame(rows, "id int, text string")).collect()
    assert [(r["title"], r["text"]) for r in found] == [
        ("Cup", "\nThe  final. "), ("", "\nno title"), ("single", "")
    ]


def test_line_pieces(spark):
    df = spark.createDataFrame([("a\nb  c d",)], "t string")
    for limit, expected in ((8000, ["a b  c d"]), (4, ["a b  c d"]), (3, ["a b c", "d"]), (1, list("abcd"))):
        assert df.select(line_pieces("t", limit).alias("x")).first()["x"] == expected


# Examples printed in the 1980 paper.
PAPER = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "plastered": "plaster",
    "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall",
    "filing": "file", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic",
    "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "airliner": "airlin", "replacement": "replac", "adoption": "adopt",
    "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "roll": "roll",
}


def test_porter_paper_examples():
    assert {w: porter_stem(w) for w in PAPER} == PAPER
    assert porter_stem("dies", amended=False) == "di" and porter_stem("dies") == "die"
    assert porter_stem("skies") == "sky" and porter_stem("happy") == "happi"
    assert porter_stem("enjoy") == "enjoy" and porter_stem("is") == "is"


def test_stem_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "running"), (2, None), (3, "running")], "id int, token string")
    assert one(df.select("id", stem("token").alias("s")), "id", "s") == {1: "run", 2: None, 3: "run"}


def test_stemmed_bigrams(spark):
    df = spark.createDataFrame([(1, "Running banks")], "doc_id int, text string")
    grams = V.tokens(df, ngram_range=(1, 2), stemming=True)
    assert sorted(r["token"] for r in grams.collect()) == ["bank", "run", "run bank"]


def test_counts_keep_token_zero(docs):
    indexed = V.index_vocabulary(V.tokens(docs).select("token").distinct())
    ids = one(indexed, "token", "token_id")
    assert sorted(ids, key=ids.get) == sorted(ids) and min(ids.values()) == 0
    bags = {r["doc_id"]: r for r in V.bag_of_words(docs, indexed).collect()}
    assert bags[3]["token_ids"] == [ids["banks"]] and ids["banks"] == 0
    assert bags[1]["token_ids"] == [] and bags[1]["n_words"] == 0 and len(bags) == len(ROWS)


def test_stems_are_put_back_by_position(spark):
    words = ["running", "banks", "skies", "the", "running", "dies"] * 40
    rows = [(1, " ".join(words)), (1, "banks"), (2, None), (3, ""), (None, "running skies")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = V.gram_lists(df, ["doc_id"], stop_words=["the"], stemming=True)
    got = sorted(((r["doc_id"] or 0), r["_g"] or []) for r in found.collect())
    stems = [porter_stem(w) for w in words if w != "the"]
    assert got == sorted([(1, stems), (1, ["bank"]), (2, []), (3, []), (0, ["run", "sky"])])


def test_stemmed_counts_keep_python_off_the_documents(spark):
    df = spark.createDataFrame([(1, "running runs"), (2, "banks")], "doc_id int, text string")
    counts = V.term_counts(df, stemming=True)
    assert {(r["doc_id"], r["token"]): r["c"] for r in counts.collect()} == {(1, "run"): 2, (2, "bank"): 1}
    assert "Python" not in counts._jdf.queryExecution().toString()


def test_stems_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, "running runs"), (2, "banks")], "doc_id int, text string")
    found = V.gram_lists(df, ["doc_id"], stemming=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_word" in line]
    assert len(joins) == 1 and "ShuffledHashJoin" in joins[0]
