"""The Merkle manifest equals a plain tree, and every tampered row is seen."""

import zlib
from hashlib import sha256

import pytest
from helpers import SF, docs_of, documents, odd_docs, rows
from pyspark.sql import functions as F

from themeforge.llm import merkle
from themeforge.llm.queries import registered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    if value is None:
        return "-"
    raw = str(value).encode()
    return f"{len(raw)}:{raw.decode()}"


def leaf_of(row) -> str:
    return h(field(row[f]) for f in FIELDS)


def up(level: list[str]) -> list[str]:
    return [h(level[i : i + 3]) for i in range(0, len(level), 3)]


def climb(levels: list[list[str]], place: int, fold: str) -> tuple[list[str], str]:
    siblings = []
    for level in levels[:-1]:
        a = place - place % 3
        run = level[a : a + 3]
        siblings += run[: place - a] + run[place - a + 1 :]
        run[place - a] = fold
        fold, place = h(run), place // 3
    return siblings, fold


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def is_tampered(row) -> bool:
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0


def plain(table: list[dict]) -> list[tuple]:
    by_source: dict = {}
    for row in table:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = tree([leaf_of(r) for r in by_source[name]])
    upper = tree([trees[name][-1][0] for name in names]) if names else []
    out = []
    for at, name in enumerate(names):
        for place, row in enumerate(by_source[name]):
            found = row
            if is_tampered(row) and row["text"] is not None:
                found = {**row, "text": row["text"].replace("\n", "")}
            lower, fold = climb(trees[name], place, leaf_of(found))
            higher, fold = climb(upper, at, fold)
            root = upper[-1][0]
            out.append((
                row["doc_id"], leaf_of(row), trees[name][-1][0], root, h(lower + higher), fold, fold == root
            ))
    return sorted(out, key=str)


def found(spark, docs) -> list[tuple]:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(docs, FIELDS, {"text": tampered.otherwise(F.col("text"))})
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    return sorted((tuple(r[n] for n in names) for r in rows(got)), key=str)


def test_documents(spark):
    docs = documents(spark)
    assert found(spark, docs) == plain(rows(docs))


def test_query(spark):
    got = {r["doc_id"]: r for r in rows(registered()["op11_merkle"](spark, SF))}
    wanted = plain(rows(documents(spark)))
    assert sorted((tuple(r.values()) for r in got.values()), key=str) == wanted
    texts = {r["doc_id"]: r for r in rows(documents(spark))}
    for k, r in got.items():
        assert r["verified"] == (not (is_tampered(texts[k]) and "\n" in texts[k]["text"]))
    assert not all(r["verified"] for r in got.values())


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (1, 1), (1, 2, 3, 4), (9, 10), (28, 1, 1, 1)])
def test_shapes(spark, sizes):
    data = [(s * 100 + i, f"s{s}", "en", i, f"text\n{i}") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(spark, docs) == plain(rows(docs))


def test_odd_documents(spark):
    odd = odd_docs(spark)
    mixed = odd.withColumn("source", F.when(F.col("doc_id") < 3, F.lit(None)).otherwise(F.lit("")).cast("string"))
    clash = mixed.selectExpr("*", "1 AS leaf", "2 AS level", "'x' AS node", "3 AS digest", "true AS verified", "4 AS tree")
    for docs in (odd, mixed, clash):
        assert found(spark, docs) == plain(rows(docs))
    empty = docs_of(spark, []).selectExpr("*", "'s' AS source", "'l' AS lang", "1L AS n_chars")
    assert found(spark, empty) == []
