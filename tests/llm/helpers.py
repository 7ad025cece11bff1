"""Plain versions to compare with, and odd tables."""

from __future__ import annotations

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"


def rows(df) -> list[dict]:
    return df.toArrow().to_pylist()


def documents(spark, sf_dir: str = SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs_of(spark, texts, first: int = 0):
    """(doc_id, text) of some texts."""
    data = [(first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string")


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = "Das ist ein sehr langer Text und mehr. " * 30_000
    data = [
        (1, None, "x", 1), (2, "", "x", 2), (3, "   \n\t ", "x", 3), (4, long, "x", 4),
        (5, "Same words here and there again", "x", 5), (5, "Same words here and there again", "x", 5),
        (None, "a text without an id", None, None), (6, "ünïcode \U0001f600 ÄÖ 12 ½ \x1c\x85 end", "x", 6),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long")
    return frame.selectExpr(
        "doc_id", "text", "lang", "'s' AS source", "n_chars", "1.5D AS score", "'k' AS id", "7 AS fp",
        "'w' AS words", "0 AS component_id", "0 AS _now", "'q' AS spans",
    )


def simhash_of(text: str | None, words: int = 3) -> int:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(keys: list, values: np.ndarray, radius: int) -> dict:
    """By key, the smallest key it reaches over links of at most ``radius`` bits."""
    label = dict(zip(keys, keys))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= radius) for v in values]
    changed = True
    while changed:
        changed = False
        for k, hits in zip(keys, near):
            least = min(label[keys[j]] for j in hits)
            if least < label[k]:
                label[k], changed = least, True
    return label
