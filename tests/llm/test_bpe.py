import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding(
    "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={}
)

TEXTS = [
    "Hello  world's best, 3.14%  ", "", " ", "\n\n a\tb \r\n", "a\x1cb\x85c\xa0d e　 f​g",
    "<|endoftext|> is ordinary", "naïve Ærø ½ ² Ⅷ ٣ नमस्ते 漢字 \U0001f600\U0001f468", "x" * 700 + " " * 300 + "y",
    "it's we've I'll 'S 's", "́ͅa", "١٢٣abc", "__init__ --- ...", "﻿abc­",
]


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
        "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest(),
    }


def encoded(docs):
    return bpe.encode_and_decode(docs, PATH, public_tokenizers.PATTERN)


def test_documents_match_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    found = {r.pop("doc_id"): r for r in rows(encoded(documents(spark)))}
    assert found == {k: digests(t) for k, t in texts.items()}


def test_awkward_texts_match_the_library(spark):
    found = {r.pop("doc_id"): r for r in rows(encoded(docs_of(spark, TEXTS)))}
    assert found == {i: digests(t) for i, t in enumerate(TEXTS)}


def test_odd_rows_keep_their_number(spark):
    found = rows(encoded(odd_docs(spark)))
    expected = [(r["doc_id"], *digests(r["text"]).values()) for r in rows(odd_docs(spark))]
    assert sorted((tuple(r.values()) for r in found), key=str) == sorted(expected, key=str)


def test_small_chunks_change_nothing(spark, monkeypatch):
    texts = [f"word{i} word{i % 7} again" for i in range(60)]
    before = sorted(map(str, rows(encoded(docs_of(spark, texts)))))
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 5)
    assert sorted(map(str, rows(encoded(docs_of(spark, texts))))) == before


def test_empty_table(spark):
    assert rows(encoded(docs_of(spark, []))) == []


def test_lists_of_ids_decode_to_the_text(spark):
    ids = bpe.encode(docs_of(spark, TEXTS), PATH, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in rows(bpe.decode(ids, PATH))} == dict(enumerate(TEXTS))


@pytest.mark.parametrize("seed", range(3))
def test_merging_by_heap_equals_the_library(seed):
    rng = random.Random(seed)
    for _ in range(200):
        piece = "".join(rng.choice("abehinorst é") for _ in range(rng.randint(1, 300))).replace(" ", "")
        if piece:
            assert bpe.merge(piece.encode(), bpe.ranks_of(PATH)) == LIBRARY.encode_ordinary(piece)


def test_splitting_equals_the_pattern():
    import regex

    whole = regex.compile(public_tokenizers.PATTERN)
    own = bpe.splitter(public_tokenizers.PATTERN)
    rng = random.Random(1)
    chars = " \t\n'abstvrelm12½٣é漢́\x1c\x85　.,-\U0001f600"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 30)))
        if "\x1c" not in text:
            assert own.findall(text) == whole.findall(text)
        assert "".join(own.findall(text)) == text
