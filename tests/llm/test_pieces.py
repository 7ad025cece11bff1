"""Pieces: ids and texts equal the sentencepiece library's."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
POOL = [
    "a", "b", " ", "  ", "\n", "the", "ing", "▁", "é", "中", "\U0001f600", "\x00", "\x85", "1", "aa", "ab",
    "<s>", "</s>", "<0x41>", "=", "==", "-", "\t", "ü", "́", "ა", "\r", "        ",
]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def digests(text):
    ids = library(text)
    return {
        "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
        "decoded_sha256": hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
    }


def random_text(r, most=60):
    return "".join(r.choice(POOL) for _ in range(r.randint(0, most)))


def test_random_texts(model):
    r = random.Random(5)
    texts = [random_text(r) for _ in range(3000)]
    found = list(pieces.Encoder(model).encode(texts))
    for text, ids in zip(texts, found):
        assert ids.tolist() == library(text), text
        assert pieces.decode_ids(model, ids).decode() == LIBRARY.decode(library(text)), text


def test_random_ids_decode_as_the_library_does(model):
    r = random.Random(6)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, 259, 28705, r.randint(3, 258), r.randint(0, 31999)]) for _ in range(r.randint(0, 12))]
        assert pieces.decode_ids(model, np.array(ids, np.int64)).decode() == LIBRARY.decode(ids), ids


def test_long_words_and_runs(model):
    r = random.Random(7)
    letters = "abcdefghij0123456789ABCXYZ+/"
    whole = [
        " " * 20_000, "a" * 50_000, " a" * 20_000, "the" * 20_000, "ababab" * 9_000, "=" * 30_001, "\r" * 5_001,
        "".join(r.choice(letters) for _ in range(50_000)), "éü" * 10_000, "中文" * 10_000,
    ]
    for text, ids in zip(whole, pieces.Encoder(model).encode(whole)):
        assert ids.tolist() == library(text), text[:20]


def test_long_texts_go_in_parts(model, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_CHARS", 50)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 20)
    r, encoder = random.Random(8), pieces.Encoder(model)
    texts = [random_text(r, 300) for _ in range(300)] + ["   " * 100, "x" * 500, " x" * 200 + "   "]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library(t) for t in texts]


def test_a_merge_that_creates_a_better_pair_is_taken_in_turn(model):
    # ABA is better than AB, so in ABAB the first merge must be followed by ABA, not by the second AB.
    chars = {"A": 0, "B": 1}
    size, ab, aba = 4, 2, 3
    of_char = np.full(0x110000, -1, np.int32)
    for c, i in chars.items():
        of_char[ord(c)] = i
    pairs = {(0, 1): (1, ab), (ab, 0): (0, aba)}
    codes = sorted((a * size + b, *v) for (a, b), v in pairs.items())
    toy = pieces.Model(
        8, 9, of_char, np.array(sorted([(65 << 21) | 66, (66 << 21) | 65]), np.int64),
        np.array([c[0] for c in codes]), np.array([c[1] for c in codes], np.int32),
        np.array([c[2] for c in codes], np.int32), size, np.array([False, True, False]),
        np.zeros(256, np.int32), True, [b"A", b"B", b"AB", b"ABA"], np.zeros(4, bool), np.ones(4, bool),
        np.zeros(4, bool),
    )
    ids, lens = pieces.encode_words(toy, ["ABAB", "ABB", "BA"])
    assert ids.tolist() == [aba, 1, ab, 1, 1, 0] and lens.tolist() == [2, 2, 2]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="only plain BPE"):
        pieces.read_model(str(tmp_path / "other.model"))


def test_documents(spark):
    found = {r.pop("doc_id"): r for r in rows(pieces.encode_and_decode(documents(spark), PATH))}
    assert found == {r["doc_id"]: digests(r["text"]) for r in rows(documents(spark))}


def test_odd_documents(spark):
    key = lambda r: str(sorted(r.items(), key=str))
    found = rows(pieces.encode_and_decode(odd_docs(spark), PATH))
    wanted = [{"doc_id": r["doc_id"], **digests(r["text"])} for r in rows(odd_docs(spark))]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert rows(pieces.encode_and_decode(docs_of(spark, []), PATH)) == []


def test_ids_and_back(spark):
    texts = ["Grüße aus Köln", None, "", " two  spaces ", "a▁b"]
    ids = pieces.encode(docs_of(spark, texts), PATH)
    listed = {r["doc_id"]: r["ids"] for r in rows(ids)}
    assert listed == {i: library(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in rows(pieces.decode(ids, PATH))}
    assert back == {i: LIBRARY.decode(library(t)) for i, t in enumerate(texts)}
