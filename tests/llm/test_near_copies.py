import random

import corpus_pipeline
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import near_copies, simhash


def plain_kept(texts: dict, words: int = 5) -> set:
    """Smallest ids of the components of texts with a Jaccard similarity of 0.8 or more."""
    sets, least = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n, m = len(sets[a]), len(sets[b])
            if 5 * min(n, m) >= 4 * max(n, m) and 9 * len(sets[a] & sets[b]) >= 4 * (n + m):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {k for k in keys if find(k) == k}


def edited(rng, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def test_stage_drops_edited_copies_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    found = {r["doc_id"] for r in rows(corpus_pipeline.simhash_near_dedup(spark, docs, ""))}
    assert found == plain_kept(texts)
    assert not {56, 944} & found


def test_groups_of_edited_copies_match_brute_force(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 60, 200, 900)))]
        for _ in range(10):
            texts.append(" ".join(edited(rng, words, rng.randint(0, max(1, len(words) // 20)))))
    # a group whose members are near the threshold to each other
    base = [f"v{i}" for i in range(300)]
    texts += [" ".join(edited(rng, base, 6)) for _ in range(60)]
    found = {r["doc_id"] for r in rows(near_copies.keep_one(docs_of(spark, texts)))}
    assert found == plain_kept(dict(enumerate(texts)))
    assert len(found) < len(texts)


def test_texts_that_share_a_frame_are_no_candidates(spark, monkeypatch):
    rng = random.Random(9)
    frame = [f"f{i}" for i in range(330)]
    texts = [" ".join(frame + [f"o{rng.randrange(10**9)}" for _ in range(42)]) for _ in range(400)]
    counted = []
    in_order = near_copies._in_order

    def count(pairs):
        found = in_order(pairs)
        counted.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_in_order", count)
    kept = rows(near_copies.keep_one(docs_of(spark, texts)))
    assert len(kept) == len(texts)
    assert len(counted) == 3 and counted[-1] <= 400


def test_odd_rows_and_empty_table(spark):
    kept = near_copies.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 4, 5, 6]
    assert rows(near_copies.keep_one(docs_of(spark, []))) == []


def test_rows_that_repeat_an_id_or_have_none_are_rows_like_others(spark):
    data = [(1, "b b b b"), (1, "a a a a"), (2, "c d e f"), (None, "n o p q"), (None, "n o p q"), (None, "c d e f"), (3, "a a a a")]
    kept = rows(near_copies.keep_one(spark.createDataFrame(data, "doc_id long, text string")))
    expected = [(1, "a a a a"), (1, "b b b b"), (2, "c d e f"), (None, "n o p q")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(k), t) for k, t in expected)


def test_stage_joins_what_fingerprints_link(spark):
    """Texts within three bits leave one, although five-word shingles keep them apart."""
    rng, line = random.Random(5), [f"w{i}" for i in range(13)]
    base = line * 60
    texts = [" ".join(base), " ".join(base[:260] + [f"n{i}" for i in range(6)] + base[260:])]
    texts.append(" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)))
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() <= 3
    assert plain_kept(dict(enumerate(texts))) == {0, 1, 2}
    found = corpus_pipeline.simhash_near_dedup(spark, docs_of(spark, texts), "")
    assert {r["doc_id"] for r in rows(found)} == {0, 2}
