import random
import re

import pytest
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab.@-", "0123.", "01 -+().", "a1@.%+ -é", "2550.19", "4 0-1"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_are_read_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        pii.base_spans(text)
        list(pii.identifiers(text, []))


def test_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    found = {r["doc_id"]: [tuple(s.values()) for s in r["base"]] for r in rows(pii.find_personal_data(documents(spark)))}
    assert found == {k: plain_base(t) for k, t in texts.items()}
    assert sum(map(len, found.values())) > 10


def plain_context(text, start):
    return " ".join(re.findall(r"[^\W\d_]+", text[:start])[-2:]).lower()


def plain_found(texts, still=pii.STILL, confidence=0.6, support=3):
    """The method with dictionaries instead of tables."""
    mentions = []
    for i, text in enumerate(texts):
        base = pii.base_spans(text)
        for a, b, seed in [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in pii.identifiers(text, base)]:
            if p := plain_context(text, a):
                mentions.append((i, a, b, p, text[a:b].lower(), seed))
    edges = {}
    for _, _, _, p, x, seed in mentions:
        n, s = edges.get((p, x), (0, False))
        edges[p, x] = (n + 1, s or seed)
    score = {e: float(s) for e, (_, s) in edges.items()}
    before = None
    while True:
        good = {}
        for pattern in {p for p, _ in edges}:
            own = {e: v for e, v in edges.items() if e[0] == pattern}
            conf = sum(n * score[e] for e, (n, _) in own.items()) / (sum(n for n, _ in own.values()) + 1)
            good[pattern] = (conf, sum(score[e] >= 0.5 for e in own))
        if before is not None and all(abs(good[p][0] - before[p][0]) <= still for p in good):
            break
        before = good
        for x in {x for _, x in edges}:
            doubt = 1.0
            for (p, y) in edges:
                if y == x:
                    doubt *= 1 - min(good[p][0], 0.999)
            seeded = any(s for (_, y), (_, s) in edges.items() if y == x)
            for e in edges:
                if e[1] == x:
                    score[e] = 1.0 if seeded else 1 - doubt
    out = {i: [] for i in range(len(texts))}
    for i, a, b, p, _, seed in mentions:
        if not seed and good[p][0] >= confidence and good[p][1] >= support:
            out[i].append((a, b))
    return {i: sorted(v) for i, v in out.items()}


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(8)
    texts = [f"Hello, please call me at +49 30 {rng.randint(10**6, 10**7)} soon." for _ in range(9)]
    texts += ["Oh well, please call me at 0171/5550{}!".format(i) for i in range(2)]
    texts += ["The old part number is 99-{}-77".format(i) for i in range(5)]
    texts += ["we once again call me at 0171/55500 or not", "write to a.b@c.de or x@y.zz"]
    found = rows(pii.find_personal_data(docs_of(spark, texts)))
    shown = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in found}
    assert shown == plain_found(texts)
    assert [texts[9][a:b] for a, b in shown[9]] == ["0171/55500"]
    assert all(not shown[i] for i in range(11, 16))


def test_contexts_reach_as_far_as_the_words(spark):
    rng, gap = random.Random(2), " ".join(["....", "12", "- - -"] * 30)
    texts = [f"Customer number {gap} +49 30 {rng.randint(10**6, 10**7)}" for _ in range(6)]
    texts += [f"Customer number {gap} AB-{i}5550" for i in range(3)]
    for text in texts:
        starts = [a for a, _, _ in pii.base_spans(text)] + [len(text) - 3, 0, 5]
        assert pii.contexts(text, starts) == [plain_context(text, a) or None for a in starts]
    found = rows(pii.find_personal_data(docs_of(spark, texts)))
    shown = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in found}
    assert shown == plain_found(texts) and any(shown.values())


def test_chains_of_contexts_are_followed_to_their_end(spark):
    # Each context shares identifiers with the next one only; the first has seeds.
    texts = [f"reach him at +49 30 555{i}00" for i in range(20)] + [f"reach him at ID0{i}777" for i in range(4)]
    for link in range(6):
        name = f"step {'abcdefg'[link]}"
        texts += [f"{name} ID{link}{i}777" for i in range(4) for _ in range(6)]
        texts += [f"{name} ID{link + 1}{i}777" for i in range(4)]
    found = rows(pii.find_personal_data(docs_of(spark, texts)))
    shown = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in found}
    assert shown == plain_found(texts)
    assert shown[len(texts) - 1]


def test_odd_rows_and_empty_table(spark):
    found = rows(pii.find_personal_data(odd_docs(spark)))
    assert len(found) == odd_docs(spark).count() and not any(r["base"] or r["found"] for r in found)
    assert rows(pii.find_personal_data(docs_of(spark, []))) == []
