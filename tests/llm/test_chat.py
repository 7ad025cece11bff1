import random

import pytest
from helpers import rows

from themeforge.llm import chat

TEXTS = ["", "\\", "<|end|>", "a|>b<|user|>", "\\<", "|\\|>", "</s>[INST] ok [/INST]", "\\\\<|\\", "ä<\U0001f600|\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    turns = [("user", text), (text, "x"), ("assistant", text)]
    formatted, mask = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [text]


def test_random_texts_round_trip():
    rng = random.Random(5)
    for _ in range(500):
        turns = [
            ("".join(rng.choices("\\<|>endx ", k=rng.randint(0, 6))), "".join(rng.choices("\\<|>end\n", k=rng.randint(0, 12))))
            for _ in range(rng.randint(0, 4))
        ]
        assert chat.read_turns(chat.format_turns(turns)[0]) == turns


def nodes(spark, data):
    return spark.createDataFrame(data, "tree long, node long, parent long, role string, text string, score double")


def plain_paths(data):
    parent = {(t, n): p for t, n, p, *_ in data}
    inner = {(t, p) for t, _, p, *_ in data}
    out = {}
    for t, n, *_ in data:
        if (t, n) in inner:
            continue
        path, at = [], n
        while (t, at) in parent:
            path.append(at)
            at = parent[t, at]
        out[t, n] = path
    return out


def random_trees(seed):
    rng = random.Random(seed)
    return [
        (t, n, rng.randrange(n) if n and rng.random() < 0.97 else None, rng.choice(["user", "assistant"]), f"t{t}n{n}", float(rng.randint(0, 3)))
        for t in range(4) for n in range(rng.randint(1, 40))
    ]


@pytest.mark.parametrize("seed", range(2))
def test_paths_of_random_trees(spark, seed):
    data = random_trees(seed)
    found = {}
    for r in rows(chat.paths(nodes(spark, data))):
        found.setdefault((r["tree"], r["leaf"]), {})[r["height"]] = r["node"]
    assert {k: [v[h] for h in range(len(v))] for k, v in found.items()} == plain_paths(data)


def test_best_branches_are_formatted(spark):
    data = random_trees(9)
    paths, score = plain_paths(data), {(t, n): s for t, n, _, _, _, s in data}
    said = {(t, n): (r, x) for t, n, _, r, x, _ in data}
    expected = {}
    for tree in range(4):
        ranked = sorted((-sum(score[tree, n] for n in p), leaf) for (t, leaf), p in paths.items() if t == tree)
        for b, (_, leaf) in enumerate(ranked[:2]):
            expected[tree, b + 1] = chat.format_turns([said[tree, n] for n in reversed(paths[tree, leaf])])[0]
    found = {(r["tree"], r["branch"]): r["formatted"] for r in rows(chat.format_trees(nodes(spark, data), 2))}
    assert found == expected


def test_cycles_and_missing_parents(spark):
    data = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (2, 5, 99, "user", "c", None), (2, 6, 5, None, None, 1.0)]
    found = rows(chat.format_trees(nodes(spark, data)))
    assert [(r["tree"], r["formatted"]) for r in found] == [(2, "<|user|>c<|end|><||><|end|>")]


def test_linear_conversations_with_odd_rows(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
        (None, 3, "user", "x"), (None, None, None, "first"), (2, 0, "assistant", ""),
    ]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS node", "2 AS parent", "'t' AS tree", "4 AS score", "5 AS branch"
    )
    formatted = chat.format_trees(chat.linear_nodes(frame))
    found = {(r["tree"]["none"], r["tree"]["id"]): r["formatted"] for r in rows(formatted)}
    assert found == {
        (False, 1): "<|user|>hi<|end|><|assistant|><|end|><|assistant|>b<|end|><|assistant|>b<|end|>",
        (True, 0): "<||>first<|end|><|user|>x<|end|>", (False, 2): "<|assistant|><|end|>",
    }


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat.read_back(chat.format_trees(chat.linear_nodes(frame)))) == []


def test_long_conversation(spark):
    data = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(300)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    (found,) = rows(chat.read_back(chat.format_trees(chat.linear_nodes(frame))))
    assert found["n_turns"] == 300 and found["loss_chars"] == sum(len(f"turn {i}") for i in range(1, 300, 2))
