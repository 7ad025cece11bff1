"""The conversation trie equals one that is built from all prefixes."""

import zlib
from hashlib import sha256

import pytest
from helpers import SF, rows

from themeforge.llm import trie
from themeforge.llm.queries import registered

NAMES = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def ordered(table: list[dict]) -> dict[int, list[tuple]]:
    out: dict[int, list] = {}
    for r in table:
        if r["conv_id"] is not None:
            out.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def n_words(text: str) -> int:
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    return len([w for w in text.split(" ") if w])


def plain(convs: dict[int, list]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, inside in members.items():
        own = (len(inside) - 1) * n_words(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children.get(node, 0),
            leaves[node], saved[node], sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(frame) -> list[tuple]:
    assert frame.columns == NAMES
    return sorted((tuple(r.values()) for r in rows(frame)), key=str)


def conversations(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_query(spark):
    table = rows(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert found(registered()["op12_prefix_trie"](spark, SF)) == plain(rebuilt(ordered(table)))


def made(r, n, deepest):
    data = []
    for c in range(n):
        for t in range(r.randint(0, deepest)):
            data.append((c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "b  c", "d\te f"])))
    return data


@pytest.mark.parametrize("seed, n, deepest", [(1, 60, 3), (2, 200, 6), (3, 30, 14)])
def test_shared_prefixes(spark, seed, n, deepest):
    import random

    data = made(random.Random(seed), n, deepest)
    said = conversations(spark, data)
    wanted = ordered(rows(said))
    assert found(trie.prefix_trie(trie.sequences(said))) == plain(wanted)
    headed = trie.prefix_trie(trie.with_heads(trie.sequences(said)))
    assert found(headed) == plain(rebuilt(wanted))


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    data = [(c, t, "user", f"x{t}") for c in range(60) for t in range(3)]
    data += [(100 + c, t, "user", f"x{t}" if t < 20 else f"{c} {t}") for c in range(3) for t in range(45 - c)]
    data += [(200, t, "user", f"x{t}") for t in range(20)]
    said = conversations(spark, data)
    assert found(trie.prefix_trie(trie.sequences(said))) == plain(ordered(rows(said)))


def test_odd_rows(spark):
    data = [
        (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (6, None, "", ""), (6, 1, "user", ""),
        (None, 0, "user", "lost"), (-3, 0, "user", "word " * 50_000), (7, 2, "user", "b"), (7, 2, "assistant", "b"),
    ]
    said = conversations(spark, data)
    clash = said.selectExpr("*", "1 AS conv", "2 AS depth", "'x' AS said", "3 AS a", "4 AS n", "5 AS ends")
    for frame in (said, clash):
        assert found(trie.prefix_trie(trie.sequences(frame))) == plain(ordered(rows(said)))
    assert found(trie.prefix_trie(trie.sequences(conversations(spark, [])))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    # 21 takes its only turn from conversation 20; where that is missing, nothing is left.
    ids = [c for c in range(20, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    said = conversations(spark, [(c, 0, "user", "own") for c in ids])
    wanted = rebuilt(ordered(rows(said)))
    assert any(not turns for turns in wanted.values()) or 20 in ids
    assert found(trie.prefix_trie(trie.with_heads(trie.sequences(said)))) == plain(wanted)
